"""The corpus pipeline: five stages over ``documents``, each written and read back before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm import exact_dedup, ngram_join, packing, pii, toxicity
from spliceflow.llm.common import ascii_lower, documents, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; the model learns from labelled rows of this stage's input.

    A row goes for its own text alone: of texts that share a doc_id, or have none, only the toxic go.
    Null and empty texts stay. Repeated rows share one fate. An empty table, or one without labelled
    rows of both kinds, loses nothing. Columns of any name stay as they are.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    mark = F.xxhash64(docs["text"].cast("string"))
    bad = toxicity.score(docs.select("doc_id", "text", mark.alias("_mark")), model, keep=["_mark"]).where("predicted = 1")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("_mark").alias("_bad_mark")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (mark == bad["_bad_mark"]), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) one row with the largest doc_id stays.

    Null texts count as empty, so one row of all null and empty texts stays. A doc_id with several
    texts keeps those that win their own group. Of rows that repeat a doc_id and a text, and of a
    group where no row has a doc_id, the row whose columns sort last stays. An empty table stays
    empty. Columns of any name stay as they are.
    """
    found = exact_dedup.exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).agg(F.count(F.lit(1)).alias("_rows"))
    found = table(found, "kept")
    digest = F.sha2(ascii_lower(docs["text"].cast("string")).cast("binary"), 256)

    def those(keep: DataFrame) -> DataFrame:
        return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_kept_id"]) & (digest == keep["_kept_text"]), "left_semi")

    alone = those(found.where("_rows = 1"))
    if found.where("_rows > 1").isEmpty():
        return alone
    again = those(found.where("_rows > 1"))
    one = again.groupBy(again["doc_id"].alias("_id"), F.sha2(ascii_lower(again["text"].cast("string")).cast("binary"), 256).alias("_text"))
    return alone.unionByName(one.agg(F.max(F.struct(*(again[c] for c in docs.columns))).alias("_row")).select("_row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five words and a similarity of 0.8 the one with the smallest doc_id stays.

    Null, empty and wordless texts link with nothing and stay. Where a doc_id is null or repeated, every
    different (doc_id, text) is a document of its own; one with a doc_id stays before one without.
    Rows that repeat both share a fate. An empty table stays empty. Columns of any name stay as they are.
    """
    key = docs["doc_id"].cast("long")
    if not docs.groupBy(key.alias("k")).count().where("count > 1 OR k IS NULL").isEmpty():
        key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    found = ngram_join.components(docs.select(key.alias("doc_id"), docs["text"]), width=5, num=80, den=100)
    named = table(found.select(F.col("doc_id").alias("_doc"), "component_id").distinct(), "named")
    rank = docs.select(key.alias("_doc"), F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].cast("long").alias("id"), key.alias("doc")).alias("rank"))
    linked = named.where(F.col("_doc") != F.col("component_id")).select("component_id").distinct()
    member = table(named.join(linked, "component_id", "left_semi"), "members")
    first = table(member.join(rank, "_doc").groupBy("component_id").agg(F.min("rank").alias("first")), "first")
    lost = member.join(first, "component_id").where(F.col("_doc") != F.col("first.doc")).select("_doc")
    return docs.join(lost, key == lost["_doc"], "left_anti")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in every text; no row goes.

    Null texts stay null and empty ones empty. Repeated rows are changed alike and change nothing for
    the others. Rows without a doc_id are treated like all. An empty table stays empty. Columns of any
    name stay as they are.
    """
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's bucket, padded length, batch and slot.

    Null and empty texts have length 0 and are packed too, as are repeated rows, each by itself, and
    rows without a doc_id. Ties between boundaries go to the lower one. An empty table gives an empty
    result. Columns other than doc_id and text are not read.
    """
    return packing.pack(packing.lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: Fitted models, components and packing lie beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
