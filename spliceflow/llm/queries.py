"""The operators' queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm import bpe, exact_dedup, hnsw, langid, ngram_join, packing, pii, sharding, suffix_dedup, toxicity
from spliceflow.llm.common import documents


def crc(modulus: int) -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(documents(spark, sf_dir), width=4, num=85, den=100)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, crc(4) != 2, bpe.vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", (crc(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (crc(5) == 0).alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), bpe.vocabulary(), ids=False)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.lengths(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_ngram_join, op2_pii, op3_langid, op4_toxicity, op5_sharding, op6_hnsw, op7_bpe, op8_suffix_dedup, op9_exact_dedup, op10_packing)
    return {f.__name__: f for f in made}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_sql() -> str:
    """The claimed slots stand in the statement as two hexadecimal digits each."""
    owner = "".join(f"{s:02x}" for s in sharding.fill([f"shard-{i}" for i in range(sharding.SHARDS)]))
    return f"""
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(('0x' || substr('{owner}', slot * 2 + 1, 2)) AS INTEGER) AS shard FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": op5_sql(), "op9_exact_dedup": OP9_SQL}
