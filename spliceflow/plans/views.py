"""Transcript-shaped views over star-schema tables, as DataFrames and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceflow.operators import groups


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_rows(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """Counted in the files' footers."""
    return read(spark, sf_dir, name).count()


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx, scaf, strand, src, k, s, e. Rows of an order lie together, in as many tasks as lineitem's rows ask for."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = o.join(groups.dealt(li, n_rows(spark, sf_dir), "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = rows.withColumn("k", k.cast("long"))
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    s = (F.floor(days / 10) * 200 + (F.col("k") - 1) * 60 + F.col("l_partkey") % 4).cast("long")
    return rows.select(
        F.col("o_orderkey").alias("tx"), F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 50).cast("string")).alias("scaf"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("o_orderpriority").alias("src"), "k",
        s.alias("s"), (s + 30 + F.col("l_quantity").cast("long") % 8).alias("e"),
    )


EXON = """exon0 AS (
  SELECT o_orderkey AS tx, 'c' || CAST(o_custkey // 50 AS VARCHAR) AS scaf, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         o_orderpriority AS src, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, l_partkey, CAST(l_quantity AS BIGINT) AS q,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
exon AS (SELECT tx, scaf, strand, src, k, (days // 10) * 200 + (k - 1) * 60 + l_partkey % 4 AS s, (days // 10) * 200 + (k - 1) * 60 + l_partkey % 4 + 30 + q % 8 AS e FROM exon0)"""

MODEL = """model AS (SELECT tx, any_value(scaf) AS scaf, any_value(strand) AS strand, any_value(src) AS src, min(s) AS ts, max(e) AS te, count(*) AS n,
  list(s ORDER BY k) AS starts, list(e ORDER BY k) AS ends FROM exon GROUP BY tx)"""


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, trans, source, read_id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.floor(F.col("user_id") / 5).alias("gene"), F.col("user_id").alias("trans"), F.col("event_type").alias("source"), F.col("event_id").alias("read_id"))


SUPPORT = "support AS (SELECT user_id // 5 AS gene, user_id AS trans, event_type AS source, event_id AS read_id FROM events)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq over ACGT from texts."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.regexp_replace(F.translate(F.lower("text"), "aeioubdfghjklmnpqrstvwxyz", "acgtacgtacgtacgtacgtacgta"), "[^acgt]", "").alias("seq")).select("id", F.upper("seq").alias("seq"))


SEQ = "seqs AS (SELECT doc_id AS id, upper(regexp_replace(translate(lower(text), 'aeioubdfghjklmnpqrstvwxyz', 'acgtacgtacgtacgtacgtacgta'), '[^acgt]', '', 'g')) AS seq FROM documents)"
