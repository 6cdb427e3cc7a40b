"""Helpers shared by the text operators: shared-folder tables, input shaping, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of a batch of rows on its way to Python, instead of the default of 64 MB.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spliceflow-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # this write's shuffle files go as soon as the table stands
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, whose session sends batches of some ``BATCH`` bytes to Python from now on."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":  # a size that someone chose stays
        conf.set(_BATCH, f"{BATCH}b")
    return rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id long, text string): columns of any other name in ``docs`` cannot clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; a null is the empty string."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def sample_rate(have: int, want: int) -> float:
    return 1.0 if have <= want else want / have


def hash_unit(col: Column) -> Column:
    """A uniform number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
