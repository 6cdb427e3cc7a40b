"""Positional variants and the reads that cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.operators import groups
from spliceflow.operators.genome import TILE, tiles

BIN = 1000


def calls(variation: DataFrame, min_reads: int = 5, n_rows: int | None = None) -> DataFrame:
    """``variation``: scaf, pos, vtype, alt, read_id. Variants with enough distinct reads."""
    rows = groups.dealt(variation, n_rows, "scaf", "pos")
    return rows.groupBy("scaf", "pos", "vtype", "alt").agg(F.countDistinct("read_id").alias("n_reads")).where(F.col("n_reads") >= min_reads)


def covering(called: DataFrame, variation: DataFrame, exons: DataFrame, width: int = BIN, n_rows: int | None = None) -> DataFrame:
    """(scaf, pos, read_id): reads that carry any variant at a called position or have an exon over
    it. Positions and exons meet on bins of ``width`` bases."""
    places = groups.dealt(called.select("scaf", "pos"), n_rows, "scaf", "pos").distinct()
    carried = groups.dealt(variation.select("scaf", "pos", "read_id"), n_rows, "scaf", "pos").join(places, ["scaf", "pos"], "left_semi")
    bins = F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))
    spread = groups.dealt(exons.select("scaf", "s", "e", "read_id", F.explode(bins).alias("bin")), n_rows, "scaf", "bin")
    met = groups.dealt(places.withColumn("bin", F.floor(F.col("pos") / width)), n_rows, "scaf", "bin").join(spread, ["scaf", "bin"]).where("s <= pos AND pos < e")
    return groups.dealt(carried.unionByName(met.select("scaf", "pos", "read_id")), n_rows, "scaf", "pos").distinct()


def coverage(called: DataFrame, cover: DataFrame, n_rows: int | None = None) -> DataFrame:
    return groups.dealt(called, n_rows, "scaf", "pos").join(cover.groupBy("scaf", "pos").agg(F.count(F.lit(1)).alias("cov_count")), ["scaf", "pos"])


def coverage_groups(cover: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Positions of a scaffold that the same reads cover."""
    line = cover.groupBy("scaf", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_set("read_id")), lambda x: x.cast("string")), ",").alias("reads"))
    line = groups.dealt(line, n_rows, "scaf", "reads")
    return line.groupBy("scaf", "reads").agg(F.array_join(F.transform(F.array_sort(F.collect_set("pos")), lambda x: x.cast("string")), ",").alias("positions"))


def report(variation: DataFrame, accepted: DataFrame, genome: DataFrame, min_reads: int = 5) -> tuple[DataFrame, DataFrame]:
    """(variants with reference base, read and coverage counts; positions by the reads that cover them).

    ``variation`` holds every mapped read's differences, ``accepted`` the reads that passed (scaffold,
    starts, ends, read_id). Scaffolds without an accepted read and places off the genome go.
    """
    size = genome.select(F.col("id").alias("scaf"), F.length("seq").alias("size"))
    sound = variation.join(accepted.select(F.col("scaffold").alias("scaf")).distinct(), "scaf", "left_semi")
    sound = sound.join(size, "scaf").where("pos >= 0 AND pos < size").drop("size")
    called = calls(sound, min_reads)
    pairs = F.explode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")))
    exons = accepted.select(F.col("scaffold").alias("scaf"), "read_id", pairs.alias("x")).select("scaf", "read_id", "x.s", "x.e")
    cover = covering(called, sound, exons)
    reads = sound.groupBy("scaf", "pos", "vtype", "alt").agg(F.array_join(F.array_sort(F.collect_set("read_id")), ",").alias("cluster_list"))
    base = F.when(F.col("vtype") == "M", F.substring("piece", (F.col("pos") % TILE + 1).cast("int"), F.lit(1))).otherwise("NA")
    rows = coverage(called, cover).join(reads, ["scaf", "pos", "vtype", "alt"]).withColumn("tile", F.floor(F.col("pos") / TILE))
    rows = rows.join(tiles(genome).withColumnRenamed("scaffold", "scaf"), ["scaf", "tile"])
    rows = rows.select("scaf", "pos", "vtype", base.alias("ref_allele"), "alt", F.col("n_reads").alias("count"), "cov_count", "cluster_list")
    return rows, coverage_groups(cover)
