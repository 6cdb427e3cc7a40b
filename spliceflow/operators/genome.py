"""Stretches of a genome for many rows: scaffolds are cut in tiles, and rows meet the tiles they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases a tile.
TILE = 1 << 16


def tiles(genome: DataFrame) -> DataFrame:
    """``genome``: id, seq. (scaffold, tile, piece)."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0))
    return genome.select(F.col("id").alias("scaffold"), F.posexplode(pieces).alias("tile", "piece")).withColumn("tile", F.col("tile").cast("long"))


def stretches(rows: DataFrame, genome: DataFrame, spans: Column, name: str) -> DataFrame:
    """``rows``: ord (unique), scaffold and more. Adds the bases of ``spans`` (array of structs s and e,
    0-based, half-open, in order) one after the other; what lies off the genome is left out."""
    want = rows.select("ord", "scaffold", F.posexplode(spans).alias("k", "x")).where(F.col("x.s") < F.col("x.e"))
    first, last = F.floor(F.greatest(F.col("x.s"), F.lit(0)) / TILE), F.floor((F.col("x.e") - 1) / TILE)
    want = want.where(F.col("x.e") > 0).select("ord", "scaffold", "k", "x", F.explode(F.sequence(first, last)).alias("tile"))
    met = want.join(tiles(genome), ["scaffold", "tile"])
    low = F.greatest(F.col("x.s") - F.col("tile") * TILE, F.lit(0))
    part = F.substring("piece", (low + 1).cast("int"), (F.col("x.e") - F.col("tile") * TILE - low).cast("int"))
    whole = F.array_sort(F.collect_list(F.struct("k", "tile", part.alias("part"))))
    found = met.groupBy(F.col("ord").alias("_ord")).agg(F.array_join(F.transform(whole, lambda x: x["part"]), "").alias(name))
    return rows.join(found, F.col("ord") == F.col("_ord"), "left").drop("_ord").withColumn(name, F.coalesce(name, F.lit("")))
