"""Column expressions over CIGAR strings and alignment counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>>; = and X count as M. A number without an operation at the end is an error."""
    open_end = F.raise_error(F.concat(F.lit("a number without an operation ends "), cigar)).cast("array<string>")
    parts = F.when(cigar.rlike("[0-9]$"), open_end).otherwise(F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)))
    size = lambda t: F.length(t)
    return F.transform(parts, lambda t: F.struct(F.substring(t, F.lit(1), size(t) - 1).cast("long").alias("len"), F.translate(F.substring(t, size(t), F.lit(1)), "=X", "MM").alias("op")))


def mapped_length(ops: Column) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin("M", "D")), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def exons(ops: Column, start: Column) -> Column:
    """struct<starts, ends>: N ends an exon; M, D and N advance."""
    start = start.cast("long")
    zero = F.struct(start.alias("at"), F.array(start).alias("starts"), F.array().cast("array<bigint>").alias("ends"))

    def step(a: Column, x: Column) -> Column:
        to = a["at"] + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(F.lit(0))
        cut = x["op"] == "N"
        return F.struct(
            to.cast("long").alias("at"),
            F.when(cut, F.concat(a["starts"], F.array(to))).otherwise(a["starts"]).alias("starts"),
            F.when(cut, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"]).alias("ends"),
        )

    return F.aggregate(ops, zero, step, lambda a: F.struct(a["starts"].alias("starts"), F.concat(a["ends"], F.array(a["at"])).alias("ends")))


def round2(x: Column) -> Column:
    """Two places, halves away from zero for x >= 0."""
    return F.floor(x * 100 + 0.5) / 100


def coverage(length: Column, hard: Column, soft: Column) -> Column:
    return (length - hard - soft) / length * 100


def identity(length: Column, hard: Column, soft: Column, ins: Column, dele: Column, mis: Column, how: str = "ident_cov") -> Column:
    """Matching share of the whole read, or with ``ident_map`` of its mapped part."""
    good = length - hard - soft - ins - dele - mis
    return good / (length if how == "ident_cov" else length - hard - soft) * 100


def flag_class(flag: Column) -> Column:
    return (
        F.when(flag == 0, "forward_strand").when(flag == 16, "reverse_strand").when(flag == 4, "unmapped")
        .when(flag.isin(256, 272), "not_primary").when(flag.isin(2048, 2064), "chimeric").otherwise("unknown")
    )
