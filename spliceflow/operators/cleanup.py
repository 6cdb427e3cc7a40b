"""Poly-A tails of full-length reads: find, cut, count."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, BIN = 0.7, 200


def find_tail(seq: str) -> tuple[int, int, bool]:
    """(bases of tail, A's counted, whether the read is one run only, with nothing to decide by).

    Runs of A and of other bases are read from the 3' end; the last one never counts as a run.
    """
    runs = [(is_a, len(list(g))) for is_a, g in groupby(reversed(seq), lambda c: c == "A")][:-1]
    if not runs:
        return 0, 0, True
    size = lambda k: runs[k][1] if k < len(runs) else None
    cut = begin = counted = walked = 0
    for k, (is_a, n) in enumerate(runs):
        thin = k > 2 and counted / walked < SHARE
        walked += n
        after, end = size(k + 1), False
        if is_a:
            here = begin + n
            if after is None:
                cut = here
                break
            counted += n
            end = after > 2
        else:
            here = begin
            if after is None or n > 2:
                end = True
            elif after < 2:
                end = size(k + 3) is None or size(k + 2) > 1 or size(k + 3) < 3
        if end or thin:
            cut = here
            break
        begin += n
    tail = seq[len(seq) - cut :] if cut else seq
    if tail.count("A") / len(tail) < SHARE:
        cut = runs[0][1] if runs[0][0] else 0
    return cut, counted, False


def trim(reads: DataFrame, min_length: int = 200) -> DataFrame:
    """``reads``: rec_no, description, seq. Adds trimmed, tail, polya_count and status: pass, short or
    overrun (a read that is one run only; an empty one is short)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [find_tail(s) for s in f["seq"]]
            f["trimmed"] = [s[: len(s) - t[0]] for s, t in zip(f["seq"], found)]
            f["tail"] = [s[len(s) - t[0] :] for s, t in zip(f["seq"], found)]
            f["polya_count"] = [t[1] for t in found]
            f["status"] = ["short" if len(x) < min_length else "overrun" if t[2] else "pass" for x, t in zip(f["trimmed"], found)]
            yield f

    schema = "rec_no long, description string, seq string, trimmed string, tail string, polya_count long, status string"
    return reads.select("rec_no", "description", F.coalesce("seq", F.lit("")).alias("seq")).mapInPandas(work, schema)


def tail_histogram(trimmed: DataFrame) -> DataFrame:
    return trimmed.groupBy(F.col("polya_count").alias("polya_num")).agg(F.count(F.lit(1)).alias("polya_num_count"))


def summary(trimmed: DataFrame) -> DataFrame:
    """One row of counts. A tail of exactly six A's is in neither of the two upper classes."""
    a, ok, size = F.col("polya_count"), F.col("status") == "pass", F.length("trimmed")
    # The first of the longest reads, if it has a base at all.
    first = F.max(F.when(ok & (size > 0), F.struct(size.alias("n"), (-F.col("rec_no")).alias("o"), F.col("description").alias("id"))))
    counts = {
        "total_read_count": F.lit(True), "pass_read_count": ok, "discarded_read_count": ~ok, "polya_zero_read_count": a == 0, "polya_upto_five_read_count": (a > 0) & (a < 6),
        "polya_sixormore_read_count": a > 6,
    }
    bins = trimmed.groupBy(F.when(ok, F.floor(size / BIN) * BIN).alias("bin")).agg(*(F.count_if(c).alias(n) for n, c in counts.items()), first.alias("f"), F.max("polya_count").alias("most"))
    peak = F.max(F.when(F.col("bin").isNotNull(), F.struct(F.col("pass_read_count").alias("n"), (-F.col("bin")).alias("b"))))
    one = bins.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts), F.max("f").alias("f"), F.coalesce(F.max("most"), F.lit(0)).alias("longest_polya_length"), peak.alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return one.select(
        *counts, zero(F.col("f.n")).alias("longest_trimmed_read_length"), F.coalesce("f.id", F.lit("")).alias("longest_trimmed_read_id"),
        zero(-F.col("p.b")).alias("peak_read_length"), zero(F.col("p.n")).alias("peak_read_count"), "longest_polya_length",
    )
