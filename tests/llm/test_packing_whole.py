"""Boundaries of least padding over long lengths."""

import itertools
import random

from spliceflow.llm import packing


def test_pack_long_lengths_optimal(spark):
    rng = random.Random(3)
    distinct = [5, 300, 1025, 1040, 1041, 2049, 2100, 5003, 9001]
    lengths = [x for x in distinct for _ in range(rng.randint(1, 30))]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    for most in (1, 3, 4):
        got = packing.pack(rows, buckets=most).collect()
        cuts = ([*c, 9001] for c in itertools.combinations(distinct[:-1], most - 1))
        assert sum(r["padded_len"] - r["n_tokens"] for r in got) == min(sum(min(c for c in cut if c >= n) - n for n in lengths) for cut in cuts)
    hot = packing.pack(spark.createDataFrame([(i, 1025) for i in range(50)], "doc_id long, n_tokens long")).collect()
    assert {r["padded_len"] for r in hot} == {1025}


def test_boundaries_of_many_lengths():
    rng = random.Random(4)
    for _ in range(60):
        tops = sorted(rng.sample(range(3000), 25))
        bins = [(t, n, t * n) for t in tops for n in (rng.randint(1, 40),)]
        best = [0] + [float("inf")] * len(bins)
        for _ in range(5):
            best = [0] + [min(best[i] + sum((tops[j] - t) * n for t, n, _ in bins[i : j + 1]) for i in range(j + 1)) for j in range(len(bins))]
        cut = packing.boundaries(bins, 5)
        assert len(cut) <= 5 and sum((min(c for c in cut if c >= t) - t) * n for t, n, _ in bins) == best[-1]
