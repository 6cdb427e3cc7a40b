"""The registered queries' own rules, on small tables."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spliceflow.llm import hnsw, queries
from tests.llm.test_operators import words


def crc(i):
    return zlib.crc32(str(i).encode())


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_op3_learns_from_no_held_out_row(spark, tmp_path):
    rng = random.Random(1)
    say = {"aa": ["ba", "ko", "ti"], "bb": ["sch", "ung", "er"], "zz": ["xyx", "qov"]}
    text = lambda x: " ".join("".join(rng.choice(say[x]) for _ in range(3)) for _ in range(12))
    rows = [(i, text(x), x, "s", 1) for i in range(400) for x in [("zz" if crc(i) % 4 == 2 and i % 3 == 0 else rng.choice(("aa", "bb")))]]
    rows += [(1000, None, "aa", "s", 1), (1001, "12 ½", "aa", "s", 1), (1002, text("bb"), None, "s", 1)]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in queries.op3_langid(spark, str(tmp_path)).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {r[0]: crc(r[0]) % 4 == 2 for r in rows}
    assert {r["lang_pred"] for r in got.values()} == {"aa", "bb", "und"} and got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "bb"
    held = [got[i]["lang_pred"] == x for i, _, x, *_ in rows[:400] if x != "zz" and crc(i) % 4 == 2]
    assert sum(held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())


def test_op4_learns_from_no_held_out_label(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        held = crc(i) % 5 == 0
        bad = "miscreant" if held and i % 2 else "scoundrel" if i % 4 == 0 else ""
        rows.append((i, f"{words(rng, 15)} {bad} {words(rng, 5)}", "en", "s", 1))
        labels.append((i, 1, int(bool(bad))))
    save(spark, tmp_path, "documents", [*rows, (900, "", "en", "s", 0), (901, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    save(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    assert all(r["held_out"] == (crc(i) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    flagged = {i for i, r in got.items() if r["predicted"]}
    assert flagged == {i for i, t, *_ in rows if "scoundrel" in t}  # the other word stands in held-out rows alone


def test_hnsw_ranks_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(2)
    x[50:58] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, shard_size=100).collect()
    by = {}
    for r in got:
        assert abs(r["score"] - float((x[r["vec_id"]] * x[r["query_id"]]).sum())) < 1e-9 and r["vec_id"] != r["query_id"]
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    for found in by.values():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[0], f[1]))
