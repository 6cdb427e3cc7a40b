"""The pipeline's stages on a small table against what each must keep."""

import random

import corpus_pipeline
from tests.llm.test_operators import words


def test_run(spark, tmp_path):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        rows.append((i, words(rng, 60) + (" scoundrel" if bad else "") + " " + words(rng, 5)))
        labels.append((i, 1, int(bad)))
    rows.append((500, rows[1][1].upper()))  # a copy of 1
    near = rows[2][1].split()
    near[3] = "changed"
    rows += [(501, " ".join(near)), (502, None), (503, "mail me@host.org now"), (504, "")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == docs.columns
        if name == "pii":
            assert {r["doc_id"]: r["text"] for r in now.collect()}[503] == "mail <EMAIL> now"
    want = {i for i in range(120) if i % 6} - {1} | {500, 503, 504}
    assert {r["doc_id"] for r in now.collect()} == want == {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}


#: Columns whose names the operators use themselves.
WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, component_id long, th long, n long, kept boolean"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 9, 3, 1, True) for i, t in rows], WIDE)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = wide(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0 and (name == "packing" or now.schema.names == wide(spark, []).schema.names)


def test_stages_keep_rows_apart_by_id_and_text(spark, tmp_path):
    rng = random.Random(3)
    long = words(rng, 3000)
    bad = [(200 + i, f"{words(rng, 12)} scoundrel {words(rng, 3)}") for i in range(12)]
    fine = [(300 + i, words(rng, 15)) for i in range(40)]
    spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in fine], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    near = words(rng, 40).split()
    twin = " ".join([*near[:-1], "other"])
    near = " ".join(near)
    rows = [
        (7, "dup a"), (7, "dup b"), (8, "DUP B"), (9, "same"), (9, "same"), (None, "none"), (None, "none"), (None, None), (1, None), (2, ""), (5, long), (6, long),
        (40, f"a scoundrel {words(rng, 4)}"), (40, "a fine text"), (None, f"scoundrel {words(rng, 4)}"), (50, near), (51, twin), (51, "no twin of any other text here"), (None, twin + " x"), (60, "write me@host.org"),
    ]
    now, at = wide(spark, [*rows, *bad, *fine]), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        at[name] = sorted(now.collect(), key=key)
        assert now.schema.names == wide(spark, []).schema.names and all(r["spans"] == "x" and r["component_id"] == 9 for r in at[name])
        now = spark.createDataFrame(at[name], WIDE)
    pairs = lambda name: [(r["doc_id"], r["text"]) for r in at[name] if (r["doc_id"] or 0) < 200]
    want = [r for r in rows if "scoundrel" not in (r[1] or "")]
    assert pairs("toxicity") == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")) and not any(r["doc_id"] in {i for i, _ in bad} for r in at["toxicity"])
    want = [(2, ""), (6, long), (7, "dup a"), (8, "DUP B"), (9, "same"), (40, "a fine text"), (50, near), (51, "no twin of any other text here"), (51, twin), (60, "write me@host.org"), (None, "none"), (None, twin + " x")]
    by = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    want.sort(key=by)
    assert pairs("exact_dedup") == want
    want = [r for r in want if r not in ((51, twin), (None, twin + " x"))]
    assert pairs("ngram_join") == want
    assert pairs("pii") == [(i, "write <EMAIL>" if i == 60 else t) for i, t in want]
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(at["pii"], WIDE), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in packed) == sorted((r["doc_id"] or -1, len((r["text"] or "").split())) for r in at["pii"])
