"""Segmentations with long pieces and long words."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.llm import bpe, langid


def test_pieces_of_the_whole_vocabulary():
    names = langid.pieces(bpe.vocabulary("piece_bpe_32k.model"))
    assert max(map(len, names)) == 16 and sum(len(n) > 6 for n in names) == 7244


def test_forward_with_long_pieces_and_words():
    names = sorted({"▁", "a", "b", "abababab", "▁abababa", "bababababab"})
    number = {x: i for i, x in enumerate(names)}
    p = np.array([[0.1 + 0.01 * i, 0.02] for i in range(len(names))] + [[0.05, 0.3], [0.0, 0.0]])

    def every(w, lang):
        sums = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            for k in range(1, e + 1):
                x = w[e - k : e]
                sums[e] += sums[e - k] * (p[number[x], lang] if x in number else p[len(names), lang] if k == 1 else 0.0)
        return sums[-1]

    scorer = langid.Scorer(["x", "y"], number, p)
    for w in ("abababab", "abababababababz", "ab" * 40):
        scorer.learn({w})
        for lang in (0, 1):
            assert scorer.known[w][lang] == pytest.approx(math.log(every("▁" + w, lang)))
    scorer.learn({"ab" * 2000})
    assert np.isfinite(scorer.known["ab" * 2000]).all() and (scorer.known["ab" * 2000] < -700).all()


def test_fit_same_over_logarithms(monkeypatch):
    counts = [("x", "abababab", 3), ("x", "bab", 2), ("y", "bbbb", 5)]
    names = ["a", "abababab", "b", "ba", "▁", "▁aba"]
    plain = langid.fit(counts, names)[2]
    monkeypatch.setattr(langid, "SPAN", 0)
    assert np.allclose(plain, langid.fit(counts, names)[2])


def test_rare_language_is_learned(spark):
    rows = [(i, "bakoti koba tiba", "aa") for i in range(3000)] + [(9000 + i, "schung ersch", "zz") for i in range(3)] + [(None, "bakoti", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), bpe.vocabulary("piece_bpe_32k.model"), sample=20)
    assert model[0] == ["aa", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(got[9000 + i] == "zz" for i in range(3)) and got[0] == "aa"
