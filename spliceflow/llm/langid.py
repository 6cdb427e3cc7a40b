"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. For each language, piece probabilities are fitted by
expectation-maximisation over word counts, where a forward-backward pass sums over all ways to cut
a word into pieces. A text's score is the sum of its words' log probabilities, each the forward sum
over all segmentations, and the posterior over languages follows from it.

The counts come from a bounded sample of labelled rows (``SAMPLE`` of each language, then the ``WORDS`` most
frequent words of a language); every text is scored whole. The sums of words longer than ``SPAN``
characters are taken over logarithms, as their probabilities are too small for floats.

Defined cases: a null text or one without a letter gives ``und`` and score 0; without any labelled
row every text is ``und``; ties go to the language that sorts first; repeated rows give repeated
results; rows with a null doc_id stay; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import hash_unit, in_batches

SAMPLE, WORDS, ROUNDS = 6000, 6000, 3
LONGEST, SPAN = 16, 32
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_state: dict[str, object] = {}


def pieces(path: str) -> list[str]:
    """Pieces of letters (a word's first one after the mark for a word start), lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    kept = {n for n in names if n.lstrip("▁").isalpha()} | {"▁"}
    if max(map(len, kept)) > LONGEST:
        raise ValueError(f"pieces of more than {LONGEST} characters")
    return sorted(kept)


def beginnings(number: dict[str, int]) -> dict[str, int]:
    """Piece numbers by piece, and -1 by the beginnings of pieces that are no pieces."""
    out = {n[:k]: -1 for n in number for k in range(1, len(n))}
    return out | number


class Lattice:
    """The pieces in words of equal length: row, end, length and piece number of each, sorted by end, then length."""

    def __init__(self, words: list[str], number: dict[str, int], unknown: int, walk: dict[str, int] | None = None):
        n = self.n = len(words[0])
        walk = beginnings(number) if walk is None else walk
        get = walk.get
        flat = array("i")
        for row, w in enumerate(words):
            for s in range(n):
                i = get(w[s])
                flat.extend((row, s + 1, 1, unknown if i is None or i < 0 else i))
                k = 2
                while i is not None and s + k <= n:
                    i = get(w[s : s + k])
                    if i is not None and i >= 0:
                        flat.extend((row, s + k, k, i))
                    k += 1
        found = np.frombuffer(flat, np.int32).reshape(-1, 4)
        place = found[:, 1].astype(np.int64) * (LONGEST + 1) + found[:, 2]
        order = np.argsort(place, kind="stable")
        self.rows, self.ids, place = found[order, 0], found[order, 3], place[order]
        self.size = len(words)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[starts[1:], len(place)]
        self.cells = [(*divmod(c, LONGEST + 1), a, b) for c, a, b in zip(place[starts].tolist(), starts.tolist(), ends.tolist())]

    def probability(self, p: np.ndarray) -> np.ndarray:
        """p: (pieces + 2, languages). Gives (found pieces, languages)."""
        return p[self.ids]

    def _sums(self, q: np.ndarray, first: int, log: bool) -> np.ndarray:
        out = np.full((self.size, self.n + 1, q.shape[1]), -np.inf if log else 0.0)
        out[:, first] = 0.0 if log else 1.0
        return out

    def forward(self, q: np.ndarray, log: bool = False) -> np.ndarray:
        """Sums over all ways to cut each beginning; with ``log`` q and the sums are logarithms."""
        a = self._sums(q, 0, log)
        for e, k, x, y in self.cells:
            r = self.rows[x:y]
            if log:
                a[r, e] = np.logaddexp(a[r, e], a[r, e - k] + q[x:y])
            else:
                a[r, e] += a[r, e - k] * q[x:y]
        return a

    def backward(self, q: np.ndarray, log: bool = False) -> np.ndarray:
        b = self._sums(q, self.n, log)
        for e, k, x, y in reversed(self.cells):
            r = self.rows[x:y]
            if log:
                b[r, e - k] = np.logaddexp(b[r, e - k], b[r, e] + q[x:y])
            else:
                b[r, e - k] += b[r, e] * q[x:y]
        return b


def batches(words: list[str]) -> Iterator[list[int]]:
    """Places of words of equal length, some 64,000 letters at a time."""
    for n, at in by_length(words).items():
        step = max(1, min(2000, 64000 // n))
        yield from (at[x : x + step] for x in range(0, len(at), step))


def words_of(text: str) -> Counter:
    """Maximal runs of letters, lower case, with their counts; numbers that look like letters end a run."""
    out = Counter(_WORD.findall(text.lower()))
    for w in [w for w in out if not w.isalpha()]:
        n = out.pop(w)
        for x in "".join(c if c.isalpha() else " " for c in w).split():
            out[x] += n
    return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


def fit(counts: list[tuple[str, str, int]], names: list[str], rounds: int = ROUNDS) -> tuple[list[str], dict[str, int], np.ndarray]:
    """(languages, piece numbers, probabilities (pieces + 2, languages)) from (lang, word, count)."""
    langs = sorted({c[0] for c in counts})
    number = {n: i for i, n in enumerate(names)}
    unknown = len(names)
    p = np.zeros((len(names) + 2, len(langs)))
    p[: unknown + 1] = 1.0 / (unknown + 1)
    weight: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for lang, word, n in counts:
        weight["▁" + word][langs.index(lang)] += n
    words = list(weight)
    w = np.array([weight[x] for x in words]).reshape(len(words), len(langs))
    walk = beginnings(number)
    lattices = [(Lattice([words[i] for i in at], number, unknown, walk), np.array(at)) for at in batches(words)]
    for _ in range(rounds):
        expected = np.full(p.shape, 0.02)
        expected[-1] = 0
        for lat, at in lattices:
            log = lat.n > SPAN
            q = lat.probability(p)
            q = np.log(q) if log else q
            a, b = lat.forward(q, log), lat.backward(q, log)
            z = a[:, lat.n]
            for e, k, x, y in lat.cells:
                r = lat.rows[x:y]
                if log:
                    share = np.exp(a[r, e - k] + q[x:y] + b[r, e] - z[r])
                else:
                    share = a[r, e - k] * q[x:y] * b[r, e] / np.maximum(z[r], 1e-300)
                np.add.at(expected, lat.ids[x:y], share * w[at[r]])
        expected[-1] = 0
        p = expected / expected.sum(0)
    return langs, number, p


class Scorer:
    def __init__(self, langs: list[str], number: dict[str, int], p: np.ndarray):
        self.langs, self.number, self.p = langs, number, p
        self.walk = beginnings(number)
        self.known: dict[str, np.ndarray] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        total = np.zeros((len(new), len(self.langs)))
        texts = ["▁" + w for w in new]
        for at in batches(texts):
            lat = Lattice([texts[i] for i in at], self.number, len(self.number), self.walk)
            q = lat.probability(self.p)
            if lat.n > SPAN:
                total[at] = lat.forward(np.log(q), log=True)[:, lat.n]
            else:
                total[at] = np.log(np.maximum(lat.forward(q)[:, lat.n], 1e-290))
        self.known.update(zip(new, total))

    def text(self, words: Counter) -> tuple[str, float]:
        if not words or not self.langs:
            return "und", 0.0
        n = np.fromiter(words.values(), np.float64, len(words))
        s = n @ np.array([self.known[w] for w in words])
        e = np.exp(s - s.max())
        best = int(np.argmax(s))
        return self.langs[best], float(e[best] / e.sum())


def train(docs: DataFrame, train_rows: Column, path: str, sample: int = SAMPLE, words: int = WORDS) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Fit on a bounded hash sample of each language's rows that ``train_rows`` admits."""
    rows = docs.where(train_rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    have = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("have"))  # one row a language
    some = rows.join(F.broadcast(have), "lang").where(hash_unit(F.col("doc_id")) < F.lit(sample) / F.col("have"))
    found = some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "word").count()
    # Each of 64 parts of a language's words gives its most frequent ones; the best of those are the best of all.
    by = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.desc("count"), "word"))
    found = found.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    top = found.withColumn("r", by("part")).where(F.col("r") <= words).withColumn("r", by()).where(F.col("r") <= words)
    return fit([(r["lang"], r["word"], r["count"]) for r in top.select("lang", "word", "count").collect()], pieces(path))


def predict(docs: DataFrame, model: tuple[list[str], dict[str, int], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score; reads doc_id and text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary bounds its size
    key = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _state:
            _state.clear()
            _state[key] = Scorer(*shared.value)
        scorer = _state[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [words_of(t or "") for t in part.column("text").to_pylist()]
                if scorer.langs:
                    scorer.learn(set().union(*texts))
                got = [scorer.text(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return in_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))).mapInArrow(work, "doc_id long, lang_pred string, score double")
