"""Toxicity scoring behind a noisy-channel decoder.

Writers hide words by look-alike symbols, by blanks or dots between letters and by repeating
letters. Each suspicious token becomes a lattice in which a symbol may stand for the letters it
resembles, a separator for nothing and a run of one letter for one or two of it; a Viterbi search
under a character trigram model picks the cheapest reading, whatever the token's length. Where
letters are set apart by separators, a second search may also read one as the end of a word. The
restored words of both readings then go to a linear model over words and word beginnings.

The character model counts the words (of two letters or more: single ones are mostly parts of
disguised words) of all texts. The linear model is fitted on a bounded sample of labelled rows
(``SAMPLE`` toxic ones and twice as many clean ones); every text is scored whole.

Defined cases: a null or empty text, and every text when no labelled row exists, gets the score of
no evidence (below 0.5); a label other than 0 or 1 is ignored; of clashing labels of one doc_id the
toxic one counts; repeated rows give repeated results; rows with a null doc_id stay; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import hash_unit, in_batches, sample_rate, table

SAMPLE, FEATURES = 4000, 3000
REMEMBERED, SHORT, BREAK = 80_000, 64, 1.0
# The letters that a symbol may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "£": "l", "€": "e",
}
SEPARATORS = " .-_*~'"
_EDGE = " .,;:?\"'()[]{}<>!|*-_~«»¿¡…"
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){2,}(?!\w)")
_REPEAT = re.compile(r"(.)\1\1")
_HAS_LOOK = re.compile("[" + re.escape("".join(LOOKS)) + "]")
_LETTER = re.compile(r"[^\W\d_]")


class CharModel:
    """Trigram letter model with add-constant smoothing, from word counts."""

    def __init__(self, words: dict[str, int]):
        three: dict[str, float] = defaultdict(float)
        for w, n in words.items():
            s = "^^" + w + "$"
            for i in range(2, len(s)):
                three[s[i - 2 : i + 1]] += n
        self._count(three)

    @classmethod
    def counted(cls, three: dict[str, float]) -> "CharModel":
        """From the counts of trigrams of ``^^word$``."""
        model = cls.__new__(cls)
        model._count(three)
        return model

    def _count(self, three: dict[str, float]) -> None:
        two: dict[str, float] = defaultdict(float)
        for t, n in three.items():
            two[t[:2]] += n
        self.three, self.two, self.size = dict(three), dict(two), len(set("".join(three)) - set("^$")) + 2

    def cost(self, context: str, char: str) -> float:
        return -math.log((self.three.get(context + char, 0.0) + 0.1) / (self.two.get(context, 0.0) + 0.1 * self.size))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each step the readings (letters, channel cost); a run of three or more is one step."""
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        read = [(x, 0.7) for x in LOOKS.get(c, "")]
        if c.isalpha():
            read = [(c, 0.0), *read]
        elif c in SEPARATORS:
            read.append(("", 0.2))
        elif not read:
            read = [(c, 3.0)]
        else:
            read.append((c, 4.0))
        if n >= 3:
            steps.append([(x, k) for x, k in read] + [(x + x, k + 0.5) for x, k in read if x])
        else:
            steps.extend([read] * n)
        i += n
    return steps


def decode(token: str, model: CharModel, breaks: bool = False) -> str:
    """The cheapest reading of a token; with ``breaks`` a separator may also end a word, which gives a blank."""
    beam, back = {"^^": 0.0}, []
    for read in lattice(token):
        if breaks and ("", 0.2) in read:
            read = [*read, (" ", BREAK)]
        after: dict[str, float] = {}
        came: dict[str, tuple[str, str]] = {}
        for context, cost in beam.items():
            for letters, extra in read:
                c, total = context, cost + extra
                if letters == " ":
                    c, total = "^^", total + model.cost(c, "$")
                else:
                    for x in letters:
                        total += model.cost(c, x)
                        c = c[1] + x
                if c not in after or total < after[c]:
                    after[c], came[c] = total, (context, letters)
        beam = after
        back.append(came)
    c = min(beam, key=lambda c: (beam[c] + model.cost(c, "$"), c))
    out = []
    for came in reversed(back):
        c, letters = came[c]
        out.append(letters)
    return "".join(reversed(out))


def suspicious(core: str) -> bool:
    return bool(_LETTER.search(core)) and bool(_REPEAT.search(core) or _HAS_LOOK.search(core) or any(s in core for s in "*_~"))


class Restorer:
    """Token -> restored words; remembers the short ones it has seen."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def read(self, disguised: str) -> tuple[str, ...]:
        """The reading as one word and, if separators allow others, the words of the reading with word ends."""
        one = decode(disguised, self.model)
        if not any(c in SEPARATORS for c in disguised):
            return (one,)
        return (one, *decode(disguised, self.model, breaks=True).split())

    def token(self, raw: str) -> tuple[str, ...]:
        got = self.known.get(raw)
        if got is None:
            core = raw.strip(_EDGE)
            got = self.read(core) if suspicious(core) else (core,)
            if len(raw) <= SHORT:  # a longer one is read anew each time
                if len(self.known) > REMEMBERED:
                    self.known = {}
                self.known[raw] = got
        return got

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out = {w for t in set(low.split()) for w in self.token(t)}
        for m in _SPACED.finditer(low):
            out.update(self.read(m[0]))
        out.discard("")
        return out


def features(word: str) -> list[str]:
    """The word, and its beginnings of three to six letters."""
    return ["=" + word] + ["^" + word[:k] for k in (3, 4, 5, 6) if len(word) > k]


def fit_linear(names: list[str], docs: list[tuple[int, list[int]]], rounds: int = 1500) -> tuple[dict[str, float], float]:
    """Weights and bias of a ridge-penalised logistic model over 0/1 features."""
    y = np.array([d[0] for d in docs], np.float64)
    rows = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    cols = np.array([c for d in docs for c in d[1]], np.int64)
    w, b, n = np.zeros(len(names)), 0.0, max(1, len(docs))
    g2, b2 = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[cols], minlength=len(docs)) + b
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gw = np.bincount(cols, weights=r[rows], minlength=len(names)) / n + 1e-5 * w
        gb = r.mean() if len(r) else 0.0
        g2 += gw * gw
        b2 += gb * gb
        w -= gw / np.sqrt(g2)
        b -= gb / np.sqrt(b2)
    return {x: float(v) for x, v in zip(names, w) if v}, float(b)


def _map(docs: DataFrame, columns: list[str], schema: str, shared, make, each) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield each(tool, batch.slice(at, 256))

    return in_batches(docs.select(*columns)).mapInArrow(work, schema)


def trigrams(docs: DataFrame) -> DataFrame:
    """t, n: the trigrams of ``^^word$`` over the words of all texts; their number is bounded by the alphabet."""
    found = F.regexp_extract_all(F.lower(F.coalesce(docs["text"].cast("string"), F.lit(""))), F.lit(r"\p{L}{2,}+"), F.lit(0))
    words = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    s = F.concat(F.lit("^^"), F.col("w"), F.lit("$"))
    each = F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(s, i, F.lit(3)))
    return words.select("n", F.explode(each).alias("t")).groupBy("t").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, sample: int = SAMPLE, top: int = FEATURES):
    """(char model of all texts; weights, bias from a bounded sample of labelled rows); ``train_rows`` is over doc_id."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where(train_rows & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(have) < 2:
        return CharModel({}), {}, -4.0
    rate = F.when(F.col("toxic") == 1, sample_rate(have[1], sample)).otherwise(sample_rate(have[0], 2 * sample))
    picked = known.where(hash_unit(F.col("doc_id")) < rate)
    # At most about 3 * sample rows of two numbers.
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = table(rows, "labelled")
    model = CharModel.counted({r["t"]: float(r["n"]) for r in trigrams(docs).collect()})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(tool: Restorer, part: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({f for w in tool.words(t or "") for f in features(w)}) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "found"])

    found = table(_map(rows, ["doc_id", "toxic", "text"], "doc_id long, toxic int, found array<string>", shared, Restorer, each), "found")
    n1, n0 = (found.where(F.col("toxic") == k).count() for k in (1, 0))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    stat = found.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    stat = stat.where((F.col("a") >= 3) & (odds > 1.0)).orderBy((odds * F.sqrt("a")).desc(), "f").limit(top)
    names = [r["f"] for r in stat.select("f").collect()]
    number = {x: i for i, x in enumerate(names)}
    pick = docs.sparkSession.createDataFrame([(x, i) for x, i in number.items()] or [("", -1)], "f string, i int")
    seen = found.select("doc_id", "toxic", F.explode_outer("found").alias("f")).join(F.broadcast(pick), "f", "left").groupBy("doc_id", "toxic").agg(F.collect_set("i").alias("i")).orderBy("doc_id").collect()
    # Clean rows are sampled at another rate than toxic ones; the bias is moved back to their true share.
    weights, bias = fit_linear(names, [(r["toxic"], sorted(r["i"])) for r in seen])
    share = math.log(have[1] / have[0]) - math.log(max(1, n1) / max(1, n0))
    return model, weights, bias + min(0.0, share)


class Scorer(Restorer):
    def __init__(self, model):
        super().__init__(model[0])
        self.weights, self.bias = model[1], model[2]
        self.value: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        found: set[str] = set()
        for w in self.words(text):
            got = self.value.get(w)
            if got is None:
                if len(self.value) > REMEMBERED:
                    self.value = {}
                got = tuple(f for f in features(w) if f in self.weights)
                self.value[w] = got
            found.update(got)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def score(docs: DataFrame, model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted and the columns of ``keep``; reads doc_id and text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the alphabet's trigrams, FEATURES weights
    names = ["doc_id", "score", "predicted", *(keep or [])]

    def each(tool: Scorer, part: pa.RecordBatch) -> pa.RecordBatch:
        got = [tool.score(t or "") for t in part.column("text").to_pylist()]
        made = [part.column("doc_id"), pa.array(got, pa.float64()), pa.array([int(g >= 0.5) for g in got], pa.int32())]
        return pa.RecordBatch.from_arrays([*made, *(part.column(c) for c in names[3:])], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *names[3:])
    schema = ", ".join(["doc_id long, score double, predicted int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names[3:]).schema)])
    return _map(rows, ["doc_id", "text", *names[3:]], schema, shared, Scorer, each)
