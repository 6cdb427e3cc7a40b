"""N-gram Jaccard join: a grouped prefix join over word shingles, and its connected components.

1. A bounded list of frequent shingles (``HEAVY``) fixes one order of all shingles, rare ones first.
   The list shapes cost alone: any order gives the same links.
2. A document's prefix is its first shingles in that order, so many that linked documents share one.
   Documents with one set are one *class*; classes with identical prefix and size are one *group*.
3. Groups meet on prefix shingles under the size and position filters. First each group is held
   against the leader it shares most shingles with, and members against their group's first one;
   pairs whose set bitmaps differ too much go, and links come from comparing whole shingle sets.
4. Pairs left to look at lie between components found so far: posting lists, reduced to the
   different (size, position, component) they hold, are filtered pair by pair, expanded to members
   and verified. A pair inside one component can no longer change the result.

Defined cases: a null or wordless text has 0 shingles and is its own component; rows that repeat a
doc_id are one document; rows with a null doc_id keep their shingle count and get a null component;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import id_text, in_batches, table
from spliceflow.llm.components import connected_components
from spliceflow.llm.shingles import shingles

#: Most frequent shingles kept in the order's list, and counters a task holds while it looks for them.
HEAVY, COUNTERS = 1 << 20, 1 << 21
_state: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def heavy_shingles(docs: DataFrame, width: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most ``most`` frequent shingles."""

    def merge(keys: np.ndarray, counts: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, n = np.unique(np.concatenate(parts), return_counts=True)
        k = np.concatenate([keys, u])
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        c = np.add.reduceat(np.concatenate([counts, n])[order], first)
        k = k[first]
        if len(k) > COUNTERS:
            kept = c > np.partition(c, len(c) - COUNTERS)[len(c) - COUNTERS]
            k, c = k[kept], c[kept]
        return k, c

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in _texts(batch.slice(at, 512)):
                    parts.append(shingles(text, width))
                    held += len(parts[-1])
                if held > COUNTERS:
                    keys, counts = merge(keys, counts, parts)
                    parts, held = [], 0
        if held:
            keys, counts = merge(keys, counts, parts)
        often = np.flatnonzero(counts >= 2)
        if len(often) > most:
            often = often[np.argpartition(-counts[often], most)[:most]]
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["h", "n"])

    # The more texts a task counts, the rarer the shingles it sees twice; all cores still have work.
    rows = id_text(docs).select("text")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // 8))
    found = in_batches(rows.coalesce(tasks)).mapInArrow(work, "h long, n long")
    found = table(found.groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    # A histogram over eighths of powers of two gives the least count that keeps the list within ``most``.
    step = F.floor(F.log2("n") * 8).cast("int")
    floor, kept = 1 << 30, 0
    for r in sorted(found.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        kept += r["count"]
        if kept > most:
            break
        floor = r["step"]
    top = found.where(step >= floor).toArrow()
    keys = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    counts = top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def ordered(grams: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rare shingles first; among those not listed, and on ties, by hash."""
    keys, counts = heavy
    weight = np.zeros(len(grams), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        weight = np.where(keys[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, weight))]


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each of 2n to 4n bits."""
    size = max(64, 1 << int(2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_shared(na: int, a: bytes, nb: int, b: bytes) -> int:
    """An upper bound of the intersection: each differing parity is a shingle of one set alone."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def sets(docs: DataFrame, width: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, fp (of the set), gk (of prefix and size), bits, prefix array<long>; without shingles all from fp on are null."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # HEAVY entries of 16 bytes at most
    key = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _state:
            _state.clear()
            _state[key] = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, fp, gk, bits, prefix = [], [], [], [], []
                for text in _texts(part):
                    grams = shingles(text, width)
                    n.append(len(grams))
                    if len(grams):
                        head = ordered(grams, _state[key])[: len(grams) - -(-num * len(grams) // den) + 1].view(np.int64)
                        fp.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                        gk.append(hashlib.blake2b(head.tobytes() + len(grams).to_bytes(8, "little"), digest_size=16).digest())
                        bits.append(bitmap(grams))
                        prefix.append(head)
                    else:
                        fp.append(None), gk.append(None), bits.append(None), prefix.append(None)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(gk, pa.binary()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp", "gk", "bits", "prefix"])

    return in_batches(id_text(docs)).mapInArrow(work, "doc_id long, n long, fp binary, gk binary, bits binary, prefix array<long>")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int, name: str) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets meet the threshold."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                (r["a"], r["b"]) for r in batch.to_pylist()
                if (num + den) * most_shared(r["na"], r["ba"], r["nb"], r["bb"]) >= num * (r["na"] + r["nb"])
            ]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ba", "nb", "bb")
    pairs = table(in_batches(pairs).mapInArrow(likely, "a long, b long"), f"{name}-pairs")
    need = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = table(id_text(docs).join(need, "doc_id", "left_semi"), f"{name}-texts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                ta, tb = part.column("ta").to_pylist(), part.column("tb").to_pylist()
                kept = []
                for i in range(len(a)):
                    if last is None or ta[i] != last:
                        last, left = ta[i], shingles(ta[i], width)
                    right = shingles(tb[i], width)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if both and den * both >= num * (len(left) + len(right) - both):
                        kept.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], ["a", "b"])

    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return table(in_batches(both.select("a", "b", "ta", "tb")).mapInArrow(work, "a long, b long"), f"{name}-links")


def _passes(na: Column, pa_: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Size and position filter at a shared shingle."""
    need = F.ceil((F.lit(num) * (na + nb)) / F.lit(num + den) - F.lit(1e-9))
    return (F.lit(den) * F.least(na, nb) >= F.lit(num) * F.greatest(na, nb)) & (F.lit(1) + F.least(na - pa_, nb - pb) - 1 >= need)


def components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id; documents link when den * intersection >= num * union."""
    all_sets = table(sets(docs, width, num, den, heavy_shingles(docs, width)), "sets")
    full = all_sets.where(F.col("n") > 0).where(F.col("doc_id").isNotNull())
    classes = table(full.groupBy("fp", "gk", "n", "bits").agg(F.min("doc_id").alias("rep")), "classes")
    groups = full.groupBy("gk", "n", "prefix").agg(F.min("doc_id").alias("gid"))
    groups = table(groups, "groups")
    members = table(classes.join(groups.select("gk", "gid"), "gk").select("rep", "gid", "n"), "members")

    posting = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posting.select("token").groupBy("token").count().where("count > 1").select("token")
    posting = table(posting.join(shared, "token", "left_semi").select("token", "gid", "n", "pos"), "posting")
    leader = posting.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("l"))
    met = posting.join(leader, "token").where(F.col("gid") != F.col("l.gid")).where(_passes(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), num, den))
    votes = met.groupBy("gid", F.col("l.gid").alias("lead")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("gid").agg(F.max(F.struct("votes", (-F.col("lead")).alias("m"))).alias("x")).select(F.col("gid").alias("a"), (-F.col("x.m")).alias("b"))
    inside = members.where("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b"))
    first = verify(best.unionByName(inside), classes, docs, width, num, den, "first")
    known = table(connected_components(first), "known")

    parts = members.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left")
    parts = table(parts.select("rep", "gid", "n", F.coalesce("component", "rep").alias("component")), "parts")
    part = parts.select("gid", "component").distinct()
    lists = table(posting.join(part, "gid").select("token", "n", "pos", "component", "gid"), "lists")
    cells = lists.select("token", "n", "pos", "component").distinct()
    mixed = lists.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    cells = table(cells.join(mixed, "token", "left_semi"), "cells")
    left = cells.select("token", *(F.col(c).alias(f"{c}_a") for c in ("n", "pos", "component")))
    right = cells.select("token", *(F.col(c).alias(f"{c}_b") for c in ("n", "pos", "component")))
    near = left.join(right, "token").where(F.col("component_a") < F.col("component_b"))
    near = table(near.where(_passes(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), num, den)), "near")
    side = lambda s: lists.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "component", "gid")))
    pairs = near.join(side("a"), ["token", "n_a", "pos_a", "component_a"]).join(side("b"), ["token", "n_b", "pos_b", "component_b"])
    pairs = pairs.select("gid_a", "component_a", "gid_b", "component_b").distinct()
    mixed_groups = part.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gid")
    split = part.join(mixed_groups, "gid", "left_semi")
    within = split.select("gid", F.col("component").alias("component_a")).join(split.select("gid", F.col("component").alias("component_b")), "gid").where("component_a < component_b")
    pairs = pairs.unionByName(within.select(F.col("gid").alias("gid_a"), "component_a", F.col("gid").alias("gid_b"), "component_b"))
    who = lambda s, to: parts.select(F.col("gid").alias(f"gid_{s}"), F.col("component").alias(f"component_{s}"), F.col("rep").alias(to))
    pairs = pairs.join(who("a", "a"), ["gid_a", "component_a"]).join(who("b", "b"), ["gid_b", "component_b"]).select("a", "b")
    second = verify(pairs, classes, docs, width, num, den, "second")

    final = connected_components(first.unionByName(second))
    named = classes.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = table(named, "named")
    rest = all_sets.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "fp").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rest)
