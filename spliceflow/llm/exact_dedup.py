"""Exact deduplication screened by static binary-fuse filters.

A *snapshot* is an immutable set of digests in hash buckets; each bucket carries one 8-bit
three-wise binary-fuse filter, built once. An incoming batch is first grouped by digest on its
own, then its digests are screened bucket by bucket; only positives join the exact buckets, and
the texts of every group of two or more are compared byte by byte (they are the grouping key of a
partially aggregated count). A digest with two different texts raises an error.

Defined cases: a null text is the empty text; rows with a null doc_id are grouped like others but
never stay while another row of the group has an id; repeated rows count as separate rows of a
group; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import ascii_lower, id_text, table

#: Digests a bucket holds on average; a bucket is one task's work.
KEYS_PER_BUCKET = 4096
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


class FuseFilter:
    """Three-wise binary-fuse filter over 64-bit keys; about 1/256 false positives, no false negatives."""

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) % np.uint64(starts * segment)).astype(np.int64)
        base = first - first % segment
        at = np.empty((3, len(keys)), np.int64)
        at[0] = first
        at[1] = base + segment + ((h >> np.uint64(16)) % np.uint64(segment)).astype(np.int64)
        at[2] = base + 2 * segment + (h % np.uint64(segment)).astype(np.int64)
        return at, (_mix(h, 7) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(3, int(np.log2(max(n, 1)) * 0.55 + 1))
        for seed in range(64):
            size = max(1.125, 1.25 + 0.02 * seed) * n + 32 + 3 * segment
            starts = max(1, int(np.ceil(size / segment)) - 2)
            at, mark = cls._places(keys, seed, segment, starts)
            slots = np.zeros((starts + 2) * segment, np.uint8)
            order = cls._peel(at, len(slots))
            if order is not None:
                for who, slot in reversed(order):
                    slots[slot] = 0
                    slots[slot] = mark[who] ^ slots[at[0, who]] ^ slots[at[1, who]] ^ slots[at[2, who]]
                return cls(seed, segment, slots)
        raise RuntimeError("no seed peels this bucket")

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot each alone holds); None when a core stays."""
        n = at.shape[1]
        ids = np.arange(n, dtype=np.float64)
        degree = np.bincount(at.ravel(), minlength=size)
        total = np.bincount(at.ravel(), weights=np.tile(ids, 3), minlength=size)
        left, order = n, []
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                return None
            who, pick = np.unique(total[alone].astype(np.int64), return_index=True)
            order.append((who, alone[pick]))
            gone = at[:, who].ravel()
            degree = degree - np.bincount(gone, minlength=size)
            total = total - np.bincount(gone, weights=np.tile(who.astype(np.float64), 3), minlength=size)
            left -= len(who)
        return order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._places(keys.astype(np.uint64), self.seed, self.segment, len(self.slots) // self.segment - 2)
        return mark == (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]])


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), ">u8").astype(np.uint64)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(_keys(group["digest"]))
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "slots": [f.slots.tobytes()]})


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if batch.empty or filters.empty:
        return pd.DataFrame({"digest": pd.Series([], dtype=object)})
    row = filters.iloc[0]
    f = FuseFilter(int(row["seed"]), int(row["segment"]), np.frombuffer(row["slots"], np.uint8))
    return batch.loc[f.contains(_keys(batch["digest"])), ["digest"]]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary) of each row; the digest is SHA-256 of the normalised text."""
    return id_text(docs).select("doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"))


def groups(keys: DataFrame) -> DataFrame:
    """One row per digest: keep_id, size."""
    return keys.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))


class Snapshot:
    """Immutable digest groups and the filters over them, both as tables in the shared folder."""

    def __init__(self, exact: DataFrame, filters: DataFrame, buckets: int):
        self.exact, self.filters, self.buckets = exact, filters, buckets

    @staticmethod
    def bucket(buckets: int):
        return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")

    @classmethod
    def freeze(cls, exact: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> Snapshot:
        exact = table(exact, "snapshot")
        buckets = max(1, -(-exact.count() // keys_per_bucket))
        made = (
            exact.select("digest", cls.bucket(buckets).alias("bucket")).groupBy("bucket")
            .applyInPandas(_build, "bucket int, seed int, segment int, slots binary")
        )
        return cls(exact, table(made, "filters"), buckets)

    def positives(self, batch: DataFrame) -> DataFrame:
        """The batch's digests that a filter lets through."""
        keyed = batch.select("digest", self.bucket(self.buckets).alias("bucket"))
        return keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(_screen, "digest binary")


def same_bytes(docs: DataFrame, dup: DataFrame) -> DataFrame:
    """(digest, texts): the number of different normalised texts behind each digest of ``dup``."""
    text = id_text(docs).select(ascii_lower(F.col("text")).alias("norm"))
    text = text.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    some = text.join(dup.select("digest"), "digest", "left_semi").select(F.hex("digest").alias("key"), "norm")
    return some.groupBy("key", "norm").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("texts")).select(F.unhex("key").alias("digest"), "texts")


def exact_dedup(docs: DataFrame, split: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with doc_id up to ``split`` (half of the id range where it is None) are the snapshot, the
    others the incoming batch. A group's row with the largest doc_id stays.
    """
    keys = table(digests(docs), "digests")
    if split is None:
        low, high = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
        split = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(split), F.lit(True))
    snapshot = Snapshot.freeze(groups(keys.where(old)))
    batch = table(groups(keys.where(~old)), "batch")
    hit = snapshot.positives(batch).join(snapshot.exact, "digest").select("digest", F.col("keep_id").alias("was_id"), F.col("size").alias("was"))
    hit = table(hit, "hits")
    classes = batch.join(hit, "digest", "left").select(
        "digest", F.greatest("keep_id", "was_id").alias("keep_id"), (F.col("size") + F.coalesce("was", F.lit(0))).alias("size")
    ).unionByName(snapshot.exact.join(hit.select("digest"), "digest", "left_anti").select("digest", "keep_id", "size"))
    classes = table(classes, "classes")
    checked = same_bytes(docs, classes.where("size > 1"))
    classes = classes.join(checked, "digest", "left").select(
        "digest", "keep_id",
        F.when(F.coalesce("texts", F.lit(1)) == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("long")).alias("group_size"),
    )
    classes = table(classes, "checked")  # joined from a table, a large group's rows can be split
    return keys.join(classes, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
