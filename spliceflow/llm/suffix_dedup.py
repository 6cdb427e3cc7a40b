"""Removal of repeated 200-byte strings with suffix arrays over shards.

Every window of ``LENGTH`` bytes belongs to the position of the least hash among its ``GRAM``-byte
grams, and windows that belong to one position fall into blocks at fixed distances from it. Equal
windows therefore lie in blocks with an equal core, the bytes that all windows of a block share.
Blocks whose core's hash stands at one place only are done. Of the others, the bytes are cut out,
equal ones are counted, and each shard (a range of cores of bounded size) sorts the suffixes of its
different strings by induction and reads repeats off the common prefixes. A core with more than
``CROWD`` different strings is too much for one shard: its strings are cut into blocks of fewer
windows (``WIDTHS``), which share more bytes, and go through the same again, core by longer core; the
last blocks hold one window and are their own core. Of equal texts one goes through all this; the
others follow it.

Defined cases: a null text is the empty text; a text below ``LENGTH`` bytes keeps all of them; a row
with a null doc_id takes part like others; rows that repeat a doc_id and text are copies; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import in_batches, table
from spliceflow.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM, BLOCK = 200, 40, 96
#: Windows a block of a crowded core has at most, each a divisor of the one before.
WIDTHS = (12, 3, 1)
#: Bytes a shard sorts, on average; different strings of one core beyond which they are cut further.
SHARD, CROWD = 1 << 20, 8192
_B = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for base in (_B, pow(_B, -1, 1 << 64)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def blocks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, first window, last window, place of the core) of each block of a text."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none, none
    with np.errstate(over="ignore"):
        power, back = _power(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * power[:n], out=prefix[1:])
        grams = _mix((prefix[GRAM:] - prefix[:-GRAM]) * back[: n - GRAM + 1])
        span = LENGTH - GRAM + 1
        value, where, width = grams, np.arange(len(grams)), 1
        while width * 2 <= span:
            left = value[:-width] <= value[width:]
            value, where = np.where(left, value[:-width], value[width:]), np.where(left, where[:-width], where[width:])
            width *= 2
        shift = span - width
        if shift:
            where = np.where(value[:-shift] <= value[shift:], where[:-shift], where[shift:])
        first = np.arange(n - LENGTH + 1)
        block = (where - first) // BLOCK
        cut = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (block[1:] != block[:-1])])
        last = np.r_[cut[1:], len(first)] - 1
        core = where[cut] - BLOCK * block[cut]  # the block's last window starts here at most
        size = LENGTH - BLOCK + 1
        h = (prefix[core + size] - prefix[core]) * back[core]
        h = _mix(h + _mix(grams[where[cut]] + block[cut].astype(np.uint64)))
    return h.view(np.int64), cut, last, core


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            got = [blocks((t or "").encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("eid"), part.column("th"), *(pa.array([g[i] for g in got], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32())))],
                ["eid", "th", "core", "lo", "hi"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted block."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            core, eid, th, lo, bits = [], [], [], [], []
            for t, wanted, e, x in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), part.column("eid").to_pylist(), part.column("th").to_pylist()):
                data = (t or "").encode()
                for w in wanted:
                    core.append(w["core"]), eid.append(e), th.append(x), lo.append(w["lo"])
                    bits.append(data[w["lo"] : w["hi"] + LENGTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(core, pa.int64()), pa.array(eid, pa.int64()), pa.array(th, pa.int64()), pa.array(lo, pa.int32()), pa.array(bits, pa.binary())], ["core", "eid", "th", "lo", "bits"]
            )


def repeated(strings: list[bytes]) -> list[np.ndarray]:
    """For each string the flags of its windows that also start elsewhere among all of them."""
    if not strings:
        return []
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    size = np.array([len(x) for x in strings])
    start = np.cumsum(np.r_[0, size[:-1] + 1])
    s = data.astype(np.int64) + 2
    s[start + size] = 1
    sa = suffix_array(np.r_[s, 0], 258)[1:]
    ok = np.zeros(len(data), np.int64)
    np.add.at(ok, start, 1)
    np.add.at(ok, start + size - LENGTH + 1, -1)
    hit = common_prefixes(data, sa, np.cumsum(ok) > 0, LENGTH)
    return [hit[a : a + n - LENGTH + 1] for a, n in zip(start, size)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of set flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def _sort_shard(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    strings = [bytes(x) for x in group["bits"]]
    for core, sid, flags in zip(group["core"], group["sid"], repeated(strings)):
        out += [(core, sid, a, b) for a, b in runs(flags)]
    return pd.DataFrame(out, columns=["core", "sid", "a", "b"])


def _split(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts strings of one block each into blocks of ``width`` windows at fixed distances from their core."""

    def cut(core: int, bits: bytes) -> Iterator[tuple[int, int, bytes]]:
        place = int(blocks(bits)[3][0])
        for k in range((place - (len(bits) - LENGTH)) // width, place // width + 1):
            first, last = max(0, place - k * width - width + 1), min(len(bits) - LENGTH, place - k * width)
            shared = bits[place - k * width : place - k * width - width + 1 + LENGTH]
            key = hashlib.blake2b(shared, digest_size=8, key=core.to_bytes(8, "little", signed=True) + bytes([k]))
            yield int.from_bytes(key.digest(), "little", signed=True), first, bits[first : last + LENGTH]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                got = [(c, s, *x) for c, s, bits in zip(*(batch.column(n).to_pylist() for n in ("core", "sid", "bits"))) for x in cut(c, bits)]
                cols = zip(*got) if got else [[]] * 5
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["of", "part", "core", "skip", "bits"])

    return work


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            size, removed, spans, digest, kept_text = [], [], [], [], []
            for t, copy, found in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), part.column("found").to_pylist()):
                data = (t or "").encode()
                size.append(len(data))
                cover = np.zeros(len(data) + 1, np.int32)
                if copy and copy > 1 and len(data) >= LENGTH:
                    cover[0], cover[-1] = 1, -1
                for r in found or ():
                    cover[r["first"]] += 1
                    cover[r["last"] + LENGTH] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum())), spans.append(len(runs(gone))), digest.append(hashlib.sha256(kept).hexdigest()), kept_text.append(kept)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(kept_text, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def identified(docs: DataFrame) -> DataFrame:
    """eid (doc_id, or for a null one a number drawn from the text), th (hash of the text), doc_id, text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    th = F.xxhash64(text)
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.pmod(th, F.lit(1 << 61)) - F.lit(1 << 62)).alias("eid"), th.alias("th"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies per (eid, th), runs of repeated windows per (eid, th) of the texts that stand for equal ones)."""
    rows = identified(docs)
    whole = rows.select("eid", "th", F.sha2("text", 256).alias("sha"))
    per = whole.groupBy("sha", "th").agg(F.min("eid").alias("eid"), F.count(F.lit(1)).alias("copies"))
    classes = table(per, "classes")
    found = table(in_batches(rows.select("eid", "th", "text")).mapInArrow(_find, "eid long, th long, core array<long>, lo array<int>, hi array<int>"), "blocks")
    flat = found.select("eid", "th", F.explode(F.arrays_zip("core", "lo", "hi")).alias("x")).select("eid", "th", "x.core", "x.lo", "x.hi")
    place = F.xxhash64("th", "lo")
    twice = flat.select("core", place.alias("p")).groupBy("core").agg(F.min("p").alias("x"), F.max("p").alias("y")).where("x <> y").select("core")
    twice = table(twice, "twice")  # joined from a table, a frequent core's rows can be split
    hits = table(flat.join(twice, "core", "left_semi"), "hits")
    wanted = hits.join(classes.select("eid", "th"), ["eid", "th"], "left_semi").distinct()
    wanted = table(wanted.groupBy("eid", "th").agg(F.collect_list(F.struct("core", "lo", "hi")).alias("wanted")), "wanted")
    cut = in_batches(rows.select("eid", "th", "text").join(wanted, ["eid", "th"])).mapInArrow(_cut, "core long, eid long, th long, lo int, bits binary")
    marks = marked(cut, ["eid", "th", "lo"], WIDTHS)
    at = marks.select("eid", "th", F.struct((F.col("lo") + F.col("a")).alias("first"), (F.col("lo") + F.col("b")).alias("last")).alias("r")).distinct()
    return classes, at.groupBy("eid", "th").agg(F.collect_list("r").alias("found"))


def marked(cut: DataFrame, place: list[str], widths: tuple[int, ...]) -> DataFrame:
    """The columns of ``place``, a, b: runs of repeated windows in each string of ``cut`` (place, core, bits)."""
    cut = table(cut, "cuts").withColumn("sid", F.unhex(F.md5("bits")))
    # A repeated row is cut repeatedly; its places count once.
    at = F.xxhash64(*place)
    kinds = cut.select("core", "sid", "bits", at.alias("p")).groupBy("core", "sid", "bits").agg(F.min("p").alias("x"), F.max("p").alias("y"))
    kinds = table(kinds.select("core", "sid", "bits", (F.col("x") != F.col("y")).alias("many")), "kinds")
    per_core = table(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cores")
    most = F.lit(CROWD if widths else 1 << 62)
    few = table(kinds.join(per_core.where(F.col("n") <= most), "core", "left_semi"), "few")
    total = few.agg(F.sum(F.length("bits"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("core"), F.lit(max(1, -(-int(total) // SHARD)))).cast("int")
    found = few.select("core", "sid", "bits", shard.alias("shard")).groupBy("shard").applyInPandas(_sort_shard, "core long, sid binary, a int, b int")
    found = found.unionByName(kinds.where("many").select("core", "sid", F.lit(0).alias("a"), (F.length("bits") - LENGTH).cast("int").alias("b")))
    crowds = per_core.where(F.col("n") > most)
    if not crowds.isEmpty():
        crowd = kinds.join(crowds, "core", "left_semi").select("core", "sid", "bits")
        parts = in_batches(crowd).mapInArrow(_split(widths[0]), "of long, part binary, core long, skip int, bits binary")
        parts = marked(parts, ["of", "part", "skip"], widths[1:])
        found = found.unionByName(parts.select(F.col("of").alias("core"), F.col("part").alias("sid"), (F.col("skip") + F.col("a")).alias("a"), (F.col("skip") + F.col("b")).alias("b")))
    return cut.select(*place, "core", "sid").join(table(found, "marks"), ["core", "sid"]).select(*place, "a", "b")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    classes, found = repeats(docs)
    found = table(found, "found")
    rows = identified(docs)
    # Copies of a text that stands elsewhere carry no runs of their own: all of it goes if it is long enough.
    lone = classes.where("copies = 1").select("eid", "th").join(found, ["eid", "th"], "left").select("eid", "th", F.lit(1).cast("long").alias("copies"), "found")
    joined = rows.join(lone, ["eid", "th"], "left").select("doc_id", "text", F.coalesce("copies", F.lit(2)).alias("copies"), "found")
    return in_batches(joined).mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
