"""Packing documents into token-budget batches behind optimal length buckets.

A global histogram of lengths feeds a dynamic programme that chooses at most ``buckets`` boundaries
so that the tokens of padding, each document padded to its bucket's boundary, are least. The
histogram holds every distinct length, so the longest text bounds it. Batches of at most ``budget`` tokens (a longer document is a batch alone) form inside each
bucket. Numbering has levels: rows are numbered inside hash chunks of bounded size, and totals of
chunks are summed up, ``STEP`` at a time, so that no bucket gathers in one task. Rows that repeat a
doc_id and a length are numbered as one run, which is cut up at the end.

Defined cases: a null or empty text has length 0 and sits in the bucket of its length; ties in the
programme go to the lower boundary; repeated rows are packed each; rows with a null doc_id are
packed too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import id_text, table

BUCKETS, BUDGET, CHUNK, STEP = 16, 65536, 4096, 1024


def word_count(text: Column) -> Column:
    """Whitespace-separated words, without building them: each blank-to-word step counts one."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def boundaries(bins: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper boundaries of least padding from (top, documents, tokens), by dynamic programming."""
    bins = sorted(bins)
    if not bins:
        return []
    top = np.array([b[0] for b in bins], np.float64)
    docs = np.concatenate([[0], np.cumsum([b[1] for b in bins])]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum([b[2] for b in bins])]).astype(np.float64)
    n = len(bins)
    best, cuts = np.full(n + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        # The best cut never moves back as j grows: the middle one bounds those on either side.
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            at = slice(low, min(j - 1, high) + 1)
            cost = best[at] + top[j - 1] * (docs[j] - docs[at]) - (tokens[j] - tokens[at])
            cut[j] = low + int(np.argmin(cost))
            now[j] = cost[cut[j] - low]
            todo += [(a, j - 1, low, int(cut[j])), (j + 1, b, int(cut[j]), high)]
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(top[j - 1]))
        j = int(cut[j])
    return sorted(set(out))


def _offsets(sizes: DataFrame) -> DataFrame:
    """bucket, chunk, before: how many rows of a bucket lie in chunks before, from (bucket, chunk, n)."""
    block = F.floor(F.col("chunk") / STEP).alias("block")
    sizes = table(sizes.select("bucket", "chunk", "n", block), "sizes")
    over = lambda keys, by: F.sum("n").over(Window.partitionBy(*keys).orderBy(by)) - F.col("n")
    blocks = sizes.groupBy("bucket", "block").agg(F.sum("n").alias("n"))
    if not blocks.where("block > 0").isEmpty():
        blocks = _offsets(blocks.select("bucket", F.col("block").alias("chunk"), "n")).select("bucket", F.col("chunk").alias("block"), F.col("before").alias("base"))
    else:
        blocks = blocks.select("bucket", "block", F.lit(0).cast("long").alias("base"))
    return sizes.withColumn("inside", over(["bucket", "block"], "chunk")).join(blocks, ["bucket", "block"]).select("bucket", "chunk", (F.col("base") + F.col("inside")).alias("before"))


def pack(rows: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``rows``: doc_id, n_tokens. Adds bucket int, padded_len long, batch_id long, slot long."""
    rows = table(rows.select("doc_id", "n_tokens"), "lengths")
    bins = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).collect()
    tops = boundaries([(r["n_tokens"], r["docs"], r["n_tokens"] * r["docs"]) for r in bins], buckets) or [0]
    total = sum(r["docs"] for r in bins)
    chunks = max(1, -(-total // CHUNK))
    edge, number = F.lit(tops[-1]), F.lit(len(tops) - 1)
    for i in range(len(tops) - 2, -1, -1):
        edge = F.when(F.col("n_tokens") <= tops[i], F.lit(tops[i])).otherwise(edge)
        number = F.when(F.col("n_tokens") <= tops[i], F.lit(i)).otherwise(number)
    alike = rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    keyed = alike.select("doc_id", "n_tokens", "n", number.cast("int").alias("bucket"), edge.cast("long").alias("padded_len"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(chunks)).alias("chunk"))
    keyed = table(keyed, "keyed")
    before = _offsets(keyed.groupBy("bucket", "chunk").agg(F.sum("n").alias("n")))
    inside = F.sum("n").over(Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")) - F.col("n")
    numbered = keyed.withColumn("inside", inside).join(before, ["bucket", "chunk"])
    numbered = numbered.select("doc_id", "n_tokens", "bucket", "padded_len", (F.col("before") + F.col("inside")).alias("first"), "n")
    # A long run of equal rows goes out in parts of ``CHUNK``, dealt to all tasks.
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))
    parts = numbered.where(F.col("n") > CHUNK).withColumn("skip", F.explode(starts))
    parts = parts.withColumn("first", F.col("first") + F.col("skip")).withColumn("n", F.least(F.lit(CHUNK), F.col("n") - F.col("skip"))).drop("skip")
    runs = numbered.where(F.col("n") <= CHUNK).unionByName(parts.repartition(F.col("first")))
    out = runs.withColumn("at", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_len"), F.lit(1)))).cast("long")
    out = out.withColumn("fits", fits)
    return out.select("doc_id", "n_tokens", "bucket", "padded_len", F.floor(F.col("at") / F.col("fits")).cast("long").alias("batch_id"), F.pmod("at", "fits").cast("long").alias("slot"))


def lengths(docs: DataFrame) -> DataFrame:
    return id_text(docs).select("doc_id", word_count(F.col("text")).alias("n_tokens"))
