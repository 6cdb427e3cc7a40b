"""Fragment absorption: order-dependent, so a gene is one group of the kernel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.operators import groups


def _contained(a: dict, b: dict, wobble: int, ends: int, percent: int) -> tuple[int, int] | None:
    """New outer bounds of ``a`` when it holds the shorter model ``b``."""
    (sa, ea), (sb, eb) = (a["s"], a["e"]), (b["s"], b["e"])
    if len(sa) == 1 and len(sb) == 1:
        first, other = (a, b) if sa[0] <= sb[0] else (b, a)
        overlap = first["e"][0] - other["s"][0]
        if overlap < 0:
            return None
        shares = (overlap * 100 // (ea[0] - sa[0]), overlap * 100 // (eb[0] - sb[0]))
        return (min(sa[0], sb[0]), max(ea[0], eb[0])) if max(shares) > percent else None
    last = len(sa) - 1
    if len(sb) == 1:
        # Inside any one exon, but for a little; the outer bounds of the model allow for more.
        held = [
            i for i in range(len(sa))
            if sa[i] < eb[0] and sb[0] < ea[i] and sa[i] - sb[0] < (ends if i == 0 else wobble) and eb[0] - ea[i] < (ends if i == last else wobble)
        ]
        if not held:
            return None
        return min(sa[0], sb[0]) if 0 in held else sa[0], max(ea[-1], eb[0]) if last in held else ea[-1]
    # The shorter model's first junction is one of the longer one's, or nothing holds.
    if not any(-wobble <= x - eb[0] <= wobble for x in ea):
        return None
    starts, stops = [], []
    for i in range(len(sa)):
        for j in range(len(sb)):
            if sa[i] <= eb[j] and sb[j] <= ea[i]:
                outer = j == 0, j == len(sb) - 1
                up, down = sa[i] - sb[j], eb[j] - ea[i]
                if (up if outer[0] else abs(up)) <= (ends if outer[0] and i == 0 else wobble):
                    starts.append((i, j))
                if (down if outer[1] else abs(down)) <= (ends if outer[1] and i == last else wobble):
                    stops.append((i, j))
    # Both edges of each exon of the shorter model are met, by exons of the longer one that follow each other.
    mine, theirs = ([{x[k] for x in edges} for edges in (starts, stops)] for k in (0, 1))
    if mine[0] != mine[1] or theirs[0] != theirs[1] or theirs[0] != set(range(len(sb))):
        return None
    if max(mine[0]) - min(mine[0]) + 1 != len(mine[0]) or (len(sa) == len(sb) and len(mine[0]) != len(sa)):
        return None
    return min(sa[0], sb[0]), max(ea[-1], eb[-1])


def absorb(rows: list[dict], wobble: int = 10, ends: int = 500, percent: int = 20) -> dict:
    """Removed id -> id that absorbed it; the absorbing row's bounds change as it goes. Each row meets
    those that overlap it, in order, and again those behind once its own bounds have grown."""
    gone: dict = {}
    left, right = np.array([x["s"][0] for x in rows]), np.array([x["e"][-1] for x in rows])
    size = lambda x: (len(x["s"]), x["e"][-1] - x["s"][0], -x["s"][0])

    def met(i: int, after: int) -> list[int]:
        return (np.flatnonzero((left[after:] <= right[i]) & (right[after:] >= left[i])) + after).tolist()

    for i, a in enumerate(rows):
        todo = met(i, 0) if a["tx"] not in gone else []
        while todo:
            for j in todo:
                b = rows[j]
                if i == j or b["tx"] in gone:
                    continue
                at, to = (i, j) if size(a) >= size(b) else (j, i)
                long, short = rows[at], rows[to]
                if (bounds := _contained(long, short, wobble, ends, percent)) is not None:
                    gone[short["tx"]] = long["tx"]
                    long["s"][0], long["e"][-1] = bounds
                    grown = (left[at], right[at]) != bounds
                    left[at], right[at] = bounds
                    if at != i or grown:
                        todo = met(i, j + 1) if at == i else []
                        break
            else:
                todo = []
    return gone


def absorb_fragments(models: DataFrame, wobble: int = 10, ends: int = 500, percent: int = 20, n_rows: int | None = None) -> DataFrame:
    """``models``: gene, tx, starts, ends. Adds absorbed_by (null for rows that stay) and final bounds."""

    def work(gene: list[tuple]) -> list[tuple]:
        rows = [{"tx": t, "s": s, "e": e} for _, t, s, e in gene]
        gone = absorb(rows, wobble, ends, percent)
        return [(gene[0][0], r["tx"], gone.get(r["tx"]), r["s"][0], r["e"][-1]) for r in rows]

    kind = models.schema["gene"].dataType.simpleString()
    rows = models.select("gene", F.col("tx").cast("long").alias("tx"), *(F.col(c).cast("array<long>").alias(c) for c in ("starts", "ends")))
    return groups.each(groups.dealt(rows, n_rows, "gene"), "gene", ["tx"], work, f"gene {kind}, tx long, absorbed_by long, start long, end long")
