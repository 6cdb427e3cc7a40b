"""Grouping of reads whose 5' end may be missing: order-dependent, one gene a group of the kernel."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators import groups, loci

DIFFERENT, EQUAL, SHORTENED = 0, 1, 2


def relation(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]], five: int, junction: int, three: int) -> int:
    """How two models relate; each is (5' edges, 3' edges) from the 3' end on, as if on the plus strand.

    EQUAL: as many exons; SHORTENED: the one with fewer lacks 5' exons. All edges but the outermost 5'
    one must match, and that one may differ as long as the longer model is the one that goes on.
    """
    (p5, p3), (q5, q3) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    last, even = len(q5) - 1, len(p5) == len(q5)
    apart = False
    for i in range(last + 1):
        if p5[i] >= q3[i] or q5[i] >= p3[i]:
            if i == last:
                return DIFFERENT
            apart = True
        elif abs(p3[i] - q3[i]) > (three if i == 0 else junction) or (i < last and abs(p5[i] - q5[i]) > junction):
            return DIFFERENT
    ahead = q5[last] - p5[last]
    if abs(ahead) <= (five if even else junction):
        if apart:
            return DIFFERENT
        return EQUAL if even else SHORTENED
    # A pair of small exons that lie apart no longer counts once the outermost edge decides.
    if even:
        return EQUAL
    return SHORTENED if ahead > 0 else DIFFERENT


def nocap_steps(
    names: list[str], edges: list[tuple[list[int], list[int]]], reach: list[tuple[int, int]], five: int, junction: int, three: int
) -> list[list[tuple[int, int, int, int]]]:
    """Groups as steps (step, shape, a, b), in order: those of a shape's reads join whose number is in [a, b].

    Reads of one shape (equal edges) relate alike to all, so only shapes are compared; ``names`` has the
    least read name of each, ``reach`` its first and last read's number, and shapes come in the order of
    their first reads. From many exons to few, the furthest 5' end leads, of equal ones the first read:
    shapes that equal it join its groups and lead in turn by name, and shorter forms with fewer exons
    join each leader they fit. A shape that joins another leaves a group that it has alone. Reads whose
    own turn is over join no equal ones; a shape that is a shorter form may have such reads and others.
    """
    far = lambda x: edges[x][0][-1]
    levels: dict[int, list[int]] = defaultdict(list)
    for i, (f5, _) in enumerate(edges):
        levels[len(f5)].append(i)
    deep = sorted(levels, reverse=True)
    # The outermost exon of a shape must overlap the leader's exon at that place: one look for a level.
    outer = {n: (np.array([far(x) for x in levels[n]]), np.array([edges[x][1][-1] for x in levels[n]])) for n in deep}
    order = [x for n in deep for x in levels[n]]
    if order:
        order.insert(0, order.pop(min(range(len(levels[deep[0]])), key=lambda i: (far(order[i]), i))))
    steps = {g: [(0, x, reach[x][0], reach[x][0])] for g, x in enumerate(order)}
    home = {x: [g] for g, x in enumerate(order)}
    alone, shortened, led = set(order), set(), set()
    clock, turn = 0, order[0] if order else 0

    def matches(leader: int, n: int, wanted: int) -> list[int]:
        f5, f3 = edges[leader][0][n - 1], edges[leader][1][n - 1]
        mine = set(home[leader])
        near = np.flatnonzero((outer[n][0] < f3) & (outer[n][1] > f5)).tolist()
        return [x for x in (levels[n][i] for i in near) if x != leader and mine.isdisjoint(home[x]) and relation(edges[leader], edges[x], five, junction, three) == wanted]

    def waits(x: int) -> bool:
        """Some reads of the shape still have their turn before them."""
        return (far(x), reach[x][1] if x in shortened else reach[x][0]) > (far(turn), reach[turn][0])

    def join(leader: int, shapes: list[int], after: int = -1) -> None:
        nonlocal clock
        clock += 1
        for x in shapes:
            if x in alone:
                alone.discard(x)
                del steps[home[x].pop()]
            for g in home[leader]:
                steps[g].append((clock, x, max(after, reach[x][0]) if far(x) == far(turn) else reach[x][0], reach[x][1]))
                home[x].append(g)

    def lead(x: int) -> list[int]:
        if x in led:
            return []
        led.add(x)
        equal, fit = [], []
        if x not in shortened:
            equal = [y for y in matches(x, len(edges[x][0]), EQUAL) if waits(y)]
            join(x, equal, reach[turn][0] + 1)
            if x in alone and reach[x][0] < reach[x][1]:
                steps[home[x][0]].append((clock, x, reach[x][0] + 1, reach[x][1]))
        for n in deep:
            if n < len(edges[x][0]) and (more := matches(x, n, SHORTENED)):
                join(x, more)
                fit += more
        shortened.update(fit)
        if equal or fit or reach[x][0] < reach[x][1]:
            alone.discard(x)
        return equal

    for n in deep:
        for turn in sorted(levels[n], key=far):
            waiting = [(names[y], y) for y in lead(turn)]
            heapq.heapify(waiting)
            while waiting:
                _, y = heapq.heappop(waiting)
                for z in lead(y):
                    heapq.heappush(waiting, (names[z], z))
    return [steps[g] for g in sorted(steps)]


def nocap_members(rows: DataFrame, five: int, junction: int, three: int, n_rows: int | None = None) -> DataFrame:
    """``rows``: gene, tx, read_id, strand, starts, ends. (gene, nth, at, tx): groups of each gene and the
    place of each read in its groups. Only shapes meet in the kernel; reads join its steps."""
    shape = Window.partitionBy("gene", "f5", "f3")
    reads = groups.dealt(loci.flipped(rows).select("gene", "tx", "read_id", "f5", "f3"), n_rows, "gene")
    reads = loci.kept(reads.withColumns({"first": F.min("tx").over(shape), "last": F.max("tx").over(shape), "name": F.min("read_id").over(shape)}))
    shapes = reads.where("tx = first").select("gene", "first", "last", "name", *(F.col(c).cast("array<long>").alias(c) for c in ("f5", "f3")))

    def work(gene: list[tuple]) -> list[tuple]:
        g, first, last, name, f5, f3 = (list(c) for c in zip(*gene))
        found = nocap_steps(name, list(zip(f5, f3)), list(zip(first, last)), five, junction, three)
        return [(g[0], first[x], i, step, -len(f5[x]), a, b) for i, steps in enumerate(found) for step, x, a, b in steps]

    steps = groups.each(groups.dealt(shapes, n_rows, "gene"), "gene", ["first"], work, "gene long, first long, nth long, step long, fewer long, a long, b long")
    steps = groups.dealt(steps, n_rows, "gene", "first")
    member = groups.dealt(steps.join(groups.dealt(reads.select("gene", "tx", "first"), n_rows, "gene", "first"), ["gene", "first"]).where("tx BETWEEN a AND b"), n_rows, "gene", "nth")
    at = F.row_number().over(Window.partitionBy("gene", "nth").orderBy("step", "fewer", "tx")) - 1
    return member.select("gene", "nth", at.cast("long").alias("at"), "tx")
