"""One walk along an alignment: error counts, differences from the genome, errors beside junctions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_OP = re.compile(r"([0-9]+)([MIDNSHP=X])")
# The bases that a code stands for here (K, M, Y, R and the three-base codes are not the usual ones).
BASES = {
    "A": "A", "T": "T", "C": "C", "G": "G", "S": "CG", "W": "AT", "K": "AC", "M": "GT", "Y": "AG", "R": "CT",
    "V": "CGT", "H": "AGT", "D": "ACT", "B": "ACG", "N": "ATCG",
}
_MATCH = {a + b for a in BASES for b in BASES if set(BASES[a]) & set(BASES[b])}
#: What stands for a junction side without errors.
CLEAN = "0"


@dataclass
class Walk:
    hard: int = 0
    soft: int = 0
    ins: int = 0
    dele: int = 0
    mis: int = 0
    variation: list[tuple[int, str, str]] = field(default_factory=list)
    sj_pre: list[str] = field(default_factory=list)
    sj_post: list[str] = field(default_factory=list)


def _before(ops: list[tuple[int, str]], j: int, at: int, seen: list[tuple[int, str]], near: int) -> str:
    """Errors up to ``near`` bases before the junction at ``ops[j]``, nearest last. ``seen``: all
    mismatches so far. The window of a block moves back by every operation's length, inserted ones too."""
    out, total, edge, left = [], 0, at, len(seen)
    for n, op in reversed(ops[:j]):
        if total > near or op == "N":
            break
        total += n
        if op != "M":
            out.append(f"{n}{op}")
        else:
            had = len(out)
            while left and edge - n <= seen[left - 1][0] <= edge and at - seen[left - 1][0] <= near:
                left -= 1
                out.append(f"{at - seen[left][0]}.{seen[left][1]}")
            if len(out) == had and total <= near:
                out.append(f"{n}M")
        edge -= n
    return "_".join(reversed(out)) or CLEAN


def _after(ops: list[tuple[int, str]], j: int, blocks: dict[int, list[tuple[int, str]]], at: int, near: int) -> str:
    """Errors up to ``near`` bases after the junction at ``ops[j]``; ``at``: first base behind it.
    Within a block a mismatch counts as long as the one before it (the first: itself) lies below ``near``."""
    out, total = [], 0
    for k in range(j + 1, len(ops)):
        n, op = ops[k]
        if total > near or op == "N":
            break
        total += n
        if op != "M":
            out.append(f"{n}{op}")
            continue
        had, last = len(out), blocks[k][0][0] - at if blocks[k] else near
        for place, text in blocks[k]:
            if last >= near:
                break
            last = place - at
            if last <= near:
                out.append(f"{last}.{text}")
        if len(out) == had and total <= near:
            out.append(f"{n}M")
    return "_".join(out) or CLEAN


def walk(cigar: str, seq: str, ref: str, start: int, near: int = 10) -> Walk:
    """``ref`` holds the genome's bases of the exons from the 1-based ``start`` on, without the gaps between
    them; places of variation are 0-based."""
    ops = [(int(n), "M" if op in "=X" else op) for n, op in _OP.findall(cigar)]
    out, at, to, on, seen, gaps = Walk(), 0, 0, 0, [], []
    blocks: dict[int, list[tuple[int, str]]] = {}
    first = start - 1
    for k, (n, op) in enumerate(ops):
        if op == "H":
            out.hard += n
            out.variation.append((first + to - out.hard, "H", "N" * n))
        elif op == "S":
            out.soft += n
            out.variation.append((first + to - out.soft + (k == len(ops) - 1), "S", seq[at : at + n]))
            at += n
        elif op == "I":
            out.ins += n
            out.variation.append((first + to, "I", seq[at : at + n]))
            at += n
        elif op == "D":
            out.dele += n
            out.variation.append((first + to, "D", str(n)))
            to += n
            on += n
        elif op == "N":
            gaps.append((k, to, len(seen)))
            to += n
        elif op == "M":
            x, y = seq[at : at + n], ref[on : on + n]
            blocks[k] = []
            if x.upper() != y:
                for i, (q, g) in enumerate(zip(x, y)):
                    if g + q.upper() not in _MATCH:
                        blocks[k].append((first + to + i, f"{q.upper()}.{g}"))
                        out.variation.append((first + to + i, "M", q))
            seen += blocks[k]
            at += n
            to += n
            on += n
    out.mis = len(seen)
    for k, to, known in gaps:
        out.sj_pre.append(_before(ops, k, first + to, seen[:known], near))
        out.sj_post.append(_after(ops, k, blocks, first + to + ops[k][0], near))
    return out
