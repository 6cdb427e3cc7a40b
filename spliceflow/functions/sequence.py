"""Column expressions over nucleotide strings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
# The standard genetic code in TCAG order, with $ for a stop.
AMINO = "FFLLSSSSYY$$CC$WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgtNnRYSWKMBVDH", "TGCAtgcaNnYRSWMKVBHD")


_CODE = np.full(256, 255, np.uint8)
_CODE[list(BASES.encode())] = range(4)
_AMINO = np.frombuffer(AMINO.encode(), np.uint8)


def proteins(seqs: list[str]) -> list[list[np.ndarray]]:
    """Amino acids (as bytes) of the three reading frames of each sequence; all bases are of ACGT."""
    code = _CODE[np.frombuffer("".join(seqs).encode(), np.uint8)]
    every = _AMINO[(code[:-2] << 4) + (code[1:-1] << 2) + code[2:]] if len(code) > 2 else code[:0]
    out, at = [], 0
    for seq in seqs:
        out.append([every[at + f : at + f + (len(seq) - f) // 3 * 3 : 3] if len(seq) - f > 2 else every[:0] for f in range(3)])
        at += len(seq)
    return out


def a_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("A"), F.lit("")))


def downstream_span(start: Column, end: Column, strand: Column, width: int = 20) -> Column:
    """struct<s, e> (0-based, half-open) of ``width`` bases after a read's 3' end: from index ``end`` on the
    plus strand, those before index ``start`` (1-based: the first aligned base) on the minus strand."""
    start, end = start.cast("long"), end.cast("long")
    first = F.greatest(start - width, F.lit(0).cast("long"))
    plus = strand == "+"
    return F.struct(F.when(plus, end).otherwise(first).alias("s"), F.when(plus, end + width).otherwise(start).alias("e"))


def oriented(bases: Column, strand: Column) -> Column:
    return F.when(strand == "+", bases).otherwise(reverse_complement(bases))


def polya_window(genome: Column, start: Column, end: Column, strand: Column, width: int = 20) -> Column:
    """The bases of ``downstream_span`` as the read goes on."""
    span = downstream_span(start, end, strand, width)
    return oriented(F.substring(genome, (span["s"] + 1).cast("int"), (span["e"] - span["s"]).cast("int")), strand)
