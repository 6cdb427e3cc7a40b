"""Open reading frames and their projection on the genome."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from spliceflow.functions import sequence as sq


#: Bases that a task translates at a time.
PIECE = 1 << 20


def _translated(seqs: DataFrame, columns: list[tuple[str, str]], work: Callable[[list[np.ndarray]], list[tuple]]) -> DataFrame:
    """(id, *columns): of each sequence over ACGT the rows that ``work`` makes of its three proteins."""
    kind = seqs.schema["id"].dataType
    arrow = pa.schema([("id", to_arrow_type(kind)), *((c, pa.type_for_alias(t)) for c, t in columns)])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            held, held_seqs, size = [], [], 0
            for i, seq in enumerate(f.column(1)):
                held.append(i)
                held_seqs.append(seq.as_py())
                size += len(held_seqs[-1])
                if size >= PIECE:
                    yield made(f.column(0), held, held_seqs)
                    held, held_seqs, size = [], [], 0
            if held:
                yield made(f.column(0), held, held_seqs)

    def made(ids: pa.Array, held: list[int], held_seqs: list[str]) -> pa.RecordBatch:
        rows = [(i, *x) for i, proteins in zip(held, sq.proteins(held_seqs)) for x in work(proteins)]
        at, *rest = zip(*rows) if rows else [()] * (1 + len(columns))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())).cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(rest, list(arrow)[1:]))], schema=arrow)

    clean = seqs.where(~F.col("seq").rlike("[^ACGT]")).select("id", "seq")
    return clean.mapInArrow(batches, StructType([StructField("id", kind), *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in columns).replace("int64", "long").replace("int32", "int"))]))


def frames(seqs: DataFrame) -> DataFrame:
    """(id, frame 1..3, protein); sequences with a base outside ACGT give none."""
    return _translated(seqs, [("frame", "int32"), ("protein", "string")], lambda found: [(k, x.tobytes().decode()) for k, x in enumerate(found, 1)])


def _spans(protein: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, stop), places from 1, of the segments' reading frames."""
    stops, starts = np.flatnonzero(protein == ord("$")), np.flatnonzero(protein == ord("M"))
    if not len(stops):
        return
    if stops[0] > 0 and protein[0] != ord("M"):
        yield 1, int(stops[0])
    at = np.searchsorted(starts, np.concatenate(([0], stops[:-1] + 1)))
    some = at < len(starts)
    first, stops = starts[at[some]], stops[some]
    yield from ((a + 1, b) for a, b in zip(first.tolist(), stops.tolist()) if a < b)


def orfs(seqs: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, frame, start, stop, length): amino-acid places from 1. Of each stop-terminated segment the
    part from its first M; of a frame's first segment also the whole. A tail without a stop has none.
    With ``longest`` only those of a sequence's so many largest lengths."""

    def work(found: list[np.ndarray]) -> list[tuple]:
        rows = [(k, a, b, b - a + 1) for k, x in enumerate(found, 1) for a, b in _spans(x)]
        if longest is None:
            return rows
        least = min(sorted({r[3] for r in rows})[-longest:], default=0)
        return [r for r in rows if r[3] >= least]

    return _translated(seqs, [("frame", "int32"), ("start", "int64"), ("stop", "int64"), ("length", "int64")], work)


def top_orfs(found: DataFrame, lengths: int = 4) -> DataFrame:
    """All of an id's ORFs that have one of its largest distinct lengths."""
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("length")))
    return found.withColumn("rank", rank).where(F.col("rank") <= lengths)


def spliced_to_genome(strand: Column, starts: Column, ends: Column, place: Column) -> Column:
    """The genomic base of a place (from 0) on the spliced transcript; null beyond its end."""
    size = F.zip_with(ends, starts, lambda e, s: e - s)
    total = F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x)
    want = F.when(strand == "+", place).otherwise(total - 1 - place)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["at"] + x["e"] - x["s"]
        inside = (want >= acc["at"]) & (want < after)
        return F.struct(after.alias("at"), F.when(inside, x["s"] + want - acc["at"]).otherwise(acc["hit"]).cast("long").alias("hit"))

    return F.aggregate(F.arrays_zip(starts.alias("s"), ends.alias("e")), zero, step, lambda a: a["hit"])


def seek(seqs: DataFrame, lengths: int = 4) -> DataFrame:
    """``seqs``: rec_no, id, seq. (rec_no, place, header, protein): the longest reading frames of each
    record; one marked missing_nucleotides (no protein) where a codon holds another letter than ACGT."""
    upper = seqs.select("rec_no", F.col("id").alias("name"), F.col("rec_no").alias("id"), F.upper("seq").alias("seq"))
    odd = upper.where(F.col("seq").rlike("[^ACGT]") & (F.length("seq") >= 3))
    bad = odd.select("rec_no", F.lit(0).alias("place"), F.concat("name", F.lit(":missing_nucleotides")).alias("header"), F.lit(None).cast("string").alias("protein"))
    first = top_orfs(orfs(upper, lengths), lengths).withColumnRenamed("id", "rec_no")
    read = frames(upper).select(F.col("id").alias("rec_no"), "frame", F.col("protein").alias("whole"))
    rows = first.join(read, ["rec_no", "frame"]).join(upper.select("rec_no", "name"), "rec_no")
    rows = rows.withColumn("protein", F.substring("whole", F.col("start").cast("int"), F.col("length").cast("int")))
    s = lambda c: c.cast("string")
    n1, n2 = F.col("frame") - 1 + 3 * (F.col("start") - 1), F.col("frame") + 1 + 3 * F.col("stop")
    tail = F.concat_ws(":", F.concat(F.lit("F"), s(F.col("frame"))), s(n1), s(n2), s(F.col("start")), s(F.col("stop")), s(F.col("length")), F.substring("protein", 1, 1))
    order = F.row_number().over(Window.partitionBy("rec_no").orderBy(F.desc("length"), "frame", "tail"))
    rows = rows.withColumn("tail", tail).withColumn("place", order)
    return rows.select("rec_no", "place", F.concat_ws(":", "name", "tail").alias("header"), "protein").unionByName(bad)


def add_cds(models: DataFrame, parsed: DataFrame, lengths: DataFrame, include_stop: bool = False, junction_distance: int = 50) -> DataFrame:
    """``models``: ord, id_line, strand, starts, ends; ``parsed``: id, frame, nuc_start, nuc_end, rel_start,
    subject, match; ``lengths``: id, length of the transcript. Adds cds_start, cds_end and the new id_line.

    Models without a parsed frame, and those with missing nucleotides, get the bounds 0 and 0. A CDS
    end on an exon boundary is the next exon's start.
    """
    c, total = F.col, F.lit(0).cast("long")
    rows = models.join(parsed.select(c("id").alias("id_line"), "frame", *(c(x).cast("long").alias(x) for x in ("nuc_start", "nuc_end", "rel_start")), "subject", "match"), "id_line", "left")
    rows = rows.join(lengths.select(c("id").alias("id_line"), c("length").cast("long").alias("length")), "id_line", "left")
    behind = c("nuc_end") + 1 if include_stop else c("nuc_end") - 2
    plus = c("strand") == "+"
    rows = rows.withColumn("from", F.when(plus, c("nuc_start")).otherwise(c("length") - behind)).withColumn("to", F.when(plus, behind).otherwise(c("length") - c("nuc_start")))
    none = F.struct(total.alias("at"), total.alias("i"), total.alias("si"), total.alias("s"), total.alias("ei"), total.alias("e"))

    def step(a, x):
        after = a["at"] + x["e"] - x["s"]
        starts, ends = (c("from") >= a["at"]) & (c("from") < after), (c("to") >= a["at"]) & (c("to") <= after)
        return F.struct(
            after.alias("at"), (a["i"] + 1).alias("i"), F.when(starts, a["i"]).otherwise(a["si"]).alias("si"), F.when(starts, x["s"] + c("from") - a["at"]).otherwise(a["s"]).alias("s"),
            F.when(ends, a["i"]).otherwise(a["ei"]).alias("ei"), F.when(ends, x["s"] + c("to") - a["at"]).otherwise(a["e"]).alias("e"),
        )

    rows = rows.withColumn("h", F.aggregate(F.arrays_zip(c("starts").alias("s"), c("ends").alias("e")), none, step))
    last = F.size("starts") - 1 - c("h.ei")
    far = F.when(plus, (last > 0) & (F.element_at("starts", -1) - c("h.e") > junction_distance)).otherwise((c("h.si") > 0) & (c("h.s") - c("ends")[0] > junction_distance))
    nmd = F.when(far, F.concat(F.lit("NMD"), F.when(plus, last).otherwise(c("h.si")).cast("string"))).otherwise("prot_ok")
    degrade = F.when(c("rel_start") == 1, "5prime_degrade").otherwise("full_length")
    absent, missing = c("match").isNull(), c("match") == "missing_nucleotides"
    line = F.when(absent, F.concat_ws(";", "id_line", F.lit("none;missing;no_orf;missing;na"))).when(missing, F.concat_ws(";", "id_line", "subject", F.lit("missing"), "match", F.lit("missing;missing")))
    out = rows.withColumn("id_line_", line.otherwise(F.concat_ws(";", "id_line", "subject", degrade, "match", nmd, "frame")))
    for x, h in (("cds_start", "h.s"), ("cds_end", "h.e")):
        out = out.withColumn(x, F.when(absent | missing, F.lit(0)).otherwise(c(h)))
    return out.drop("id_line", "h", "from", "to", "frame", "nuc_start", "nuc_end", "rel_start", "subject", "match", "length").withColumnRenamed("id_line_", "id_line")


def coding_models(models: DataFrame, include_stop: bool = False) -> DataFrame:
    """Models cut to their CDS, ids prefixed with ``cds;``; those without one (0 to 0) go. With
    ``include_stop`` the three spliced bases behind it are taken in."""
    c, plus = F.col, F.col("strand") == "+"
    pairs = F.arrays_zip(c("starts").alias("s"), c("ends").alias("e"))
    inside = F.filter(pairs, lambda x: x["s"] < c("cds_end"))
    rows = models.where("NOT (cds_start = 0 AND cds_end = 0)").withColumn("cds_end", F.least(F.element_at(inside, -1)["e"], c("cds_end")))
    if include_stop:
        zero = F.lit(0).cast("long")
        ahead = F.aggregate(pairs, zero, lambda a, x: a + F.greatest(F.least(x["e"], c("cds_end") - 1) - x["s"], F.lit(0)))
        back = F.aggregate(pairs, zero, lambda a, x: a + F.greatest(x["e"] - F.greatest(x["s"], c("cds_start") + 1), F.lit(0)))
        moved = spliced_to_genome(c("strand"), c("starts"), c("ends"), F.when(plus, ahead).otherwise(back) + 3)
        rows = rows.withColumn("moved", moved).withColumn("cds_start", F.when(plus, c("cds_start")).otherwise(c("moved"))).withColumn("cds_end", F.when(plus, c("moved") + 1).otherwise(c("cds_end"))).drop("moved")
    cut = F.filter(F.transform(pairs, lambda x: F.struct(F.greatest(x["s"], c("cds_start")).alias("s"), F.least(x["e"], c("cds_end")).alias("e"))), lambda x: x["s"] < x["e"])
    rows = rows.withColumn("x", cut).where(F.size("x") > 0)
    rows = rows.withColumns({"starts": c("x.s"), "ends": c("x.e"), "id_line": F.concat(F.lit("cds;"), c("id_line"))}).drop("x")
    return rows.withColumns({"cds_start": c("starts")[0], "cds_end": F.element_at("ends", -1)})
