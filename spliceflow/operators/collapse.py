"""Reads to models: error counts against the genome, acceptance, loci, genes, models, votes, numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.functions import alignment as al
from spliceflow.functions.render import bed_line
from spliceflow.functions.sequence import a_count, downstream_span, oriented
from spliceflow.operators import genome, loci
from spliceflow.operators.alignments import CLEAN, walk
from spliceflow.operators.nocap import nocap_members


def _aligned(sam: DataFrame, bases: DataFrame) -> DataFrame:
    """Mapped primary rows with exon bounds and the genome's bases of the exons, one after the other (``ref``)."""
    rows = sam.withColumn("flag_class", al.flag_class(F.col("flag"))).where(F.col("flag_class").isin("forward_strand", "reverse_strand"))
    rows = rows.withColumn("x", al.exons(al.cigar_ops(F.col("cigar")), F.col("start_pos")))
    rows = rows.select("ord", "read_id", "flag_class", "scaffold", "start_pos", F.col("x.starts").alias("starts"), F.col("x.ends").alias("ends"), "cigar", "seq")
    spans = F.zip_with("starts", "ends", lambda s, e: F.struct((s - 1).alias("s"), (e - 1).alias("e")))
    return genome.stretches(rows, bases, spans, "ref")


def read_metrics(sam: DataFrame, bases: DataFrame, min_coverage: float = 99.0, min_identity: float = 85.0, how: str = "ident_cov", near: int = 10) -> DataFrame:
    """Per mapped read: error counts, coverage, identity, acceptance, exon bounds (1-based, end
    exclusive), and for each junction the errors up to ``near`` bases before and after it."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [walk(c, s, r, p, near) for c, s, r, p in zip(f["cigar"], f["seq"], f["ref"], f["start_pos"])]
            for name in ("hard", "soft", "ins", "dele", "mis", "sj_pre", "sj_post"):
                f[name] = [getattr(g, name) for g in got]
            f["length"] = [len(s) + g.hard for s, g in zip(f["seq"], got)]
            yield f[["ord", "read_id", "flag_class", "scaffold", "starts", "ends", "cigar", "length", "hard", "soft", "ins", "dele", "mis", "sj_pre", "sj_post"]]

    schema = (
        "ord long, read_id string, flag_class string, scaffold string, starts array<long>, ends array<long>, cigar string, length long, hard long, soft long, ins long, dele long, mis long,"
        "sj_pre array<string>, sj_post array<string>"
    )
    rows = _aligned(sam, bases).mapInPandas(work, schema)
    c = F.col
    cov = al.coverage(c("length"), c("hard"), c("soft"))
    ident = al.identity(c("length"), c("hard"), c("soft"), c("ins"), c("dele"), c("mis"), how)
    return rows.withColumn("coverage", cov).withColumn("identity", ident).withColumn("accepted", (c("coverage") >= min_coverage) & (c("identity") >= min_identity))


def variation(sam: DataFrame, bases: DataFrame) -> DataFrame:
    """(scaf, pos, vtype, alt, read_id): clips, mismatches, insertions and deletions of every mapped
    read, accepted or not; places are 0-based."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (s, pos, kind, alt, r)
                for s, r, c, q, g, p in zip(f["scaffold"], f["read_id"], f["cigar"], f["seq"], f["ref"], f["start_pos"])
                for pos, kind, alt in walk(c, q, g, p, -1).variation
            ]
            yield pd.DataFrame(rows, columns=["scaf", "pos", "vtype", "alt", "read_id"])

    return _aligned(sam, bases).mapInPandas(work, "scaf string, pos long, vtype string, alt string, read_id string")


def strand_conflicts(sam: DataFrame) -> DataFrame:
    """Mapped reads whose flag and XS tag name different strands."""
    strand = F.when(F.col("flag") == 0, "+").when(F.col("flag") == 16, "-")
    return sam.where(strand.isNotNull() & F.col("xs_strand").isin("+", "-") & (strand != F.col("xs_strand"))).select(
        "read_id", F.col("scaffold").alias("scaff_name"), "start_pos", "cigar", F.concat(strand, "xs_strand").alias("strands")
    )


def check_single(accepted: DataFrame) -> DataFrame:
    """An error where a read has two accepted alignments; the rows as they are otherwise."""
    n = accepted.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.first("ord").alias("o"))
    ok = F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("more than one accepted alignment of "), F.col("read_id"))).cast("boolean"))
    return accepted.join(n.where(ok).select("read_id"), "read_id", "left_semi")


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Every aligned exon pair overlaps."""
    pairs = F.zip_with(F.arrays_zip(s1.alias("s"), e1.alias("e")), F.arrays_zip(s2.alias("s"), e2.alias("e")), lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"]))
    return F.forall(pairs, lambda x: x)


def numbered(genes: DataFrame, models: DataFrame) -> DataFrame:
    """``genes``: gene, rank columns g1 (of the scaffold) to g3; ``models``: gene, key (sortable). Adds gene_no
    and model_no. Genes are ranked scaffold by scaffold; only scaffolds meet in one order."""
    size = genes.groupBy("g1").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("g1").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select("g1", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("g1").orderBy("g2", "g3"))
    ranked = genes.withColumn("nth", nth).join(size, "g1").select("gene", (F.col("before") + F.col("nth")).cast("int").alias("gene_no"))
    within = F.row_number().over(Window.partitionBy("gene").orderBy("key"))
    return models.withColumn("model_no", within).join(ranked, "gene")


def joined_duplicates(built: DataFrame, tie: str = "tie") -> DataFrame:
    """``built``: gene, scaf, strand, starts, ends, model and more. Models of equal bounds become the one with
    the least ``tie``; ``all`` lists them."""
    own = [c for c in built.columns if c not in ("gene", "scaf", "strand", "starts", "ends")]
    same = built.groupBy("gene", "scaf", "strand", "starts", "ends").agg(F.min_by(F.struct(*own), tie).alias("kept"), F.collect_list("model").alias("all"))
    return same.select("gene", "scaf", "strand", "starts", "ends", "kept.*", "all")


def _capped_members(rows: DataFrame, five: int, junction: int, three: int) -> DataFrame:
    """(tx, gene, model, tie, at): components of matching reads. Reads of one structure are compared once."""
    one = rows.groupBy("gene", "scaf", "strand", "n", "starts", "ends", "ts").agg(F.min("tx").alias("tx"))
    pairs = loci.capped_pairs(one, five, junction, three)
    side = lambda c: one.select(F.col("tx").alias(c), F.col("gene").alias(f"g{c}"), F.col("starts").alias(f"s{c}"), F.col("ends").alias(f"e{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("ga = gb").where(overlapping(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb"))).select("a", "b")
    group = loci.components(pairs, "a", "b").select(F.col("id").alias("rep"), "component")
    members = rows.join(one.select("gene", "strand", "starts", "ends", F.col("tx").alias("rep")), ["gene", "strand", "starts", "ends"]).join(group, "rep", "left")
    model = F.coalesce("component", "rep")
    return members.select("tx", "gene", model.cast("string").alias("model"), model.alias("tie"), F.col("tx").alias("at"))


def _edges(members: DataFrame, priority: bool) -> DataFrame:
    """One row an exon edge: model, i (exon from the 3' end), g (from the left), side, coord, prio, err, at.

    With ``priority`` an edge with errors on its own side of the junction ranks 2 behind, on the other side 1.
    """
    x = members.select("model", "strand", "n", "most", "at", "sj_pre", "sj_post", F.posexplode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("k", "x"))
    plus = F.col("strand") == "+"
    before, here = F.greatest(F.col("k") - 1, F.lit(0)), F.col("k")
    dirty = lambda c, j: (F.get(F.col(c), j) != CLEAN).cast("int")
    rank = lambda edge, r: F.when(F.lit(not priority) | edge, F.lit(0)).otherwise(r)
    s_prio = rank(F.col("k") == 0, 2 * dirty("sj_post", before) + dirty("sj_pre", before))
    e_prio = rank(F.col("k") == F.col("n") - 1, 2 * dirty("sj_pre", here) + dirty("sj_post", here))
    err = F.when(F.col("k") == 0, "na").otherwise(F.concat(F.get("sj_pre", before), F.lit(">"), F.get("sj_post", before)))
    sides = F.array(
        F.struct(F.lit("s").alias("side"), F.col("x.s").alias("coord"), s_prio.alias("prio"), err.alias("err")),
        F.struct(F.lit("e").alias("side"), F.col("x.e").alias("coord"), e_prio.alias("prio"), F.lit(None).cast("string").alias("err")),
    )
    x = x.withColumn("i", F.when(plus, F.col("n") - 1 - F.col("k")).otherwise(F.col("k")))
    x = x.withColumn("g", F.when(plus, F.col("most") - 1 - F.col("i")).otherwise(F.col("i")))
    return x.withColumn("y", F.explode(sides)).select("model", "strand", "n", "most", "at", "i", "g", "y.*")


def collapse(
    accepted: DataFrame, capped: bool = False, five: int = 10, junction: int = 10, three: int = 10, longest_ends: bool = False, merge_dup: bool = True, priority: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Models (0-based BED bounds, G numbers, BED line, report columns) and members (model id, read).

    ``capped``: reads are whole, models are components of matching reads. Otherwise 5' ends may be
    missing: a read may be in several models, and reads with fewer exons have no say on the 5' edge
    at which they begin. ``longest_ends`` takes the outermost terminal edges, ``priority`` prefers
    edges without errors beside the junction, ``merge_dup`` joins models with equal bounds.
    """
    strand = F.when(F.col("flag_class") == "forward_strand", "+").otherwise("-")
    rows = accepted.select(F.col("ord").alias("tx"), "read_id", F.col("scaffold").alias("scaf"), strand.alias("strand"), "starts", "ends", "sj_pre", "sj_post", "coverage", "identity")
    rows = rows.withColumn("n", F.size("starts")).withColumn("ts", F.col("starts")[0]).withColumn("te", F.element_at("ends", -1)).withColumn("src", F.lit("reads"))
    exon = rows.select("tx", "scaf", "strand", F.posexplode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("k", "x")).select("tx", "scaf", "strand", "k", "x.s", "x.e")
    rows = loci.kept(rows.join(loci.gene_groups(exon), "tx"))
    if capped:
        of = _capped_members(rows, five, junction, three)
    else:
        of = nocap_members(rows, five, junction, three).select("tx", "gene", F.concat_ws("-", "gene", "nth").alias("model"), F.col("nth").alias("tie"), "at")
    members = rows.join(of.drop("gene"), "tx")
    # Votes, reports and members all read this table.
    members = loci.kept(members.join(members.groupBy("model").agg(F.max("n").alias("most")), "model"))

    edge, plus = _edges(members, priority), F.col("strand") == "+"
    is5 = (F.col("side") == "s") == plus
    top = (F.col("i") == F.col("most") - 1) & is5
    if not capped:
        edge = edge.where(~(is5 & (F.col("i") == F.col("n") - 1) & (F.col("i") < F.col("most") - 1)))
    outer = (top if not capped or longest_ends else F.lit(False)) | ((F.col("i") == 0) & ~is5 if longest_ends else F.lit(False))
    won = loci.vote(edge.where(~outer), ["model", "i", "g"], with_prio=True).unionByName(loci.vote(edge.where(outer), ["model", "i", "g"], outermost=True, with_prio=True))
    won = loci.kept(won)
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("coord", "wobble"))))
    ranks = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("g", "prio")))), lambda x: x["prio"].cast("string")), ",")
    bounds = won.groupBy("model").agg(pick("s").alias("s"), pick("e").alias("e"), ranks("s").alias("collapse_sj_start_err"), ranks("e").alias("collapse_sj_end_err"))
    said = edge.where("side = 's' AND (g > 0 OR most = 1)").join(won.where("side = 's'").select("model", "i", "prio", "coord"), ["model", "i", "prio", "coord"])
    said = said.groupBy("model", "g", "err").agg(F.min("at").alias("at")).groupBy("model", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "err"))), lambda x: x["err"]), "-").alias("line"))
    said = said.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "line"))), lambda x: x["line"]), ";").alias("collapse_error_nuc"))
    where = members.groupBy("model").agg(*(F.first(c).alias(c) for c in ("gene", "scaf", "strand", "tie")))
    built = bounds.join(said, "model").join(where, "model").withColumns({"starts": F.col("s.coord"), "ends": F.col("e.coord"), "start_wobble": F.col("s.wobble"), "end_wobble": F.col("e.wobble")}).drop("s", "e")
    if merge_dup:
        built = joined_duplicates(built)
    else:
        built = built.withColumn("all", F.array("model"))
    inter = F.flatten(F.zip_with("starts", "ends", lambda a, b: F.array(a, b)))
    built = built.withColumn("key", F.concat(F.array(F.col("starts")[0], F.element_at("ends", -1)), inter, F.array("tie")))
    # A gene lies in one locus and loci lie apart, so genes by their start are genes by locus.
    appear = rows.groupBy("scaf").agg(F.min("tx").alias("g1"))
    genes = rows.groupBy("gene", "scaf", "strand").agg(F.min("ts").alias("g2")).join(appear, "scaf").withColumn("g3", F.col("strand"))
    out = numbered(genes.select("gene", "g1", "g2", "g3"), built)
    out = out.withColumn("gene_id", F.concat(F.lit("G"), F.col("gene_no").cast("string"))).withColumn("trans_id", F.concat("gene_id", F.lit("."), F.col("model_no").cast("string")))
    less = lambda c: F.transform(c, lambda x: x - 1)
    out = out.withColumn("starts", less("starts")).withColumn("ends", less("ends"))
    out = out.withColumn("line", bed_line(F.col("scaf"), F.concat_ws(";", "gene_id", "trans_id"), F.col("strand"), F.col("starts"), F.col("ends")))
    out = loci.kept(out)
    mine = members.select("model", "read_id", "strand", "scaf", "starts", "ends", "coverage", "identity", "tx")
    member_of = out.select("trans_id", F.explode("all").alias("model")).join(mine, "model").dropDuplicates(["trans_id", "tx"]).withColumn("starts", less("starts")).withColumn("ends", less("ends"))
    member_of = member_of.withColumn("line", bed_line(F.col("scaf"), F.concat_ws(";", "trans_id", "read_id"), F.col("strand"), F.col("starts"), F.col("ends")))
    report = ("start_wobble", "end_wobble", "collapse_sj_start_err", "collapse_sj_end_err", "collapse_error_nuc")
    return out.select("gene_no", "model_no", "gene_id", "trans_id", "scaf", "strand", "starts", "ends", *report, "line"), member_of.select("trans_id", "read_id", F.col("tx").alias("ord"), "coverage", "identity", "line")


def trans_report(models: DataFrame, members: DataFrame) -> DataFrame:
    """Per model: reads, best and worst coverage and identity, wobble, and errors at the chosen edges."""
    n = members.groupBy("trans_id").agg(
        F.count(F.lit(1)).alias("num_clusters"), *(al.round2(f(c)).alias(f"{a}_{b}") for c, b in (("coverage", "coverage"), ("identity", "quality_percent")) for f, a in ((F.max, "high"), (F.min, "low"))),
    )
    csv = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = models.join(n, "trans_id").withColumn("start_wobble_list", csv("start_wobble")).withColumn("end_wobble_list", csv("end_wobble")).withColumnRenamed("trans_id", "transcript_id")
    return rows.select(
        "gene_no", "model_no", "transcript_id", "num_clusters", "high_coverage", "low_coverage", "high_quality_percent", "low_quality_percent", "start_wobble_list", "end_wobble_list",
        "collapse_sj_start_err", "collapse_sj_end_err", "collapse_error_nuc",
    )


def polya_report(accepted: DataFrame, bases: DataFrame, percent: float = 70.0) -> DataFrame:
    """Reads whose 20 downstream bases hold more than ``percent`` of A."""
    strand = F.when(F.col("flag_class") == "forward_strand", "+").otherwise("-")
    span = downstream_span(F.col("starts")[0], F.element_at("ends", -1), strand)
    rows = accepted.join(bases.select(F.col("id").alias("scaffold")), "scaffold", "left_semi").select("ord", "read_id", "scaffold", strand.alias("strand"), span.alias("span"))
    rows = genome.stretches(rows, bases, F.array("span"), "stretch").select("read_id", "strand", oriented(F.col("stretch"), F.col("strand")).alias("downstream"))
    rows = rows.withColumn("a_count", a_count(F.col("downstream")))
    return rows.withColumn("a_percent", F.col("a_count") / F.length("downstream") * 100).where(F.col("a_percent") > percent)
