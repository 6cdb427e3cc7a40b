"""GTF and GFF3 dialects as models with BED bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.functions.render import bed_line
from spliceflow.operators.groups import dealt

# Feature types that are transcripts in a lift-over GFF3.
TRANSCRIPTS = (
    "transcript", "mRNA", "ncRNA", "tRNA", "rRNA", "snRNA", "miRNA", "primary_transcript", "snoRNA", "V_gene_segment", "guide_RNA", "C_gene_segment", "telomerase_RNA",
    "SRP_RNA", "lnc_RNA",
)


def quoted(attributes: Column, key: str) -> Column:
    """The quoted value of the first field that holds ``key`` anywhere; null if none does."""
    fields = F.filter(F.split(attributes, ";"), lambda x: x.contains(key) & x.contains('"'))
    return F.get(F.split(F.get(fields, 0), '"'), 1)


def assigned(attributes: Column, key: str) -> Column:
    """The value of the first ``key=value`` field; null if there is none."""
    fields = F.filter(F.split(attributes, ";"), lambda x: x.startswith(f"{key}="))
    return F.substring(F.get(fields, 0), F.lit(len(key) + 2), F.length(F.get(fields, 0)))


def _sorted(c: str, wanted: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("feature") == wanted, F.col(c))))


def _parts(rows: DataFrame) -> DataFrame:
    """Per tid: exon starts and ends (each sorted) and CDS bounds, all as BED bounds."""
    rows = rows.where(F.col("feature").isin("exon", "CDS")).withColumn("start", F.col("start") - 1)
    cds = lambda f, c: f(F.when(F.col("feature") == "CDS", F.col(c)))
    return rows.groupBy("tid").agg(
        _sorted("start", "exon").alias("starts"), _sorted("end", "exon").alias("ends"), cds(F.min, "start").alias("cds_start"), cds(F.max, "end").alias("cds_end"),
        F.min("ord").alias("ord"), *(F.min_by(c, "ord").alias(c) for c in ("seqname", "strand", "gene")),
    )


def _described(rows: DataFrame, parts: DataFrame, *names: Column) -> DataFrame:
    """``rows``: transcript features; of rows with one tid the last counts, at the first one's place."""
    last = rows.groupBy("tid").agg(F.max_by(F.struct("seqname", "strand", "start", "end", "gene", *names), "ord").alias("t"), F.min("ord").alias("ord"))
    none = F.array().cast("array<bigint>")
    out = last.join(parts.drop("ord", "seqname", "strand", "gene"), "tid", "left").withColumns({c: F.coalesce(c, none) for c in ("starts", "ends")})
    return out.select(
        "ord", "tid", F.col("t.seqname").alias("seqname"), F.col("t.strand").alias("strand"), (F.col("t.start") - 1).alias("left"), F.col("t.end").alias("right"), "starts", "ends", "cds_start", "cds_end",
        F.concat_ws(";", "t.gene", "tid", "t.x", "t.y").alias("id_line"),
    )


def _ensembl(rows: DataFrame, n_rows: int | None) -> DataFrame:
    a, blank = F.col("attributes"), F.lit("")
    rows = rows.withColumn("tid", F.coalesce(quoted(a, "transcript_id"), blank)).withColumn("gene", F.coalesce(quoted(a, "gene_id"), blank))
    kind = lambda key, to: F.coalesce(quoted(a, key), F.lit("NA")).alias(to)
    out = _described(rows.where("feature = 'transcript'"), _parts(rows), kind("gene_biotype", "x"), kind("transcript_biotype", "y"))
    return out.withColumns({"cds_start": F.coalesce("cds_start", "left"), "cds_end": F.coalesce("cds_end", "left")})


def _liftoff(rows: DataFrame, n_rows: int | None) -> DataFrame:
    a, blank = F.col("attributes"), F.lit("")
    parent = F.coalesce(assigned(a, "Parent"), blank)
    whole = F.col("feature").isin(*TRANSCRIPTS)
    rows = rows.withColumn("tid", F.when(whole, F.coalesce(assigned(a, "ID"), blank)).otherwise(F.substring_index(parent, ",", 1))).withColumn("gene", parent)
    out = _described(rows.where(whole), _parts(rows), F.coalesce(assigned(a, "Name"), F.lit("NA")).alias("x"), F.col("feature").alias("y"))
    return out.withColumns({"cds_start": F.coalesce("cds_start", F.lit(0)), "cds_end": F.coalesce("cds_end", F.lit(0))})


def _ncbi(rows: DataFrame, n_rows: int | None) -> DataFrame:
    a, blank = F.col("attributes"), F.lit("")
    rows = rows.withColumn("tid", F.coalesce(quoted(a, "transcript_id"), blank)).withColumn("gene", F.coalesce(quoted(a, "gene_id"), blank)).where("tid <> 'unknown_transcript_1'")
    out = _parts(rows).where(F.size("starts") > 0).withColumn("left", F.col("starts")[0]).withColumn("right", F.element_at("ends", -1))
    return out.withColumns({"cds_start": F.coalesce("cds_start", "left"), "cds_end": F.coalesce("cds_end", "left"), "id_line": F.concat_ws(";", "gene", "tid")})


def _listed(rows: DataFrame, rank: Column, once: bool, n_rows: int | None) -> DataFrame:
    """Exons of (gene, tid) in the order of ``rank``, genes and models in order of appearance."""
    need = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), (F.col("start") - 1).alias("s"), F.col("end").alias("e")))
    rows = rows.select("gene", "tid", "ord", "seqname", "strand", need.alias("exon"))
    rows = rows if n_rows is None else dealt(rows, n_rows, "gene")
    out = rows.groupBy("gene", "tid").agg(F.array_sort(F.collect_list("exon")).alias("x"), F.min("ord").alias("ord"), F.min_by(F.struct("seqname", "strand"), "ord").alias("first"))
    out = out.withColumn("gene_ord", F.min("ord").over(Window.partitionBy("gene"))).where(F.size("x") > 0)
    if once:
        ok = F.size(F.array_distinct("x.rank")) == F.size("x")
        out = out.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("an exon number occurs twice in "), F.col("tid"))).cast("boolean")))
    out = out.select("gene", "tid", "ord", "gene_ord", "first.*", F.col("x.s").alias("starts"), F.col("x.e").alias("ends"))
    out = out.withColumn("left", F.col("starts")[0]).withColumn("right", F.element_at("ends", -1))
    return out.withColumns({"cds_start": F.col("left"), "cds_end": F.col("right"), "id_line": F.concat_ws(";", "gene", "tid")})


def _stringtie(rows: DataFrame, n_rows: int | None) -> DataFrame:
    a = F.col("attributes")
    rows = rows.withColumn("gene", quoted(a, "gene_id")).withColumn("tid", quoted(a, "transcript_id")).where("gene IS NOT NULL AND tid IS NOT NULL")
    return _listed(rows, quoted(a, "exon_number").cast("long"), once=True, n_rows=n_rows)


def _cupcake(rows: DataFrame, n_rows: int | None) -> DataFrame:
    a = F.col("attributes")
    need = lambda key: F.coalesce(quoted(a, key), F.raise_error(F.concat(F.lit(f"no {key}: "), a)))
    rows = rows.withColumn("gene", need("gene_id")).withColumn("tid", need("transcript_id"))
    return _listed(rows, F.when(F.col("feature") == "exon", F.col("ord")), once=False, n_rows=n_rows)


DIALECTS: dict[str, Callable[[DataFrame, int | None], DataFrame]] = {"ensembl": _ensembl, "ncbi": _ncbi, "stringtie": _stringtie, "liftoff": _liftoff, "cupcake": _cupcake}


def models(rows: DataFrame, dialect: str, n_rows: int | None = None) -> DataFrame:
    """``rows``: GTF/GFF rows (``readers.gtf``). gene_ord and ord (output order), id_line, bounds, CDS
    and BED line. Models without an exon go, but for ensembl and liftoff, which list transcripts."""
    out = DIALECTS[dialect](rows, n_rows)
    if "gene_ord" not in out.columns:
        out = out.withColumn("gene_ord", F.lit(0).cast("long"))
    c = F.col
    line = bed_line(c("seqname"), c("id_line"), c("strand"), c("starts"), c("ends"), thick=(c("cds_start"), c("cds_end")), span=(c("left"), c("right")))
    return out.select("gene_ord", "ord", F.col("seqname").alias("scaffold"), "strand", "id_line", F.col("left").alias("trans_start"), F.col("right").alias("trans_end"), "starts", "ends", "cds_start", "cds_end", line.alias("line"))
