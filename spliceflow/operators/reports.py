"""Report files of support, filters and statistics as ordered ``line`` tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.operators import fragments, reads
from spliceflow.functions.render import bed_line

# The labels of the degradation report, each for the capped, then the no-cap run.
TALLIES = (
    ("multi-exon, multi-read, transcript", "multi_exon_multi_read_trans"), ("total transcript", "trans"), ("single exon trans", "single_exon_trans"), ("multi exon trans", "multi_exon_trans"),
    ("total gene", "genes"), ("single exon gene", "single_exon_genes"), ("multi exon gene", "multi_exon_genes"), ("single exon single read gene", "single_exon_single_read_genes"),
    ("multi exon single read gene", "multi_exon_single_read_genes"),
)


def shortest(x: float) -> str:
    """The shortest decimal text that reads back as ``x``, without an exponent; whole numbers keep .0."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN"}.get(repr(x), repr(x))
    text = format(Decimal(repr(x)), "f")
    return text if "." in text else f"{text}.0"


def _gene(trans: str) -> Column:
    return F.substring_index(trans, ".", 1)


def _list(order: list[str], value: str, separator: str) -> Column:
    """Aggregates ``value`` in the order of ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), separator)


def _tabs(*columns: str) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line")


def _places(rows: DataFrame) -> DataFrame:
    """Adds gene_ord and trans_ord, where each gene and model appears first (``ord``)."""
    trans = rows.groupBy("gene", "trans").agg(F.min("ord").alias("trans_ord"))
    return trans.join(trans.groupBy("gene").agg(F.min("trans_ord").alias("gene_ord")), "gene")


# ---- support ---------------------------------------------------------------------------------------


def cluster_support(members: DataFrame, clusters: DataFrame, trim: bool = True) -> DataFrame:
    """``members``: ord, trans, read_id (a cluster, with ``trim`` up to its first slash); ``clusters``: ord,
    cluster, read_id. gene_ord, trans_ord and the line of each model: a gene's reads count once a cluster."""
    cluster = F.substring_index("read_id", "/", 1) if trim else F.col("read_id")
    rows = members.select("ord", _gene("trans").alias("gene"), "trans", cluster.alias("cluster"))
    one = rows.groupBy("gene", "trans", "cluster").agg(F.min("ord").alias("at"))
    of = clusters.groupBy("cluster", "read_id").agg(F.min("ord").alias("o")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), _list(["o"], "read_id", ",").alias("reads"))
    one = one.join(of, "cluster", "left").withColumn("part", F.concat_ws(":", "cluster", F.coalesce("reads", F.lit(""))))
    trans = one.groupBy("gene", "trans").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trans_reads"), _list(["at"], "part", ";").alias("parts"))
    trans = trans.join(trans.groupBy("gene").agg(F.sum("trans_reads").alias("gene_reads")), "gene").join(_places(rows), ["gene", "trans"])
    return trans.select("gene_ord", "trans_ord", _tabs("gene", "trans", "gene_reads", "trans_reads", "parts"))


def levels_report(support: DataFrame, sources: list[str], merged: DataFrame | None = None) -> DataFrame:
    """``support``: ord, source, trans, read_id; ``merged``: ord, gene, trans, source, source_trans, or none
    to report the first source's own models. trans_ord and line: reads of a gene and model, sources and reads.

    Reads of a merged model count once over its sources; a gene's reads are the sum over sources.
    """
    if merged is None:
        own = support.where(F.col("source") == sources[0])
        named = F.lit(None).cast("string") if sources[0] == "cluster" else _gene("trans")
        merged = own.groupBy("trans").agg(F.min("ord").alias("ord")).select("ord", named.alias("gene"), "trans", F.lit(sources[0]).alias("source"), F.col("trans").alias("source_trans"))
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    merged = merged.where(F.col("source").isin(*sources)).withColumn("rank", rank)
    rows = merged.withColumnRenamed("ord", "at").join(support.select("source", F.col("trans").alias("source_trans"), "read_id", F.col("ord").alias("o")), ["source", "source_trans"], "left")
    gene = rows.groupBy("gene", "source").agg(F.countDistinct("read_id").alias("n")).groupBy(F.col("gene").alias("g")).agg(F.sum("n").alias("gene_reads"))
    each = rows.groupBy("trans", "source", "rank", "read_id").agg(F.min(F.struct("at", "o")).alias("first"))
    line = each.groupBy("trans", "source", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("read_id").isNotNull(), F.struct("first", "read_id")))), lambda x: x["read_id"]), ",").alias("reads"))
    line = line.withColumn("part", F.concat_ws(":", "source", "reads"))
    line = line.groupBy("trans").agg(_list(["rank"], "source", ",").alias("source_line"), _list(["rank"], "part", ";").alias("support_line"))
    head = rows.groupBy("trans").agg(F.min("at").alias("trans_ord"), F.min_by("gene", "at").alias("gene"), F.countDistinct("read_id").alias("trans_reads"))
    out = head.join(line, "trans").join(gene, F.col("gene").eqNullSafe(F.col("g")), "left")
    named = out.withColumn("gene_reads", F.when(F.col("gene").isNull(), "NA").otherwise(F.col("gene_reads").cast("string"))).withColumn("gene", F.coalesce("gene", F.lit("NA")))
    return named.select("trans_ord", _tabs("gene", "trans", "gene_reads", "trans_reads", "source_line", "support_line"))


def merge_collapse(merged: DataFrame, support: DataFrame) -> DataFrame:
    """``merged``: ord, trans, prefix, source_trans; ``support``: ord, prefix, trans, read_id. gene_ord,
    trans_ord and line: distinct reads of each merged gene and model, its source models and their reads."""
    rows = merged.withColumn("gene", _gene("trans"))
    one = rows.groupBy("gene", "trans", "prefix", "source_trans").agg(F.min("ord").alias("at"))
    one = one.join(one.groupBy("gene", "trans", "prefix").agg(F.min("at").alias("prefix_at")), ["gene", "trans", "prefix"])
    of = support.groupBy("prefix", F.col("trans").alias("source_trans"), "read_id").agg(F.min("ord").alias("o"))
    met = one.join(of, ["prefix", "source_trans"], "left")
    text = met.groupBy("gene", "trans", "prefix", "source_trans", "prefix_at", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("read_id").isNotNull(), F.struct("o", "read_id")))), lambda x: x["read_id"]), ",").alias("reads"))
    text = text.withColumn("source_id", F.concat_ws("_", "prefix", "source_trans")).groupBy("gene", "trans").agg(_list(["prefix_at", "at"], "source_id", ",").alias("sources"), _list(["prefix_at", "at"], "reads", ";").alias("reads"))
    prefixes = one.select("gene", "trans", "prefix", "prefix_at").distinct().groupBy("gene", "trans").agg(_list(["prefix_at"], "prefix", ",").alias("prefixes"))
    n_trans = met.groupBy("gene", "trans").agg(F.countDistinct("read_id").alias("trans_reads"))
    n_gene = met.groupBy("gene").agg(F.countDistinct("read_id").alias("gene_reads"))
    out = text.join(prefixes, ["gene", "trans"]).join(n_trans, ["gene", "trans"]).join(n_gene, "gene").join(_places(rows), ["gene", "trans"])
    return out.select("gene_ord", "trans_ord", _tabs("gene", "trans", "gene_reads", "trans_reads", "prefixes", "sources", "reads"))


# ---- filters ---------------------------------------------------------------------------------------


def _with_id(gene: str, trans: str) -> Column:
    """The BED line ``value`` with a new id."""
    c = F.split("value", "\t", -1)
    return F.array_join(F.concat(F.slice(c, 1, 3), F.array(F.concat_ws(";", gene, trans)), F.slice(c, 5, F.size(c))), "\t").alias("line")


def _sources(support: DataFrame) -> DataFrame:
    """Per model: its sources in order and its distinct reads."""
    source = support.groupBy("trans", "source").agg(F.min(F.struct("ord", "pos")).alias("at"))
    source = source.groupBy("trans").agg(_list(["at"], "source", ",").alias("source_line"))
    return source.join(support.groupBy("trans").agg(F.countDistinct("read_id").alias("num_reads")), "trans")


def _kept_and_gone(models: DataFrame, kept: DataFrame) -> DataFrame:
    """New ids, and whether any model of the gene stays."""
    rows = reads.renumbered(models, kept)
    gene = rows.groupBy("gene").agg(F.max("new_gene").alias("gene_now"), F.count(F.lit(1)).alias("in_gene"), F.max("ord").alias("gene_last"))
    return rows.join(gene, "gene")


def single_read_files(models: DataFrame, support: DataFrame, level: str = "gene", **rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``models``: ord, value, gene, trans, n_exons. (BED lines that stay, those removed, the report)."""
    rows = _kept_and_gone(models, reads.single_read(models, support, level, **rules)).join(_sources(support), "trans", "left")
    rows = rows.withColumns({"source_line": F.coalesce("source_line", F.lit("")), "num_reads": F.coalesce("num_reads", F.lit(0))})
    gone = F.col("new_gene").isNull()
    # A gene's only model goes as a whole gene where one source and one read stand behind it.
    whole = gone & (F.col("in_gene") == 1) & (F.col("num_reads") == 1) & ~F.col("source_line").contains(",")
    if rules.get("keep_multi", True):
        whole = whole & (F.col("n_exons") == 1)
    said = F.when(whole, "removed_gene").when(gone, F.coalesce("gene_now", F.lit("all_trans_removed"))).otherwise(F.col("new_gene"))
    rows = rows.withColumn("g", said).withColumn("t", F.coalesce("new_trans", F.lit("removed_transcript")))
    report = rows.select("ord", _tabs("gene", "trans", "source_line", "num_reads", "g", "t", "n_exons"))
    return rows.where(~gone).select("ord", _with_id("new_gene", "new_trans")), rows.where(gone).select("ord", F.col("value").alias("line")), report


def polya_files(models: DataFrame, support: DataFrame, polya: DataFrame, percent: float = 75.0, level: str = "gene", **rules) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``polya``: source, read_id, a_percent, fields. (BED lines that stay, those removed, the report, the
    poly-A reads of removed models). The report names the sources and reads of the gene's last model."""
    kept = reads.polya_filter(models, support, polya, percent, level, **rules)
    rows = _kept_and_gone(models, kept)
    last = models.join(_sources(support), "trans", "left").select(F.col("ord").alias("gene_last"), F.coalesce("source_line", F.lit("")).alias("source_line"), F.coalesce("num_reads", F.lit(0)).alias("num_reads"))
    rows = rows.join(last, "gene_last")
    gone = F.col("new_gene").isNull()
    lost = F.lit(level == "gene") | F.col("gene_now").isNull()
    rows = rows.withColumn("g", F.when(gone & lost, "removed_gene").when(gone, F.col("gene_now")).otherwise(F.col("new_gene"))).withColumn("t", F.coalesce("new_trans", F.lit("removed_transcript")))
    report = rows.select("ord", _tabs("gene", "trans", "source_line", "num_reads", "g", "t", "n_exons"))
    behind = rows.where(gone).select("ord", "trans").join(support.select("trans", "source", "read_id", F.struct(F.col("ord").alias("o"), "pos").alias("at")), "trans")
    first = behind.groupBy("ord", "trans", "read_id").agg(F.min("at").alias("at"), F.min_by("source", "at").alias("source"))
    proof = first.join(polya.where(F.col("a_percent") >= percent), ["source", "read_id"]).select("ord", "at", _tabs("trans", "source", "fields"))
    return rows.where(~gone).select("ord", _with_id("new_gene", "new_trans")), rows.where(gone).select("ord", F.col("value").alias("line")), report, proof


def fragment_files(models: DataFrame, wobble: int = 10, ends: int = 500, percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """``models``: ord, gene, trans, scaf, strand, starts, ends. (BED lines that stay, those absorbed)."""
    found = fragments.absorb_fragments(models.withColumn("tx", F.col("ord")), wobble, ends, percent).select(F.col("tx").alias("ord"), "absorbed_by", "start", "end")
    rows = models.join(found, "ord")
    starts = F.concat(F.array("start"), F.slice("starts", 2, F.size("starts")))
    stops = F.concat(F.slice("ends", 1, F.size("ends") - 1), F.array("end"))
    first = rows.groupBy("gene").agg(F.min("ord").alias("gene_ord"))
    rows = rows.join(first, "gene").select("gene_ord", "ord", "absorbed_by", bed_line(F.col("scaf"), F.concat_ws(";", "gene", "trans"), F.col("strand"), starts, stops).alias("line"))
    return rows.where("absorbed_by IS NULL"), rows.where("absorbed_by IS NOT NULL")


def primary_orf_lines(models: DataFrame) -> DataFrame:
    """``models``: ord, value, id_line, trans_start, trans_end. gene_ord and the line of each gene's best model."""
    ids = F.split("id_line", ";")
    rows = models.select("ord", "value", (F.col("trans_end") - F.col("trans_start")).alias("span"), *(F.get(ids, i).alias(n) for i, n in ((0, "gene"), (1, "trans"), (3, "degrade"), (4, "match"), (5, "nmd"))))
    # Of lines that repeat a model the last one counts.
    rows = rows.groupBy("gene", "trans").agg(F.max_by(F.struct("value", "span", "degrade", "match", "nmd"), "ord").alias("x"), F.min("ord").alias("ord")).select("gene", "trans", "ord", "x.*")
    first = rows.groupBy("gene").agg(F.min("ord").alias("gene_ord"))
    return rows.join(reads.primary_orf(rows).select("gene", "trans"), ["gene", "trans"], "left_semi").join(first, "gene").select("gene_ord", F.col("value").alias("line"))


# ---- statistics ------------------------------------------------------------------------------------


def degradation_lines(capped: DataFrame, nocap: DataFrame) -> list[str]:
    """``capped``, ``nocap``: trans, read_id, n_exons of the two runs' reads. The report's 19 lines."""
    one = [reads.degradation_tally(x.withColumn("gene", _gene("trans"))).first() for x in (capped, nocap)]
    signature = reads.degradation_signature(one[0][TALLIES[0][1]], one[1][TALLIES[0][1]]) if one[0][TALLIES[0][1]] else float("nan")
    return [f"Degradation Signature = {shortest(signature)}", *(f"{side} {label} count = {row[c]}" for label, c in TALLIES for side, row in zip(("Capped", "No-cap"), one))]


def saturation_lines(support: DataFrame, bin_size: int) -> DataFrame:
    """``support``: ord, pos, gene, read_id. read_count and line at every ``bin_size``-th read."""
    order = F.struct("ord", "pos")
    first = support.groupBy("read_id").agg(F.min_by("gene", order).alias("gene"), F.min(order).alias("at"))
    # Places within a line stay below 2**24, as a line of a table is a string of bounded size.
    ranked = first.select("read_id", "gene", (F.col("at.ord") * (1 << 24) + F.col("at.pos")).alias("ord"))
    return reads.saturation(ranked, bin_size).select("read_count", _tabs("read_count", "genes"))


def collapse_summary(models: DataFrame, metrics: DataFrame) -> list[str]:
    """The closing counts of a collapse run."""
    m = models.agg(F.countDistinct("gene_no"), F.count(F.lit(1))).first()
    r = metrics.agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    return [f"Total Gene Count:\t{m[0]}", f"Total Transcript Count:\t{m[1]}", f"Total Accepted Reads:\t{r[0]}", f"Total Discarded Reads:\t{r[1]}"]
