"""Read support, filters and statistics over (gene, trans, source, read_id) rows and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.operators import loci


def support_levels(support: DataFrame) -> DataFrame:
    """gene, trans, gene_reads, trans_reads: distinct reads of the gene and of the model."""
    gene = support.groupBy("gene").agg(F.countDistinct("read_id").alias("gene_reads"))
    return support.groupBy("gene", "trans").agg(F.countDistinct("read_id").alias("trans_reads")).join(gene, "gene")


def support_levels_merged(merge_map: DataFrame, support: DataFrame) -> DataFrame:
    """``merge_map``: gene, trans, source, source_trans. Reads of a model count once over all sources;
    a gene's count is the sum over sources of each one's distinct reads."""
    rows = merge_map.join(support.select("source", F.col("trans").alias("source_trans"), "read_id"), ["source", "source_trans"])
    trans = rows.groupBy("gene", "trans").agg(F.countDistinct("read_id").alias("trans_reads"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source_line"))
    gene = rows.groupBy("gene", "source").agg(F.countDistinct("read_id").alias("c")).groupBy("gene").agg(F.sum("c").alias("gene_reads"))
    return trans.join(gene, "gene")


def support_clusters(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """``members``: gene, trans, cluster; ``clusters``: cluster, read_id. Repeats count at gene level."""
    rows = members.join(clusters, "cluster")
    trans = rows.groupBy("gene", "trans").agg(F.countDistinct("read_id").alias("trans_reads"), F.countDistinct("cluster").alias("n_clusters"))
    return trans.join(rows.groupBy("gene").agg(F.count(F.lit(1)).alias("gene_reads")), "gene")


def single_read(models: DataFrame, support: DataFrame, level: str = "gene", keep_multi: bool = True, min_sources: int = 1, min_reads: int = 2) -> DataFrame:
    """``models``: gene, trans, n_exons. Kept rows. A gene's only model with one source and one read
    goes unless multi-exon ones are kept; at transcript level models also need sources or reads."""
    count = support.groupBy("gene", "trans").agg(F.countDistinct("source").alias("sources"), F.countDistinct("read_id").alias("reads"))
    rows = models.join(count, ["gene", "trans"], "left").fillna(0, ["sources", "reads"]).withColumn("in_gene", F.count(F.lit(1)).over(Window.partitionBy("gene")))
    spared = (F.col("n_exons") > 1) & F.lit(keep_multi)
    alone = (F.col("in_gene") == 1) & (F.col("sources") == 1) & (F.col("reads") == 1) & ~spared
    rows = rows.where(~alone)
    if level == "transcript":
        rows = rows.where((F.col("sources") >= min_sources if min_sources > 1 else F.col("reads") >= min_reads) | spared)
    return rows.select("gene", "trans", "sources", "reads")


def renumbered(models: DataFrame, kept: DataFrame) -> DataFrame:
    """``models``: ord, gene, trans and more. Adds new_gene and new_trans, null for rows that ``kept`` (gene,
    trans) lacks; genes and models keep their order."""
    rows = models.join(kept.select("gene", "trans", F.lit(True).alias("stays")).distinct(), ["gene", "trans"], "left")
    genes = rows.groupBy("gene").agg(F.min("ord").alias("first"), F.max("stays").alias("any")).where("any")
    genes = loci.ranked(genes.select("gene", "first"), ["first"], "place").select("gene", F.concat(F.lit("G"), F.col("place").cast("string")).alias("g"))
    nth = F.sum(F.when(F.col("stays"), 1).otherwise(0)).over(Window.partitionBy("gene").orderBy("ord"))
    rows = rows.withColumn("nth", nth).join(genes, "gene", "left")
    return rows.withColumn("new_gene", F.when(F.col("stays"), F.col("g"))).withColumn("new_trans", F.concat("new_gene", F.lit("."), F.col("nth").cast("string"))).drop("stays", "nth", "g")


def primary_orf(rows: DataFrame) -> DataFrame:
    """``rows``: gene, trans, degrade, match, nmd, span. The best of each gene by score, span, id."""
    points = F.when(F.col("degrade") == "full_length", 1000000).otherwise(0) + F.when(F.col("nmd") == "prot_ok", 10000).otherwise(0)
    match = F.when(F.col("match") == "full_match", 900000).when(F.col("match") == "90_match", 800000).when(F.col("match") == "50_match", 700000).when(F.col("match") == "bad_match", 600000).otherwise(0)
    rows = rows.withColumn("score", points + match)
    best = Window.partitionBy("gene").orderBy(F.desc("score"), F.desc("span"), "trans")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("gene", "trans", "score", "span")


def polya_filter(models: DataFrame, support: DataFrame, polya: DataFrame, percent: float = 75.0, level: str = "gene", action: str = "singleton_polya", keep_multi: bool = False) -> DataFrame:
    """Rows kept. A model is poly-A primed when it has reads and all of them have at least ``percent`` A
    behind them. Primed models go, with ``singleton_polya`` those of one read alone; at gene level only
    a gene's only model goes."""
    reads = support.select("gene", "trans", "source", "read_id").distinct().join(polya.groupBy("source", "read_id").agg(F.max("a_percent").alias("a_percent")), ["source", "read_id"], "left")
    flag = reads.groupBy("gene", "trans").agg(F.count_if(F.col("a_percent") >= percent).alias("hits"), F.countDistinct("read_id").alias("reads"))
    rows = models.join(flag, ["gene", "trans"], "left").fillna(0, ["hits", "reads"])
    few = F.col("reads") == 1 if action == "singleton_polya" else F.lit(True)
    goes = (F.col("reads") > 0) & (F.col("hits") == F.col("reads")) & few & ~((F.col("n_exons") > 1) & F.lit(keep_multi))
    if level == "gene":
        goes = goes & (F.count(F.lit(1)).over(Window.partitionBy("gene")) == 1)
    return rows.withColumn("goes", goes).where("NOT goes").select("gene", "trans", "reads")


def degradation(models: DataFrame, support: DataFrame) -> DataFrame:
    """Of multi-exon genes with more than one read: how many, their models, reads, and models a read."""
    gene = models.groupBy("gene").agg(F.max("n_exons").alias("exons"), F.count(F.lit(1)).alias("models"))
    rows = gene.join(support.groupBy("gene").agg(F.countDistinct("read_id").alias("reads")), "gene")
    multi = (F.col("exons") > 1) & (F.col("reads") > 1)
    return rows.agg(
        F.count(F.lit(1)).alias("genes"), F.sum("models").alias("all_models"), F.count_if(multi).alias("multi_genes"),
        F.coalesce(F.sum(F.when(multi, F.col("models"))), F.lit(0)).alias("multi_models"), F.coalesce(F.sum(F.when(multi, F.col("reads"))), F.lit(0)).alias("multi_reads"),
    )


def degradation_tally(members: DataFrame) -> DataFrame:
    """``members``: gene, trans, read_id, n_exons, one row a read of a model. One row of counts."""
    trans = members.groupBy("gene", "trans").agg(F.max("n_exons").alias("exons"))
    trans = trans.groupBy("gene").agg(F.max("exons").alias("exons"), F.count(F.lit(1)).alias("models"), F.count_if(F.col("exons") == 1).alias("single_models"))
    rows = trans.join(members.groupBy("gene").agg(F.countDistinct("read_id").alias("reads")), "gene")
    single, total = F.col("exons") < 2, lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        total(F.when(~single & (F.col("reads") > 1), F.col("models"))).alias("multi_exon_multi_read_trans"), total("models").alias("trans"), total("single_models").alias("single_exon_trans"),
        total(F.col("models") - F.col("single_models")).alias("multi_exon_trans"), F.count(F.lit(1)).alias("genes"), F.count_if(single).alias("single_exon_genes"), F.count_if(~single).alias("multi_exon_genes"),
        F.count_if(single & (F.col("reads") == 1)).alias("single_exon_single_read_genes"), F.count_if(~single & (F.col("reads") < 2)).alias("multi_exon_single_read_genes"),
    )


def degradation_signature(capped_models: int, nocap_models: int) -> float:
    return (capped_models - nocap_models) / capped_models


def saturation(reads: DataFrame, bin_size: int) -> DataFrame:
    """``reads``: ord, read_id, gene. (read_count, genes) at every ``bin_size``-th read; the genes are
    those of the reads before it. Ranges of reads are counted on their own, so no task gets all reads."""
    first = reads.groupBy("read_id").agg(F.min_by("gene", "ord").alias("gene"), F.min("ord").alias("ord"))
    opens = first.groupBy("gene").agg(F.min("ord").alias("ord")).withColumn("opens", F.lit(1))
    rows = first.join(opens, ["gene", "ord"], "left").select("ord", F.coalesce("opens", F.lit(0)).alias("opens"))
    rows = loci.kept(rows.repartitionByRange("ord").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("ord")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("seen", F.sum("opens").over(inside) - F.col("opens"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.sum("opens").alias("o"))  # one row a task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"), F.coalesce(F.sum("o").over(before), F.lit(0)).alias("o"))
    rows = rows.join(F.broadcast(sizes), "part").select((F.col("nth") + F.col("c")).alias("read_count"), (F.col("seen") + F.col("o")).alias("genes"))
    return rows.where(F.col("read_count") % bin_size == 0)


def model_changes(support: DataFrame, ref: str, alt: str) -> tuple[DataFrame, DataFrame]:
    """(gene changes: reads in more than one gene; model changes: of the others that the reference
    has, reads with models in ``alt`` that it lacks)."""
    reads = support.groupBy("read_id").agg(
        F.collect_set("gene").alias("genes"),
        F.collect_set(F.when(F.col("source") == ref, F.col("trans"))).alias("ref_models"),
        F.collect_set(F.when(F.col("source") == alt, F.col("trans"))).alias("alt_models"),
    )
    genes = reads.where(F.size("genes") > 1).select("read_id", F.array_join(F.array_sort("genes"), ",").alias("genes"))
    new = F.array_sort(F.array_except("alt_models", "ref_models"))
    trans = reads.where((F.size("genes") == 1) & (F.size("ref_models") > 0) & (F.size(new) > 0))
    return genes, trans.select("read_id", F.array_join(new, ",").alias("alt_models"), F.array_join(F.array_sort("ref_models"), ",").alias("ref_models"))


def model_changes_report(support: DataFrame, ref: str, alt: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts: name, n; genes and models that changes touch and only one source has: source, id).
    A model whose gene is listed for its source is not listed again."""
    rows = support.select("gene", "trans", "source", "read_id").distinct()
    n_genes = rows.groupBy("read_id").agg(F.countDistinct("gene").alias("genes"), F.count_if(F.col("source") == ref).alias("in_ref"))
    moved = rows.join(n_genes.where("genes > 1"), "read_id", "left_semi")
    rest = rows.join(n_genes.where("genes = 1 AND in_ref > 0"), "read_id", "left_semi")
    in_ref = rest.where(F.col("source") == ref).select("read_id", "trans")
    new = rest.where(F.col("source") == alt).select("read_id", "trans").join(in_ref, ["read_id", "trans"], "left_anti")
    old = in_ref.join(new, "read_id", "left_semi")
    touched = new.select(F.lit(alt).alias("source"), "trans").unionByName(old.select(F.lit(ref).alias("source"), "trans")).distinct()
    only = lambda key: rows.groupBy(key).agg(F.countDistinct("source").alias("k"), F.min("source").alias("source")).where("k = 1").drop("k")
    one_gene = moved.select("gene").distinct().join(only("gene"), "gene").select("source", "gene")
    one_trans = touched.select("trans").distinct().join(only("trans"), "trans").withColumn("gene", F.substring_index("trans", ".", 1)).join(one_gene, ["source", "gene"], "left_anti").select("source", "trans")
    names = rows.select("source").distinct()

    def by_source(label: str, found: DataFrame) -> DataFrame:
        n = names.join(found.groupBy("source").count(), "source", "left")
        return n.select(F.concat(F.lit(f"{label} "), "source").alias("name"), F.coalesce("count", F.lit(0)).alias("n"))

    whole = lambda label, found: found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("name"), "n")
    counts = whole("num_diff_gene_reads", moved.select("read_id").distinct())
    for part in (
        whole("num_diff_trans_reads", new.select("read_id").distinct()), whole("num_merge_diff_gene", moved.select("gene").distinct()), whole("num_merge_diff_trans", touched.select("trans").distinct()),
        by_source("this_source_diff_genes", moved.select("source", "gene").distinct()), by_source("this_source_diff_trans", touched),
        by_source("only_source_num_genes", one_gene), by_source("only_source_num_trans", one_trans),
        whole("total_one_source_genes_count", one_gene), whole("total_one_source_trans_count", one_trans),
    ):
        counts = counts.unionByName(part)
    return counts, one_gene, one_trans
