"""Readers of interchange files as DataFrames with declared schemas; gzip by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Splits whose starts are broadcast; beyond it they are joined like any table.
SPLITS = 100_000


def records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(ord, value): the lines, or what ``separator`` sets apart, by number over all files in order.

    Rows of one split count on from its first; a split starts at what those before it hold.
    """
    read = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    size = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    start = size.select("_f", "_b", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_at"))  # one row a split
    start = F.broadcast(start) if rows.rdd.getNumPartitions() <= SPLITS else start
    return rows.join(start, ["_f", "_b"]).select((F.col("_m") + F.col("_at")).alias("ord"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of a text file by number."""
    return records(spark, path)


def bed12(spark: SparkSession, path: str) -> DataFrame:
    """BED12 with absolute exon bounds; blank lines, comments and track lines are skipped."""
    v = F.col("value")
    rows = lines(spark, path).where((F.trim(v) != "") & ~v.startswith("#") & ~v.startswith("track")).withColumn("c", F.split(v, "\t"))
    rows = rows.withColumn("c", F.when(F.size("c") >= 12, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("fewer than 12 columns: "), v))))
    numbers = lambda i: F.transform(F.split(F.rtrim(F.col("c")[i], F.lit(",")), ","), lambda x: x.cast("long"))
    col = lambda i, t="string": F.col("c")[i].cast(t)
    rows = rows.select(
        "ord", "value", col(0).alias("scaffold"), col(1, "long").alias("trans_start"), col(2, "long").alias("trans_end"), col(3).alias("id_line"), col(4).alias("score"),
        col(5).alias("strand"), col(6, "long").alias("cds_start"), col(7, "long").alias("cds_end"), col(8).alias("rgb"), numbers(10).alias("sizes"), numbers(11).alias("starts"),
    )
    rows = rows.withColumn("exon_starts", F.transform("starts", lambda x: x + F.col("trans_start")))
    rows = rows.withColumn("exon_ends", F.zip_with("exon_starts", "sizes", lambda a, b: a + b))
    ids = F.split("id_line", ";")
    return rows.drop("sizes", "starts").withColumn("gene_id", ids[0]).withColumn("trans_id", F.array_join(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), ";"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows; headers, blank lines and rows of fewer than 11 columns are skipped."""
    if path.endswith(".bam"):
        raise NotImplementedError("BAM input is not supported; convert it to SAM")
    v = F.col("value")
    rows = lines(spark, path).where(~v.startswith("@") & (F.trim(v) != "")).withColumn("c", F.split(v, "\t")).where(F.size("c") >= 11)
    col = lambda i, t="string": F.col("c")[i].cast(t)
    tag = F.regexp_extract(v, r"\tXS:A:([^\t]+)", 1)
    return rows.select(
        "ord", col(0).alias("read_id"), col(1, "int").alias("flag"), col(2).alias("scaffold"), col(3, "long").alias("start_pos"), col(5).alias("cigar"), col(9).alias("seq"),
        F.when(tag != "", tag).alias("xs_strand"),
    )


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, id, description, seq): one row a record, in file order."""
    rows = records(spark, path, "\n>")
    # Only the file's first record still has its mark; what stands before the first mark is no record.
    head = F.col("value").startswith(">")
    rows = rows.where((F.col("ord") > 0) | head).withColumn("value", F.when((F.col("ord") == 0) & head, F.expr("substring(value, 2)")).otherwise(F.col("value")))
    rows = rows.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    title = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    seq = F.upper(F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", ""))
    return rows.select(F.col("ord").alias("rec_no"), F.split(title, r"\s+")[0].alias("id"), title.alias("description"), seq.alias("seq"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, id, seq) of strict four-line records."""
    rows = lines(spark, path).withColumn("rec_no", F.floor(F.col("ord") / 4)).withColumn("k", F.col("ord") % 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return rows.groupBy("rec_no").agg(pick(0).alias("id"), pick(1).alias("seq")).select("rec_no", F.expr("substring(id, 2)").alias("id"), "seq")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF/GFF rows: nine columns and their line number; comments are skipped."""
    v = F.col("value")
    rows = lines(spark, path).where((F.trim(v) != "") & ~v.startswith("#")).withColumn("c", F.split(v, "\t")).where(F.size("c") >= 9)
    names = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
    return rows.select("ord", *(F.col("c")[i].cast("long" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(names)))


def levels(spark: SparkSession, path: str) -> DataFrame:
    """The packed read-support table as (ord, pos, gene, trans, source, read_id) rows; pos is a read's place
    in its line."""
    rows = lines(spark, path).where(~F.col("value").startswith("merge_gene_id") & ~F.col("value").startswith("gene_id") & (F.trim("value") != "")).withColumn("c", F.split("value", "\t"))
    part = rows.select("ord", F.col("c")[0].alias("gene"), F.col("c")[1].alias("trans"), F.posexplode(F.split(F.col("c")[5], ";")).alias("k", "p"))
    read = F.posexplode(F.split(F.expr("substring(p, locate(':', p) + 1)"), ",")).alias("i", "read_id")
    return part.select("ord", "gene", "trans", F.substring_index("p", ":", 1).alias("source"), "k", read).select("ord", (F.col("k") * (1 << 20) + F.col("i")).alias("pos"), "gene", "trans", "source", "read_id")


def trans_reads(spark: SparkSession, path: str) -> DataFrame:
    """(ord, trans, read_id, n_exons) of a BED file of reads, whose ids are model;read."""
    rows = lines(spark, path).where(F.trim("value") != "").withColumn("c", F.split("value", "\t")).where(F.size("c") >= 4)
    ids = F.split(F.col("c")[3], ";")
    return rows.select("ord", ids[0].alias("trans"), F.get(ids, 1).alias("read_id"), F.get("c", 9).cast("int").alias("n_exons"))


def clusters(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(kind, rows ord, cluster, read_id). The first line tells the kind: a BED line of a model is of a run
    without clusters, whose reads are their own ones; one without 12 columns is of a cluster,read list."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"an empty cluster file: {path}")
    cells = first[0].split("\t")
    if len(cells) == 12 and not (cells[3].startswith("G") and cells[3].count(".") == 1):
        raise ValueError(f"neither a list of clusters nor reads of models: {path}")
    rows = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("cluster_id") & ~F.col("value").startswith("from"))
    if len(cells) == 12:
        read = F.coalesce(F.get(F.split(F.split("value", "\t")[3], ";"), 1), F.lit(""))
        return "no_cluster", rows.select("ord", read.alias("cluster"), read.alias("read_id"))
    c = F.split("value", ",")
    return "list", rows.select("ord", c[0].alias("cluster"), F.get(c, 1).alias("read_id"))


def support_reads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(ord, trans, read_id) of any file that names reads: trans_read, ref_anno, read_support or cluster."""
    if kind in ("trans_read", "ref_anno"):
        return trans_reads(spark, path).select("ord", "trans", "read_id")
    if kind == "read_support":
        return levels(spark, path).select((F.col("ord") * (1 << 30) + F.col("pos")).alias("ord"), "trans", "read_id")
    if kind == "cluster":
        rows = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("cluster_id"))
        return rows.select("ord", F.split("value", ",")[0].alias("trans"), F.get(F.split("value", ","), 1).alias("read_id"))
    raise ValueError(f"not a kind of support file: {kind}")


def cluster_reads(spark: SparkSession, path: str) -> DataFrame:
    """(ord, trans, read_id) of a support table by clusters: gene, trans, counts and cluster:read,.. parts."""
    rows = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("gene_id")).withColumn("c", F.split("value", "\t"))
    part = rows.select("ord", F.col("c")[1].alias("trans"), F.posexplode(F.split(F.col("c")[4], ";")).alias("k", "p"))
    read = F.posexplode(F.split(F.get(F.split("p", ":"), 1), ",")).alias("i", "read_id")
    return part.select("ord", "trans", "k", read).select((F.col("ord") * (1 << 30) + F.col("k") * (1 << 15) + F.col("i")).alias("ord"), "trans", "read_id")


def merge_map(spark: SparkSession, path: str, layout: str, first_source: str) -> DataFrame:
    """(ord, gene, trans, source, source_trans) of a merge file: ids of a BED line (merged), two columns with
    a list of models (cupcake) or a filter's report (filter)."""
    rows = lines(spark, path).where(F.trim("value") != "").withColumn("c", F.split("value", "\t"))
    c, first = F.col("c"), F.lit(first_source)
    if layout == "cupcake":
        rows = rows.select("ord", F.substring_index(c[0], ".", 2).alias("gene"), c[0].alias("trans"), F.posexplode(F.split(c[1], ",")).alias("i", "source_trans"))
        return rows.select((F.col("ord") * (1 << 20) + F.col("i")).alias("ord"), "gene", "trans", first.alias("source"), "source_trans")
    if layout == "filter":
        rows = rows.where(~F.col("value").startswith("old_gene_id") & (c[5] != "removed_transcript"))
        return rows.select("ord", c[4].alias("gene"), c[5].alias("trans"), first.alias("source"), c[1].alias("source_trans"))
    if layout != "merged":
        raise ValueError(f"not a layout of a merge file: {layout}")
    rows = rows.select("ord", F.split(c[3], ";").alias("ids")).select("ord", F.col("ids")[0].alias("trans"), F.get("ids", 1).alias("from"))
    source = first if "trans_read.bed" in path else F.regexp_extract("from", "^(.*)_[^_]*$", 1)
    model = F.col("from") if "trans_read.bed" in path else F.substring_index("from", "_", -1)
    return rows.select("ord", F.substring_index("trans", ".", 1).alias("gene"), "trans", source.alias("source"), model.alias("source_trans"))


def polya_reads(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, read_id, a_percent, fields) of a poly-A report; fields is the whole line, of a read that
    stands twice the last one."""
    rows = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("cluster_id"))
    rows = rows.groupBy(F.split("value", "\t")[0].alias("read_id")).agg(F.max_by("value", "ord").alias("fields"))
    return rows.select(F.lit(source).alias("source"), "read_id", F.coalesce(F.expr("try_cast(split(fields, '\t')[3] AS double)"), F.lit(0.0)).alias("a_percent"), "fields")


def file_list(spark: SparkSession, path: str, columns: int) -> list[list[str]]:
    """Rows of a short tab-separated list of files; relative names are sought beside the list."""
    out = []
    for row in spark.read.text(path).collect():
        if row[0].strip():
            cells = row[0].split("\t")
            if len(cells) < columns:
                raise ValueError(f"fewer than {columns} columns: {row[0]}")
            out.append(cells)
    return out
