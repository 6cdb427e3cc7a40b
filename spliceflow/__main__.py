"""Command line: python -m spliceflow COMMAND INPUT ... -o PREFIX. Outputs are folders of text lines in order."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.operators import cleanup, collapse, convert, merge, orf, reads, reports, variants
from spliceflow.functions.render import bed_line
from spliceflow.sources import annotation, blast, readers


def _write(rows: DataFrame, order: list[str], path: str, header: str | None = None) -> None:
    """Ordered lines; a header is the first line of the first part."""
    rows = rows.orderBy(*order).select("line")
    if header is not None:
        first = rows.sparkSession.createDataFrame([(header,)], "line string").coalesce(1)
        rows = first.union(rows)
    rows.write.mode("overwrite").text(path)


def _write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(path)


def _tabs(rows: DataFrame, *order: str) -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c not in order]
    return rows.withColumn("line", F.concat_ws("\t", *cells))


def _collapse(spark: SparkSession, a: argparse.Namespace) -> None:
    genome = readers.fasta(spark, a.fasta)
    metrics = collapse.read_metrics(readers.sam(spark, a.sam), genome, a.coverage, a.identity, a.icm, a.sjt).cache()
    accepted = collapse.check_single(metrics.where("accepted"))
    models, members = collapse.collapse(accepted, a.cap == "capped", a.five, a.junction, a.three, a.ends == "longest_ends", a.dup == "merge_dup", a.sj == "sj_priority")
    _write(models, ["gene_no", "model_no"], f"{a.out}.bed")
    _write(members, ["ord"], f"{a.out}_trans_read.bed")
    _write(_tabs(collapse.trans_report(models, members), "gene_no", "model_no"), ["gene_no", "model_no"], f"{a.out}_trans_report.txt")
    _write(_tabs(collapse.polya_report(accepted, genome)).withColumn("k", F.col("read_id")), ["k"], f"{a.out}_polya.txt")
    _write_lines(spark, reports.collapse_summary(models, metrics), f"{a.out}_report.txt")


def _merge(spark: SparkSession, a: argparse.Namespace) -> None:
    names = lambda x: tuple(n.strip() for n in (x or "").split(",") if n.strip())
    models, source = merge.merge(merge.manifest(spark, a.filelist, readers.bed12), a.five, a.junction, a.three, names(a.ids), names(a.cds))
    _write(models, ["gene_no", "model_no"], f"{a.out}.bed")
    _write(source, ["gene_no", "model_no", "tx"], f"{a.out}_merge.txt")
    _write(_tabs(merge.trans_report(models, source), "gene_no", "model_no"), ["gene_no", "model_no"], f"{a.out}_trans_report.txt")
    _write(_tabs(merge.gene_report(source), "gene_no"), ["gene_no"], f"{a.out}_gene_report.txt")


def _variants(spark: SparkSession, a: argparse.Namespace) -> None:
    sam, genome = readers.sam(spark, a.sam), readers.fasta(spark, a.fasta)
    found, groups = variants.report(collapse.variation(sam, genome), collapse.read_metrics(sam, genome, a.coverage, a.identity, a.icm).where("accepted"), genome, a.vc)
    _write(_tabs(found), ["scaf", "pos", "vtype", "alt"], f"{a.out}_variants.txt")
    _write(_tabs(groups.select("scaf", "positions", "reads")), ["scaf", "positions"], f"{a.out}_varcov.txt")


def _cleanup(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = cleanup.trim(readers.fasta(spark, a.fasta), a.min_length).cache()
    record = lambda head, body: F.concat(F.lit(">"), head, F.lit("\n"), body)
    _write(rows.where("status = 'pass'").withColumn("line", record(F.col("description"), F.col("trimmed"))), ["rec_no"], f"{a.out}.fa")
    _write(rows.withColumn("line", record(F.concat(F.lit("tail_"), "description"), F.col("tail"))), ["rec_no"], f"{a.out}_tails.fa")
    _write(rows.where("status <> 'pass'").withColumn("line", record(F.concat_ws("\t", "description", "status"), F.col("seq"))), ["rec_no"], f"{a.out}_discarded_reads.txt")
    _write(_tabs(cleanup.tail_histogram(rows)), ["polya_num"], f"{a.out}_polya_flnc_report.txt")


def _to_bed(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(annotation.models(readers.gtf(spark, a.file), a.source), ["gene_ord", "ord"], a.out)


def _to_gtf(spark: SparkSession, a: argparse.Namespace) -> None:
    bed = readers.bed12(spark, a.bed)
    shape = (F.col("scaffold").alias("scaf"), "strand", F.col("exon_starts").alias("starts"), F.col("exon_ends").alias("ends"))
    if a.orf:
        _write(convert.bed_to_gtf_orf(bed.select("ord", "id_line", *shape, "cds_start", "cds_end"), tool=a.tool), ["gene_ord", "ord", "sect", "place", "sub"], a.out)
    else:
        _write(convert.bed_to_gtf(bed.select("ord", F.col("gene_id").alias("gene"), F.split("id_line", ";")[1].alias("trans"), *shape)), ["gene_ord", "ord", "place"], a.out)


def _fastq(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(readers.fastq(spark, a.file).withColumn("line", F.concat(F.lit(">"), "id", F.lit("\n"), "seq")), ["rec_no"], a.out)


def _seek(spark: SparkSession, a: argparse.Namespace) -> None:
    line = F.concat(F.lit(">"), "header", F.coalesce(F.concat(F.lit("\n"), "protein"), F.lit("")))
    _write(orf.seek(readers.fasta(spark, a.file)).withColumn("line", line), ["rec_no", "place"], a.out)


def _blastp(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(_tabs(blast.best_hits(blast.blastp(spark, a.file, a.format)), "ord"), ["ord"], a.out)


def _models(spark: SparkSession, path: str) -> DataFrame:
    return readers.bed12(spark, path).select(
        "ord", "value", "id_line", "strand", F.col("gene_id").alias("gene"), F.get(F.split("id_line", ";"), 1).alias("trans"), F.col("scaffold").alias("scaf"), F.col("exon_starts").alias("starts"),
        F.col("exon_ends").alias("ends"), F.size("exon_starts").alias("n_exons"), "trans_start", "trans_end", "cds_start", "cds_end",
    )


_FILTERED = "old_gene_id\told_trans_id\tsource_line\tnum_reads\tnew_gene_id\tnew_trans_id\tnum_exons"


def _single_read(spark: SparkSession, a: argparse.Namespace) -> None:
    rules = {"keep_multi": a.multi == "keep_multi", "min_sources": a.sources, "min_reads": a.reads}
    kept, gone, report = reports.single_read_files(_models(spark, a.bed), readers.levels(spark, a.read), a.level, **rules)
    _write(kept, ["ord"], f"{a.out}.bed")
    _write(gone, ["ord"], f"{a.out}_singleton.bed")
    _write(report, ["ord"], f"{a.out}_singleton_report.txt", _FILTERED)


def _polya(spark: SparkSession, a: argparse.Namespace) -> None:
    files = [readers.polya_reads(spark, c[1], c[0]) for c in readers.file_list(spark, a.filelist, 2)]
    polya = functools.reduce(DataFrame.unionByName, files)
    rules = {"action": a.support, "keep_multi": a.multi == "keep_multi"}
    kept, gone, report, proof = reports.polya_files(_models(spark, a.bed), readers.levels(spark, a.read), polya, a.percent, a.level, **rules)
    _write(kept, ["ord"], f"{a.out}.bed")
    _write(gone, ["ord"], f"{a.out}_trash_polya.bed")
    _write(report, ["ord"], f"{a.out}_polya_report.txt", _FILTERED)
    _write(proof, ["ord", "at"], f"{a.out}_polya_support.txt", "trans_id\tsource\tread_id\tsource_trans_id\tstrand\tpercent_polya\ta_count\tpolya_seq")


def _fragments(spark: SparkSession, a: argparse.Namespace) -> None:
    kept, gone = reports.fragment_files(_models(spark, a.bed), a.wobble, a.ends, a.percent)
    _write(kept, ["gene_ord", "ord"], f"{a.out}.bed")
    _write(gone, ["gene_ord", "ord"], f"{a.out}_discarded.txt")


def _primary(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(reports.primary_orf_lines(_models(spark, a.bed)), ["gene_ord"], a.out)


def _clusters(spark: SparkSession, a: argparse.Namespace) -> None:
    kind, rows = readers.clusters(spark, a.cluster)
    found = reports.cluster_support(readers.trans_reads(spark, a.collapse), rows, trim=kind == "list")
    _write(found, ["gene_ord", "trans_ord"], a.out, "gene_id\ttrans_id\tgene_num_reads\ttrans_num_reads\tcluster_line")


def _levels(spark: SparkSession, a: argparse.Namespace) -> None:
    files = readers.file_list(spark, a.filelist, 3)
    names = [c[0] for c in files]
    support = functools.reduce(DataFrame.unionByName, [readers.support_reads(spark, c[1], c[2]).withColumn("source", F.lit(c[0])) for c in files])
    merged = None if a.merge == "no_merge" else readers.merge_map(spark, a.merge, a.layout, names[0])
    head = "merge_gene_id\tmerge_trans_id\tgene_read_count\ttrans_read_count\tsource_line\tsupport_line"
    _write(reports.levels_report(support, names, merged), ["trans_ord"], f"{a.out}_read_support.txt", head)


def _merge_support(spark: SparkSession, a: argparse.Namespace) -> None:
    files = readers.file_list(spark, a.filelist, 3)
    if len({c[1] for c in files}) < len(files):
        raise ValueError("a prefix occurs twice")
    support = functools.reduce(DataFrame.unionByName, [readers.cluster_reads(spark, c[2] + c[0]).withColumn("prefix", F.lit(c[1])) for c in files])
    from_ = readers.trans_reads(spark, a.merge).select("ord", "trans", F.substring_index("read_id", "_", 1).alias("prefix"), F.regexp_extract("read_id", "^[^_]*_(.*)$", 1).alias("source_trans"))
    head = "merge_gene_id\tmerge_trans_id\tgene_read_support\ttrans_read_support\tsource_prefix\tsource_trans_line\tsource_read_line"
    _write(reports.merge_collapse(from_, support), ["gene_ord", "trans_ord"], a.out, head)


def _degradation(spark: SparkSession, a: argparse.Namespace) -> None:
    _write_lines(spark, reports.degradation_lines(readers.trans_reads(spark, a.capped), readers.trans_reads(spark, a.nocap)), a.out)


def _saturation(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(reports.saturation_lines(readers.levels(spark, a.report), a.bin), ["read_count"], a.out, "read_count\tgene_count")


def _changes(spark: SparkSession, a: argparse.Namespace) -> None:
    support = readers.levels(spark, a.read)
    names = [r["source"] for r in support.groupBy("source").agg(F.min(F.struct("ord", "pos")).alias("at")).orderBy("at").collect()]
    ref, alt = a.ref or names[0], a.alt or names[-1]
    counts, genes, trans = reads.model_changes_report(support, ref, alt)
    _write(counts.withColumn("line", F.concat_ws(": ", "name", F.col("n").cast("string"))), ["name"], f"{a.out}_diff_report.txt")
    _write(_tabs(genes), ["source", "gene"], f"{a.out}_diff_one_source_genes.txt", "merge_source\tmerge_gene_id")
    _write(_tabs(trans), ["source", "trans"], f"{a.out}_diff_one_source_trans.txt", "merge_source\tmerge_trans_id")
    moved, changed = reads.model_changes(support, ref, alt)
    _write(_tabs(moved), ["read_id"], f"{a.out}_diff_genes.txt", "read_id\tall_gene_line")
    _write(_tabs(changed), ["read_id"], f"{a.out}_diff_trans.txt", "read_id\talt_diff_trans_id_list_line\tref_trans_id_list_line")


def _split_fasta(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.records(spark, a.file, "\n>").where((F.col("ord") > 0) | F.col("value").startswith(">"))
    rows = rows.withColumn("line", F.rtrim(F.when(F.col("ord") == 0, F.col("value")).otherwise(F.concat(F.lit(">"), "value")), F.lit("\n"))).withColumnRenamed("ord", "rec_no").cache()
    cut = convert.split_chunks(rows, rows.count(), a.parts)
    for (chunk,) in cut.select("chunk").distinct().collect():  # at most ``parts`` of them
        _write(cut.where(F.col("chunk") == chunk), ["rec_no"], f"{a.out}_{chunk + 1}.fa")


def _split_sam(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.lines(spark, a.file).where("value <> ''").cache()
    body = rows.where(~F.col("value").startswith("@")).select("ord", F.coalesce(F.get(F.split("value", "\t"), 2), F.lit("")).alias("scaf"), F.col("value").alias("line"))
    head = rows.where(F.col("value").startswith("@")).select(F.lit(-1).alias("first"), "ord", F.col("value").alias("line"))
    first = body.groupBy("scaf").agg(F.min("ord").alias("first"))
    placed = convert.split_scaffolds(body, a.parts).join(first, "scaf").cache()
    for (file,) in placed.select("file").distinct().collect() or [(0,)]:  # at most ``parts`` and one of them
        _write(head.unionByName(placed.where(F.col("file") == file).select("first", "ord", "line")), ["first", "ord"], f"{a.out}_{file + 1}.sam")


def _ids(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _models(spark, a.bed)
    if a.method == "custom":
        rows = convert.reshuffle_ids(rows, "id_line", [int(x) for x in a.reshuffle.split(",")], a.delimiter)
    else:
        rows = convert.ensembl_ids(rows, "id_line", packed=a.method == "ensembl_orf", only_match=a.filter == "only_match", delimiter=a.delimiter)
    c = F.split("value", "\t", -1)
    _write(rows.withColumn("line", F.array_join(F.concat(F.slice(c, 1, 3), F.array("id_line"), F.slice(c, 5, F.size(c))), "\t")), ["ord"], a.out)


def _coding_line(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumn("line", bed_line(c("scaf"), c("id_line"), c("strand"), c("starts"), c("ends"), thick=(c("cds_start"), c("cds_end"))))


def _add_cds(spark: SparkSession, a: argparse.Namespace) -> None:
    c = F.split("value", "\t", -1)
    names = ("id", "frame", "nuc_start", "nuc_end", "rel_start", "rel_end", "subject", "match")
    parsed = readers.lines(spark, a.parse).where(F.trim("value") != "").select(*(F.get(c, i).alias(n) for i, n in enumerate(names)))
    lengths = readers.fasta(spark, a.fasta).select("id", F.length("seq").alias("length"))
    models = _models(spark, a.bed).select("ord", "id_line", "strand", "starts", "ends", "scaf")
    _write(_coding_line(orf.add_cds(models, parsed, lengths, a.stop == "include_stop_codon", a.distance)), ["ord"], a.out)


def _extract_cds(spark: SparkSession, a: argparse.Namespace) -> None:
    models = _models(spark, a.bed).select("ord", "id_line", "strand", "starts", "ends", "scaf", "cds_start", "cds_end")
    _write(_coding_line(orf.coding_models(models, a.stop == "include_stop_codon")), ["ord"], a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spliceflow")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *inputs):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for i in inputs:
            p.add_argument(i)
        p.add_argument("-o", dest="out", required=True)
        return p

    def thresholds(p, five, junction, three):
        for flag, to, n in (("-a", "five", five), ("-m", "junction", junction), ("-z", "three", three)):
            p.add_argument(flag, dest=to, type=int, default=n)

    def acceptance(p):
        p.add_argument("-c", dest="coverage", type=float, default=99.0)
        p.add_argument("-i", dest="identity", type=float, default=85.0)
        p.add_argument("--icm", choices=("ident_cov", "ident_map"), default="ident_cov")

    p = command("collapse", _collapse, "sam", "fasta")
    acceptance(p)
    thresholds(p, 10, 10, 10)
    p.add_argument("-x", dest="cap", choices=("capped", "no_cap"), default="no_cap")
    p.add_argument("-e", dest="ends", choices=("common_ends", "longest_ends"), default="common_ends")
    p.add_argument("-d", dest="dup", choices=("merge_dup", "no_merge"), default="merge_dup")
    p.add_argument("--sj", choices=("no_priority", "sj_priority"), default="no_priority")
    p.add_argument("--sjt", type=int, default=10)
    p = command("merge", _merge, "filelist")
    thresholds(p, 20, 10, 20)
    p.add_argument("-s", dest="ids")
    p.add_argument("--cds")
    p = command("variants", _variants, "sam", "fasta")
    acceptance(p)
    p.add_argument("--vc", type=int, default=5)
    command("cleanup-polya", _cleanup, "fasta").add_argument("-m", dest="min_length", type=int, default=200)
    command("to-bed", _to_bed, "file").add_argument("--source", choices=sorted(annotation.DIALECTS), required=True)
    p = command("to-gtf", _to_gtf, "bed")
    p.add_argument("--orf", action="store_true")
    p.add_argument("--tool", default="spliceflow")
    command("fastq-to-fasta", _fastq, "file")
    command("orf-seek", _seek, "file")
    command("blastp-parse", _blastp, "file").add_argument("-f", dest="format", choices=("uniref", "ensembl"), default="uniref")

    def filtering(p, multi):
        p.add_argument("-r", dest="read", required=True)
        p.add_argument("-l", dest="level", choices=("gene", "transcript"), default="gene")
        p.add_argument("-k", dest="multi", choices=("keep_multi", "remove_multi"), default=multi)

    p = command("filter-single-read", _single_read, "bed")
    filtering(p, "keep_multi")
    p.add_argument("-s", dest="sources", type=int, default=1)
    p.add_argument("-n", dest="reads", type=int, default=2)
    p = command("filter-polya", _polya, "bed")
    filtering(p, "remove_multi")
    p.add_argument("-f", dest="filelist", required=True)
    p.add_argument("-p", dest="percent", type=float, default=75.0)
    p.add_argument("-a", dest="support", choices=("singleton_polya", "all_polya"), default="singleton_polya")
    p = command("filter-fragments", _fragments, "bed")
    for flag, to, n in (("-m", "wobble", 10), ("-e", "ends", 500), ("-s", "percent", 20)):
        p.add_argument(flag, dest=to, type=int, default=n)
    command("filter-primary-orf", _primary, "bed")
    command("support-clusters", _clusters, "collapse", "cluster")
    p = command("support-levels", _levels, "filelist")
    p.add_argument("-m", dest="merge", default="no_merge")
    p.add_argument("--layout", choices=("merged", "cupcake", "filter"), default="merged")
    command("support-merged", _merge_support, "merge", "filelist")
    command("stats-degradation", _degradation, "capped", "nocap")
    command("stats-saturation", _saturation, "report").add_argument("-b", dest="bin", type=int, required=True)
    p = command("stats-model-changes", _changes, "read")
    p.add_argument("--ref")
    p.add_argument("--alt")
    for name, run in (("split-fasta", _split_fasta), ("split-sam", _split_sam)):
        command(name, run, "file").add_argument("-n", dest="parts", type=int, required=True)
    p = command("id-filter", _ids, "bed")
    p.add_argument("-f", dest="filter", choices=("none", "only_match"), default="none")
    p.add_argument("-s", dest="method", choices=("ensembl_merge", "ensembl_orf", "custom"), default="ensembl_merge")
    p.add_argument("-r", dest="reshuffle", default="none")
    p.add_argument("-d", dest="delimiter", default=";")
    p = command("add-cds", _add_cds, "parse", "bed", "fasta")
    p.add_argument("-s", dest="stop", choices=("no_stop_codon", "include_stop_codon"), default="no_stop_codon")
    p.add_argument("-d", dest="distance", type=int, default=50)
    command("extract-cds", _extract_cds, "bed").add_argument("-s", dest="stop", choices=("no_stop_codon", "include_stop_codon"), default="no_stop_codon")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName(f"spliceflow {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
