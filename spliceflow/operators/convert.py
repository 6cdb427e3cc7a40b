"""Format conversion, identifiers, splitting and read clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gtf_line(source: str, attributes: Column) -> Column:
    s = lambda c: F.col(c).cast("string")
    return F.concat_ws("\t", "scaf", F.lit(source), "feature", s("start"), s("end"), F.lit("."), "strand", F.lit("."), attributes)


def _quoted(pairs: list[tuple[str, str]], tail: str = "") -> Column:
    return F.concat(F.concat_ws(" ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{k} "'), F.col(c).cast("string"), F.lit('";'))) for k, c in pairs)), F.lit(tail))


def bed_to_gtf(m: DataFrame, source: str = "PBRI") -> DataFrame:
    """``m``: ord, gene, trans, scaf, strand, starts, ends (BED). (gene_ord, ord, place, line): gene,
    transcript and exon lines, genes in order of appearance, exons from the left, numbered from the 5' end."""
    # All of a gene's lines are made at once from its models, which lie together by gene where they are dealt so.
    first = Window.partitionBy("gene").orderBy("ord")
    of = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start, end, c = F.col("starts")[0] + 1, F.element_at("ends", -1), F.col
    rows = m.withColumns({
        "nth": F.row_number().over(first), "gene_ord": F.min("ord").over(of), "gene_scaf": F.first("scaf").over(of), "gene_strand": F.first("strand").over(of), "gene_start": F.min(start).over(of), "gene_end": F.max(end).over(of),
    })
    none = F.lit(None)

    def line(feature: str, place: Column, at: Column, to: Column, scaf: str = "scaf", strand: str = "strand", trans: Column = c("trans"), number: Column = none, ord_: Column = c("ord")) -> Column:
        return F.struct(
            ord_.cast("long").alias("ord"), place.cast("int").alias("place"), c(scaf).alias("scaf"), c(strand).alias("strand"), trans.cast("string").alias("trans"), F.lit(feature).alias("feature"), at.cast("long").alias("start"), to.cast("long").alias("end"), number.cast("int").alias("number"),
        )

    head = F.when(c("nth") == 1, F.array(line("gene", F.lit(0), c("gene_start"), c("gene_end"), "gene_scaf", "gene_strand", none, ord_=F.lit(-1)))).otherwise(F.array())
    whole = F.array(line("transcript", F.lit(0), start, end))
    number = lambda k: F.when(c("strand") == "+", k + 1).otherwise(F.size("starts") - k)
    exon = F.transform("starts", lambda s, k: line("exon", k + 1, s + 1, F.get("ends", k), number=number(k)))
    rows = rows.select("gene_ord", "gene", F.explode(F.concat(head, whole, exon)).alias("x")).select("gene_ord", "gene", "x.*")
    return rows.select("gene_ord", "ord", "place", _gtf_line(source, _quoted([("gene_id", "gene"), ("transcript_id", "trans"), ("exon_number", "number"), ("uniq_trans_id", "trans")])).alias("line"))


def _numbered_exons(rows: DataFrame) -> DataFrame:
    x = rows.withColumn("n", F.size("starts")).select("*", F.posexplode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("k", "x"))
    number = F.when(F.col("strand") == "+", F.col("k") + 1).otherwise(F.col("n") - F.col("k"))
    return x.withColumn("number", number).withColumn("start", F.col("x.s") + 1).withColumn("end", F.col("x.e")).drop("x")


def coding_features(exons: DataFrame) -> DataFrame:
    """``exons``: strand, start, end, number, cds_start, cds_end (1-based inclusive; 1 to 0: no CDS), left,
    right (the transcript's). Adds sect, sub, feature, start, end for exon, CDS, codons and UTRs.

    A start codon needs a base of the transcript before it. On the minus strand the 3' UTR takes in
    the stop codon's first base.
    """
    s, e, a, b = (F.col(c) for c in ("start", "end", "cds_start", "cds_end"))
    plus, coding = F.col("strand") == "+", ~((a == 1) & (b == 0))
    beyond, ahead = s > b, a > e
    edge = ~beyond & ~ahead & ~((s > a) & (e < b))
    has_b, has_a = edge & (s < b) & (e >= b), edge & (a > s) & (a <= e)
    lo = F.when(has_a, F.when(plus, a).otherwise(a + 3)).otherwise(s)
    hi = F.when(has_b, F.when(plus, b - 3).otherwise(b)).otherwise(e)
    first = F.when(plus, has_a & (a != F.col("left"))).otherwise(has_b & (b != F.col("right")))
    last = F.when(plus, has_b).otherwise(has_a)
    at_a, at_b = (a, a + 2), (b - 2, b)
    below = F.when(ahead, e).when(has_a, F.when(plus, a - 1).otherwise(a))  # end of what lies left of the CDS
    above = F.when(beyond, s).when(has_b, b + 1)  # start of what lies right of it
    left_utr, right_utr = (below.isNotNull() & (below >= s), s, below), (above.isNotNull() & (above <= e), above, e)

    def row(sect: int, sub: int, name: str, when: Column, x: Column, y: Column) -> Column:
        return F.when(when, F.struct(F.lit(sect).alias("sect"), F.lit(sub).alias("sub"), F.lit(name).alias("feature"), x.cast("long").alias("start"), y.cast("long").alias("end")))

    side = lambda p, q, i: F.when(plus, p[i]).otherwise(q[i])
    found = F.array_compact(F.array(
        row(1, 0, "exon", F.lit(True), s, e),
        row(1, 1, "CDS", coding & ~beyond & ~ahead & (hi >= lo), lo, hi),
        row(1, 2, "start_codon", coding & first, side(at_a, at_b, 0), side(at_a, at_b, 1)),
        row(1, 3, "stop_codon", coding & last, side(at_b, at_a, 0), side(at_b, at_a, 1)),
        row(2, 0, "five_prime_utr", coding & side(left_utr, right_utr, 0), side(left_utr, right_utr, 1), side(left_utr, right_utr, 2)),
        row(3, 0, "three_prime_utr", coding & side(right_utr, left_utr, 0), side(right_utr, left_utr, 1), side(right_utr, left_utr, 2)),
    ))
    return exons.withColumn("y", F.explode(found)).drop("start", "end").select("*", "y.*").drop("y")


def bed_to_gtf_orf(m: DataFrame, source: str = "PBRI", tool: str = "spliceflow") -> DataFrame:
    """``m``: ord, id_line (gene;trans;protein;degrade;match;nmd;..), scaf, strand, starts, ends, cds_start,
    cds_end (BED). (gene_ord, ord, sect, place, sub, line) with coding features, made by ``tool``."""
    ids = F.split("id_line", ";")
    part = lambda i, to: F.coalesce(F.get(ids, i), F.lit("")).alias(to)
    m = m.select(
        "ord", "scaf", "strand", "starts", "ends", (F.col("cds_start") + 1).alias("cds_start"), "cds_end", (F.col("starts")[0] + 1).alias("left"), F.element_at("ends", -1).alias("right"),
        *(part(i, c) for i, c in enumerate(("gene", "trans", "protein", "degrade", "match", "nmd"))), F.lit(tool).alias("made"),
    )
    gene = m.groupBy("gene").agg(F.min("ord").alias("gene_ord"), F.min_by("scaf", "ord").alias("scaf"), F.min_by("strand", "ord").alias("strand"), F.min("left").alias("start"), F.max("right").alias("end"))
    rows = m.join(gene.select("gene", "gene_ord"), "gene")
    flat = lambda sect, place, sub, line: (sect.alias("sect"), place.cast("int").alias("place"), sub.alias("sub"), line.alias("line"))
    zero, gid, tid = F.lit(0), ("gene_id", "gene"), ("transcript_id", "trans")
    made = [("gene_source", "made"), ("transcript_source", "made")]
    head = gene.withColumn("made", F.lit(tool)).withColumn("feature", F.lit("gene")).select("gene_ord", F.lit(-1).cast("long").alias("ord"), *flat(zero, zero, zero, _gtf_line(source, _quoted([gid, made[0]], " "))))
    whole = rows.withColumn("feature", F.lit("transcript")).withColumn("start", F.col("left")).withColumn("end", F.col("right"))
    whole = whole.select("gene_ord", "ord", *flat(zero, zero, zero, _gtf_line(source, _quoted([gid, tid, *made], " "))))
    tags = [("prot_id", "protein"), ("degrade_flag", "degrade"), ("match_flag", "match"), ("nmd_flag", "nmd")]
    part_rows = coding_features(_numbered_exons(rows)).select("gene_ord", "ord", *flat(F.col("sect"), F.col("number"), F.col("sub"), _gtf_line(source, _quoted([gid, tid, ("exon_number", "number"), *made, *tags], " "))))
    return head.unionByName(whole).unionByName(part_rows)


def reshuffle_ids(rows: DataFrame, column: str, order: list[int], delimiter: str = ";") -> DataFrame:
    """Fields of a packed id in the given 1-based order; a missing one is an error."""
    parts = F.split(F.col(column), f"[{delimiter}]")
    need = F.when(F.size(parts) >= max(order), parts).otherwise(F.raise_error(F.lit("an id has too few fields")))
    return rows.withColumn(column, F.array_join(F.array(*(F.element_at(need, i) for i in order)), delimiter))


def ensembl_ids(rows: DataFrame, column: str, packed: bool = False, only_match: bool = False, delimiter: str = ";") -> DataFrame:
    """Ids led by the database's gene and transcript: fields 3 and 4, or with ``packed`` field 3 split at
    its comma. Ids of up to three fields have none and, but for ``packed``, repeat their own;
    ``only_match`` drops rows without. A database id without ENS is an error."""
    parts = F.split(F.col(column), f"\\Q{delimiter}\\E", -1)
    own = [F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))]
    long = F.size(parts) > 3
    pair = F.split(F.get(parts, 2), ",", -1) if packed else F.slice(parts, 3, 2)
    known = long & (F.size(pair) > 1)

    def checked(i: int) -> Column:
        x = F.get(pair, i)
        return F.when(x.contains("ENS"), x).otherwise(F.raise_error(F.concat(F.lit("not an Ensembl id: "), x)))

    alone = [F.when(long, o).otherwise("") for o in own] if packed else own
    lead = [F.when(known, checked(i)).otherwise(alone[i]) for i in (0, 1)]
    behind = 4 if packed else 5
    rest = F.when(long, F.slice(parts, behind, F.size(parts))).otherwise(F.array().cast("array<string>"))
    if only_match:
        rows = rows.where(known | F.lit(packed) & long & own[0].contains("ENS"))
    return rows.withColumn(column, F.array_join(F.concat(F.array(*lead, *own), rest), ";"))


def split_chunks(records: DataFrame, total: int, parts: int) -> DataFrame:
    """Chunk number of each record by its place; there may be fewer chunks than asked for."""
    return records.withColumn("chunk", F.floor(F.col("rec_no") / max(1, -(-total // parts))).cast("long"))


def split_scaffolds(rows: DataFrame, parts: int) -> DataFrame:
    """Whole scaffolds in order of first appearance (ord); a file closes once it holds more than its
    share. Only per-scaffold counts are gathered; their number is the genome's, not the reads'."""
    counts = rows.groupBy("scaf").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("c")).orderBy("first").collect()
    share, plan, file, held = sum(r["c"] for r in counts) / parts, [], 0, 0
    for r in counts:
        if held and held + r["c"] > share:
            file, held = file + 1, 0
        held += r["c"]
        plan.append((r["scaf"], file))
    table = rows.sparkSession.createDataFrame(plan, "scaf string, file long")
    return rows.join(table, "scaf")
