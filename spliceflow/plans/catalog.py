"""The transcript operators as queries over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.functions import alignment as al
from spliceflow.functions import sequence as sq
from spliceflow.functions.render import bed_line
from spliceflow.operators import cleanup, collapse, convert, fragments, groups, loci, merge, nocap, orf, reads, variants
from spliceflow.plans import views as v
from spliceflow.sources import annotation

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_vote(spark, sf_dir)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.models(v.exons(spark, sf_dir))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.grouped(_models(spark, sf_dir), v.n_rows(spark, sf_dir))


def _dealt(df: DataFrame, spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return groups.dealt(df, v.n_rows(spark, sf_dir), *keys)


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with their gene; the exons are read once."""
    m, n = loci.kept(_models(spark, sf_dir)), v.n_rows(spark, sf_dir)
    exon = m.select("tx", "scaf", "strand", F.explode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("x")).select("tx", "scaf", "strand", "x.s", "x.e")
    return groups.dealt(m, n, "tx").join(groups.dealt(loci.gene_groups(exon, n_rows=n), n, "tx"), "tx")


def _csv(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- loci, genes, equal models ------------------------------------------------------------------


def _locus_sql(test: str) -> str:
    return f"""WITH {v.EXON}, {v.MODEL},
r AS (SELECT tx, scaf, ts, te, max(te) OVER (PARTITION BY scaf ORDER BY ts, te, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM model)
SELECT tx, scaf, CAST(sum(CASE WHEN reach IS NULL OR ts {test} reach THEN 1 ELSE 0 END) OVER (PARTITION BY scaf ORDER BY ts, te, tx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS locus FROM r"""


@query(_locus_sql(">"))
def locus_islands(spark, sf_dir):
    return loci.islands(_models(spark, sf_dir), ["scaf"], "ts", "te", ["te", "tx"], "locus", n_rows=v.n_rows(spark, sf_dir)).select("tx", "scaf", "locus")


@query(_locus_sql(">="))
def locus_islands_strict(spark, sf_dir):
    return loci.islands(_models(spark, sf_dir), ["scaf"], "ts", "te", ["te", "tx"], "locus", touching=False, n_rows=v.n_rows(spark, sf_dir)).select("tx", "scaf", "locus")


@query(f"""WITH {v.EXON},
r AS (SELECT *, max(e) OVER (PARTITION BY scaf, strand ORDER BY s, e, tx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exon),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY scaf, strand ORDER BY s, e, tx, k ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT scaf, strand, CAST(island AS BIGINT) AS island, min(s) AS s, max(e) AS e, count(*) AS n_exons FROM i GROUP BY scaf, strand, island""")
def exon_islands(spark, sf_dir):
    found = loci.islands(v.exons(spark, sf_dir), ["scaf", "strand"], "s", "e", ["e", "tx", "k"], "island", n_rows=v.n_rows(spark, sf_dir))
    return found.groupBy("scaf", "strand", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n_exons"))


_REACH = """pair AS (SELECT DISTINCT a.tx AS a, b.tx AS b FROM exon a JOIN exon b ON a.scaf = b.scaf AND a.strand = b.strand AND a.s <= b.e AND b.s <= a.e),
reach AS (SELECT tx AS id, tx AS node FROM model UNION SELECT reach.id, pair.b FROM reach JOIN pair ON pair.a = reach.node)"""


@query(f"""WITH RECURSIVE {v.EXON}, {v.MODEL}, {_REACH}
SELECT id AS tx, min(node) AS gene FROM reach GROUP BY id""")
def gene_components(spark, sf_dir):
    return loci.gene_groups(v.exons(spark, sf_dir), n_rows=v.n_rows(spark, sf_dir))


_CAPPED = """capped AS (SELECT a.tx AS a, b.tx AS b FROM model a JOIN model b ON a.scaf = b.scaf AND a.strand = b.strand AND a.n = b.n AND a.tx < b.tx
  AND abs(a.ts - b.ts) <= CASE WHEN a.strand = '+' THEN 10 ELSE 5 END AND abs(a.te - b.te) <= CASE WHEN a.strand = '+' THEN 5 ELSE 10 END
  WHERE len(list_filter(range(2, a.n + 1), lambda i: abs(a.starts[i] - b.starts[i]) > 2 OR abs(a.ends[i - 1] - b.ends[i - 1]) > 2)) = 0)"""


@query(f"WITH {v.EXON}, {v.MODEL}, {_CAPPED} SELECT a, b FROM capped")
def capped_pairs(spark, sf_dir):
    return loci.capped_pairs(_models(spark, sf_dir), n_rows=v.n_rows(spark, sf_dir))


_GROUPED = f"""{_CAPPED}, two AS (SELECT a, b FROM capped UNION ALL SELECT b, a FROM capped),
reach AS (SELECT tx AS id, tx AS node FROM model UNION SELECT reach.id, two.b FROM reach JOIN two ON two.a = reach.node),
grouped AS (SELECT id AS tx, min(node) AS model FROM reach GROUP BY id)"""


@query(f"WITH RECURSIVE {v.EXON}, {v.MODEL}, {_GROUPED} SELECT tx, model FROM grouped")
def capped_models(spark, sf_dir):
    return loci.grouped_models(_models(spark, sf_dir), v.n_rows(spark, sf_dir))


def _edges(spark, sf_dir, prio=None) -> DataFrame:
    rows = _dealt(_grouped(spark, sf_dir), spark, sf_dir, "model").select("tx", "model", "strand", "src", "n", F.posexplode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("k", "x"))
    side = F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("x.s").alias("coord")), F.struct(F.lit("e").alias("side"), F.col("x.e").alias("coord"))))
    rows = rows.select("tx", "model", "strand", "src", "n", "k", side.alias("y")).select("tx", "model", "strand", "src", "n", F.col("k").cast("long").alias("k"), "y.side", "y.coord")
    return rows.withColumn("prio", F.lit(0) if prio is None else prio)


_EDGE = """edge AS (SELECT g.model, e.strand, e.src, m.n, e.k - 1 AS k, x.side, CASE WHEN x.side = 's' THEN e.s ELSE e.e END AS coord
  FROM grouped g JOIN exon e ON e.tx = g.tx JOIN model m ON m.tx = g.tx CROSS JOIN (VALUES ('s'), ('e')) AS x(side))"""


def _vote_sql(prio: str, order: str, wobble: str) -> str:
    return f"""WITH RECURSIVE {v.EXON}, {v.MODEL}, {_GROUPED}, {_EDGE},
p AS (SELECT *, {prio} AS prio FROM edge), c AS (SELECT model, k, side, prio, coord, count(*) AS c FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model, k, side ORDER BY prio, {order} CASE WHEN side = 's' THEN coord ELSE -coord END) AS r,
  max(coord) OVER w - min(coord) OVER w AS wobble FROM c WINDOW w AS (PARTITION BY model, k, side{wobble}))
SELECT model, k, side, coord, wobble FROM r WHERE r = 1"""


@query(_vote_sql("0", "c DESC,", ""))
def collapse_vote(spark, sf_dir):
    return loci.vote(_edges(spark, sf_dir), ["model", "k"])


@query(_vote_sql("0", "", ""))
def collapse_longest_ends(spark, sf_dir):
    return loci.vote(_edges(spark, sf_dir), ["model", "k"], outermost=True)


_PRIO = """CASE WHEN (side = 's') = (strand = '+') AND (CASE WHEN strand = '+' THEN k = 0 ELSE k = n - 1 END) THEN CAST(substr(src, 1, 1) AS INTEGER)
  WHEN n > 1 AND (side = 'e') = (strand = '+') AND (CASE WHEN strand = '+' THEN k = n - 1 ELSE k = 0 END) THEN 6 - CAST(substr(src, 1, 1) AS INTEGER)
  ELSE 1 + CAST(substr(src, 1, 1) AS INTEGER) % 3 END"""


@query(_vote_sql(_PRIO, "c DESC,", ", prio"))
def merge_priority_vote(spark, sf_dir):
    p = F.substring("src", 1, 1).cast("int")
    plus = F.col("strand") == "+"
    first, last = F.col("k") == 0, F.col("k") == F.col("n") - 1
    five = ((F.col("side") == "s") == plus) & F.when(plus, first).otherwise(last)
    three = (F.col("n") > 1) & ((F.col("side") == "e") == plus) & F.when(plus, last).otherwise(first)
    prio = F.when(five, p).when(three, 6 - p).otherwise(1 + p % 3)
    return loci.vote(_edges(spark, sf_dir, prio), ["model", "k"], wobble_of_winner=True)


@query(f"""WITH RECURSIVE {v.EXON}, {v.MODEL}, {_GROUPED},
s AS (SELECT DISTINCT g.model, m.src FROM grouped g JOIN model m USING (tx)), rank AS (SELECT src, row_number() OVER (ORDER BY src) AS colour FROM (SELECT DISTINCT src FROM model))
SELECT model, string_agg(src, ',' ORDER BY src) AS sources, count(*) AS n_sources, CASE WHEN count(*) > 1 THEN '200,0,255' ELSE ['255,0,0', '255,100,0', '255,200,0', '200,255,0', '0,255,200'][CAST(max(colour) AS INTEGER)] END AS colour FROM s JOIN rank USING (src) GROUP BY model""")
def merge_sources(spark, sf_dir):
    m = _grouped(spark, sf_dir)
    per = _dealt(m.select("model", "src"), spark, sf_dir, "model").groupBy("model").agg(merge.sources_of().alias("x"))
    names = [r["src"] for r in m.select("src").distinct().collect()]  # a merge's list of sources, given by hand there
    return per.select("model", F.array_join("x", ",").alias("sources"), F.size("x").cast("long").alias("n_sources"), merge.colour(F.col("x"), names).alias("colour"))


@query(f"""WITH {v.EXON}, {v.MODEL},
f AS (SELECT e.tx, e.scaf, e.strand, m.n, CASE WHEN e.strand = '+' THEN m.n - e.k ELSE e.k - 1 END AS i, CASE WHEN e.strand = '+' THEN e.s ELSE -e.e END AS f5, CASE WHEN e.strand = '+' THEN e.e ELSE -e.s END AS f3 FROM exon e JOIN model m USING (tx)),
top AS (SELECT tx, scaf, strand, n, min(f5) AS far, max(f3) AS near FROM f GROUP BY ALL),
p AS (SELECT a.tx AS a, b.tx AS b, a.n AS na, least(a.n, b.n) AS m FROM top a JOIN top b ON a.scaf = b.scaf AND a.strand = b.strand AND abs(a.near - b.near) <= 5 AND a.tx <> b.tx
  AND (a.n > b.n OR (a.n = b.n AND (a.far < b.far OR (a.far = b.far AND a.tx < b.tx))))),
x AS (SELECT p.a, p.b, bool_and(abs(x.f3 - y.f3) <= CASE WHEN x.i = 0 THEN 5 ELSE 2 END AND
  CASE WHEN x.i < m - 1 THEN abs(x.f5 - y.f5) <= 2 ELSE abs(x.f5 - y.f5) <= CASE WHEN x.i = na - 1 THEN 10 ELSE 2 END OR x.f5 < y.f5 END) AS ok
  FROM p JOIN f x ON x.tx = p.a JOIN f y ON y.tx = p.b AND y.i = x.i GROUP BY p.a, p.b)
SELECT a AS long_tx, b AS short_tx FROM x WHERE ok""")
def nocap_pairs(spark, sf_dir):
    return loci.loose_pairs(_models(spark, sf_dir).withColumn("capped", F.lit(False)))


@query(f"WITH {v.EXON}, {v.MODEL} SELECT scaf, strand, min(tx) AS tx, count(*) AS members, array_to_string(starts, ',') AS starts, array_to_string(ends, ',') AS ends FROM model GROUP BY scaf, strand, starts, ends")
def model_dedup(spark, sf_dir):
    m = _models(spark, sf_dir).select(F.col("scaf").alias("gene"), "scaf", "strand", "starts", "ends", F.col("tx").alias("tie"), F.col("tx").alias("model"))
    m = collapse.joined_duplicates(_dealt(m, spark, sf_dir, "scaf", "strand", "starts", "ends"))
    return m.select("scaf", "strand", F.col("model").alias("tx"), F.size("all").cast("long").alias("members"), _csv("starts").alias("starts"), _csv("ends").alias("ends"))


@query(f"""WITH {v.EXON}, {v.MODEL} SELECT tx, concat_ws(chr(9), scaf, ts, te, 'G' || tx || ';G' || tx || '.1', '40', strand, ts, te, '255,0,0', n,
  array_to_string(list_transform(range(1, n + 1), lambda i: ends[i] - starts[i]), ','), array_to_string(list_transform(starts, lambda x: x - ts), ',')) AS line FROM model""")
def bed12_render(spark, sf_dir):
    t = F.col("tx").cast("string")
    return _models(spark, sf_dir).select("tx", bed_line(F.col("scaf"), F.concat(F.lit("G"), t, F.lit(";G"), t, F.lit(".1")), F.col("strand"), F.col("starts"), F.col("ends")).alias("line"))


_ID = "'gene_id \"G' || gene || '\";'"


@query(f"""WITH RECURSIVE {v.EXON}, {v.MODEL}, {_GROUPED}, m AS (SELECT g.model AS gene, model.* FROM model JOIN grouped g USING (tx)), f AS (SELECT *, first_value(scaf) OVER w AS gs, first_value(strand) OVER w AS gd FROM m WINDOW w AS (PARTITION BY gene ORDER BY tx)),
x AS (SELECT gene, CAST(-1 AS BIGINT) AS ord, CAST(0 AS INTEGER) AS place, any_value(gs) AS scaf, any_value(gd) AS strand, 'gene' AS feature, min(ts) + 1 AS a, max(te) AS b, {_ID} AS att FROM f GROUP BY gene
UNION ALL SELECT gene, tx, 0, scaf, strand, 'transcript', ts + 1, te, {_ID} || ' transcript_id "T' || tx || '"; uniq_trans_id "T' || tx || '";' FROM m
UNION ALL SELECT m.gene, m.tx, CAST(e.k AS INTEGER), m.scaf, m.strand, 'exon', e.s + 1, e.e, {_ID} || ' transcript_id "T' || m.tx || '"; exon_number "' || CASE WHEN m.strand = '+' THEN e.k ELSE m.n - e.k + 1 END || '"; uniq_trans_id "T' || m.tx || '";' FROM m JOIN exon e ON e.tx = m.tx)
SELECT gene, ord, place, concat_ws(chr(9), scaf, 'PBRI', feature, a, b, '.', strand, '.', att) AS line FROM x""")
def bed2gtf_features(spark, sf_dir):
    m = _grouped(spark, sf_dir).select(F.col("tx").alias("ord"), F.concat(F.lit("G"), F.col("model").cast("string")).alias("gene"), F.concat(F.lit("T"), F.col("tx").cast("string")).alias("trans"), "scaf", "strand", "starts", "ends")
    lines = convert.bed_to_gtf(_dealt(m, spark, sf_dir, "gene"))
    return lines.select(F.regexp_extract("line", 'gene_id "G([0-9]+)"', 1).cast("long").alias("gene"), "ord", "place", "line")


@query(f"WITH {v.EXON}, {v.MODEL} SELECT tx, scaf, strand, array_to_string(starts, ',') AS starts, array_to_string(ends, ',') AS ends FROM model")
def gtf2bed_roundtrip(spark, sf_dir):
    name = lambda c: F.concat(F.lit(c), F.col("tx").cast("string"))
    m = _models(spark, sf_dir).select(F.col("tx").alias("ord"), name("G").alias("gene"), name("T").alias("trans"), "scaf", "strand", "starts", "ends")
    m = _dealt(m, spark, sf_dir, "gene")
    c = F.split("line", "\t")
    # Lines are read as from a file, and those of a gene dealt anew.
    rows = convert.bed_to_gtf(m).select(
        (F.col("gene_ord") * 64 + F.col("place") + (F.col("ord") >= 0).cast("int")).alias("ord"),
        *(c[i].cast("long" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"))),
    )
    # The gene's own line names no model, which this dialect takes as an error.
    m = annotation.models(rows.where("feature <> 'gene'"), "cupcake", v.n_rows(spark, sf_dir))
    return m.select(F.regexp_extract("id_line", "T([0-9]+)$", 1).cast("long").alias("tx"), F.col("scaffold").alias("scaf"), "strand", _csv("starts").alias("starts"), _csv("ends").alias("ends"))


@query()
def fragments_absorb(spark, sf_dir):
    return fragments.absorb_fragments(_genes(spark, sf_dir), n_rows=v.n_rows(spark, sf_dir))


# ---- alignments, sequences, reading frames --------------------------------------------------------

_CIGAR = """cig AS (SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey AS id, l_linenumber, l_extendedprice,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M' || CAST(l_linenumber AS VARCHAR) || 'I' || CAST(l_partkey % 5 + 1 AS VARCHAR) || 'M' || CAST(l_suppkey % 90 + 10 AS VARCHAR) || 'N' || CAST(l_partkey % 40 + 1 AS VARCHAR) || 'M' AS cigar FROM lineitem)"""


def _cigars(spark, sf_dir) -> DataFrame:
    li = v.read(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("long").cast("string")
    text = F.concat(s(F.col("l_quantity")), F.lit("M"), s(F.col("l_linenumber")), F.lit("I"), s(F.col("l_partkey") % 5 + 1), F.lit("M"), s(F.col("l_suppkey") % 90 + 10), F.lit("N"), s(F.col("l_partkey") % 40 + 1), F.lit("M"))
    return li.select((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"), "l_linenumber", "l_extendedprice", text.alias("cigar"))


@query(f"""WITH {_CIGAR}, t AS (SELECT id, l_linenumber, l_extendedprice, unnest(regexp_extract_all(cigar, '[0-9]+[MIN]')) AS op FROM cig)
SELECT id, l_linenumber, l_extendedprice, CAST(sum(CASE WHEN op LIKE '%I' THEN 0 WHEN op LIKE '%N' THEN 0 ELSE CAST(regexp_extract(op, '[0-9]+') AS BIGINT) END) AS BIGINT) AS mapped, count(*) AS ops FROM t GROUP BY ALL""")
def cigar_tokens(spark, sf_dir):
    rows = _cigars(spark, sf_dir).withColumn("ops", al.cigar_ops(F.col("cigar"))).groupBy("id", "l_linenumber", "l_extendedprice")
    return rows.agg(F.sum(al.mapped_length(F.col("ops"))).alias("mapped"), F.sum(F.size("ops")).cast("long").alias("ops"))


@query(f"""WITH {_CIGAR}, n AS (SELECT id, l_linenumber, l_extendedprice, list_transform(regexp_extract_all(cigar, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS a FROM cig)
SELECT id, l_linenumber, l_extendedprice, '100,' || (100 + a[1] + a[3] + a[4]) AS starts, (100 + a[1] + a[3]) || ',' || (100 + a[1] + a[3] + a[4] + a[5]) AS ends FROM n""")
def cigar_exons(spark, sf_dir):
    rows = _cigars(spark, sf_dir).withColumn("x", al.exons(al.cigar_ops(F.col("cigar")), F.lit(100)))
    return rows.select("id", "l_linenumber", "l_extendedprice", _csv("x.starts").alias("starts"), _csv("x.ends").alias("ends"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) * 40 AS len, l_partkey % 9 AS soft, l_suppkey % 5 AS hard, l_linenumber AS ins, l_partkey % 7 AS dele, l_suppkey % 11 AS mis FROM lineitem),
m AS (SELECT *, floor((len - hard - soft) / len * 100 * 100 + 0.5) / 100 AS cov, floor((len - hard - soft - ins - dele - mis) / len * 100 * 100 + 0.5) / 100 AS ident FROM r)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cov, ident, CASE WHEN cov >= 99.0 AND ident >= 85.0 THEN 'accepted' ELSE 'discarded' END AS accept_flag FROM m""")
def read_accept(spark, sf_dir):
    r = v.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity").cast("long") * 40).alias("len"), (F.col("l_partkey") % 9).alias("soft"),
        (F.col("l_suppkey") % 5).alias("hard"), F.col("l_linenumber").alias("ins"), (F.col("l_partkey") % 7).alias("dele"), (F.col("l_suppkey") % 11).alias("mis"),
    )
    c = F.col
    r = r.withColumn("cov", al.round2(al.coverage(c("len"), c("hard"), c("soft")))).withColumn("ident", al.round2(al.identity(c("len"), c("hard"), c("soft"), c("ins"), c("dele"), c("mis"))))
    return r.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cov", "ident", F.when((c("cov") >= 99.0) & (c("ident") >= 85.0), "accepted").otherwise("discarded").alias("accept_flag"))


_FLAGS = "r AS (SELECT event_id, [0, 16, 4, 256, 2048, 7][CAST(event_id % 6 AS INTEGER) + 1] AS flag, CASE WHEN user_id % 3 = 0 THEN '+' WHEN user_id % 3 = 1 THEN '-' END AS xs FROM events)"


@query(f"WITH {_FLAGS} SELECT event_id, CASE flag WHEN 0 THEN '+' ELSE '-' END || xs AS strands FROM r WHERE (flag = 0 AND xs = '-') OR (flag = 16 AND xs = '+')")
def strand_check(spark, sf_dir):
    sam = _flags(spark, sf_dir).select(F.col("event_id").alias("read_id"), "flag", F.col("xs").alias("xs_strand"), F.lit("c").alias("scaffold"), F.lit(1).alias("start_pos"), F.lit("1M").alias("cigar"))
    return collapse.strand_conflicts(sam).select(F.col("read_id").alias("event_id"), "strands")


def _flags(spark, sf_dir) -> DataFrame:
    flag = F.element_at(F.array(*map(F.lit, (0, 16, 4, 256, 2048, 7))), (F.col("event_id") % 6).cast("int") + 1)
    return v.read(spark, sf_dir, "events").select("event_id", flag.alias("flag"), F.when(F.col("user_id") % 3 == 0, "+").when(F.col("user_id") % 3 == 1, "-").alias("xs"))


@query(f"""WITH {_FLAGS} SELECT CASE flag WHEN 0 THEN 'forward_strand' WHEN 16 THEN 'reverse_strand' WHEN 4 THEN 'unmapped' WHEN 256 THEN 'not_primary' WHEN 2048 THEN 'chimeric' ELSE 'unknown' END AS flag_class, count(*) AS n_reads FROM r GROUP BY 1""")
def sam_flag_classes(spark, sf_dir):
    return _flags(spark, sf_dir).groupBy(al.flag_class(F.col("flag")).alias("flag_class")).agg(F.count(F.lit(1)).alias("n_reads"))


_RC = "translate(reverse({}), 'ACGTacgtNnRYSWKMBVDH', 'TGCAtgcaNnYRSWMKVBHD')"


@query(f"""WITH {v.SEQ}, w AS (SELECT id, CASE WHEN id % 2 = 0 THEN substr(seq, 41, 20) ELSE {_RC.format("substr(seq, 21, 20)")} END AS downstream FROM seqs WHERE length(seq) >= 60)
SELECT id, downstream, CAST(length(downstream) - length(replace(downstream, 'A', '')) AS BIGINT) AS a_count FROM w""")
def polya_window(spark, sf_dir):
    s = v.sequences(spark, sf_dir).where(F.length("seq") >= 60)
    w = sq.polya_window(F.col("seq"), F.lit(40), F.lit(40), F.when(F.col("id") % 2 == 0, "+").otherwise("-"))
    return s.select("id", w.alias("downstream")).select("id", "downstream", sq.a_count(F.col("downstream")).cast("long").alias("a_count"))


@query(f"WITH {v.SEQ} SELECT id, {_RC.format('seq')} AS rc FROM seqs")
def revcomp(spark, sf_dir):
    return v.sequences(spark, sf_dir).select("id", sq.reverse_complement(F.col("seq")).alias("rc"))


_CODE = "code AS (SELECT " + "map {" + ", ".join(f"'{c}': '{a}'" for c, a in sq.CODONS.items()) + "} AS m)"
_FRAMES = f"""{v.SEQ}, {_CODE}, frames AS (SELECT id, f + 1 AS frame, CASE WHEN (length(seq) - f) // 3 > 0 THEN array_to_string(list_transform(range(0, (length(seq) - f) // 3), lambda i: m[substr(seq, CAST(i * 3 + f + 1 AS BIGINT), 3)]), '') ELSE '' END AS protein
  FROM seqs, code, (SELECT unnest([0, 1, 2]) AS f))"""


@query(f"WITH {_FRAMES} SELECT id, CAST(frame AS INTEGER) AS frame, protein FROM frames")
def translate_frames(spark, sf_dir):
    return orf.frames(v.sequences(spark, sf_dir))


@query(f"""WITH {_FRAMES}, p AS (SELECT id, frame, string_split(protein, '$') AS x FROM frames), q AS (SELECT id, frame, unnest(x) AS seg, unnest(range(0, len(x))) AS k, len(x) AS n FROM p),
b AS (SELECT *, coalesce(sum(length(seg) + 1) OVER (PARTITION BY id, frame ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
o AS (SELECT DISTINCT id, frame, before + a AS start, before + length(seg) AS stop, length(seg) - a + 1 AS length FROM (
  SELECT *, 1 AS a FROM b WHERE k = 0 AND length(seg) > 0 AND k < n - 1 UNION ALL SELECT *, instr(seg, 'M') AS a FROM b WHERE instr(seg, 'M') > 0 AND k < n - 1)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY length DESC) AS rank FROM o)
SELECT id, CAST(frame AS INTEGER) AS frame, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(length AS BIGINT) AS length, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def orf_top4(spark, sf_dir):
    return orf.top_orfs(orf.orfs(v.sequences(spark, sf_dir), longest=4))


@query(f"""WITH {v.EXON}, {v.MODEL},
p AS (SELECT m.*, tx % 7 AS n1, tx % 7 + 20 AS n2, (SELECT sum(x.e - x.s) FROM exon x WHERE x.tx = m.tx) AS len FROM model m),
w AS (SELECT *, CASE WHEN strand = '+' THEN n1 ELSE len - (n2 - 2) END AS f, CASE WHEN strand = '+' THEN n2 - 2 ELSE len - n1 END AS t FROM p),
x AS (SELECT tx, k - 1 AS i, s, e, coalesce(sum(e - s) OVER (PARTITION BY tx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(e - s) OVER (PARTITION BY tx ORDER BY k ROWS UNBOUNDED PRECEDING) AS z FROM exon),
h AS (SELECT w.tx, coalesce(arg_max(i, i) FILTER (f >= a AND f < z), 0) AS si, coalesce(arg_max(s + f - a, i) FILTER (f >= a AND f < z), 0) AS cs, coalesce(arg_max(i, i) FILTER (t >= a AND t <= z), 0) AS ei, coalesce(arg_max(s + t - a, i) FILTER (t >= a AND t <= z), 0) AS ce FROM w JOIN x ON x.tx = w.tx GROUP BY w.tx),
g AS (SELECT h.*, w.strand, n - 1 - ei AS tail, CASE WHEN strand = '+' THEN n - 1 - ei > 0 AND starts[-1] - ce > 50 ELSE si > 0 AND cs - ends[1] > 50 END AS far FROM h JOIN w USING (tx))
SELECT tx, CAST(CASE WHEN tx % 5 = 0 OR tx % 11 = 0 THEN 0 ELSE cs END AS BIGINT) AS cds_start, CAST(CASE WHEN tx % 5 = 0 OR tx % 11 = 0 THEN 0 ELSE ce END AS BIGINT) AS cds_end,
  CASE WHEN tx % 11 = 0 THEN 'T' || tx || ';none;missing;no_orf;missing;na' WHEN tx % 5 = 0 THEN 'T' || tx || ';P' || tx || ';missing;missing_nucleotides;missing;missing'
  ELSE 'T' || tx || ';P' || tx || ';' || CASE WHEN tx % 3 = 1 THEN '5prime_degrade' ELSE 'full_length' END || ';full_match;' || CASE WHEN far THEN 'NMD' || CASE WHEN strand = '+' THEN tail ELSE si END ELSE 'prot_ok' END || ';F1' END AS id_line FROM g""")
def cds_project(spark, sf_dir):
    m = _models(spark, sf_dir).withColumn("id_line", F.concat(F.lit("T"), F.col("tx").cast("string")))
    sizes = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    match = F.when(F.col("tx") % 5 == 0, "missing_nucleotides").otherwise("full_match")
    parsed = m.where("tx % 11 <> 0").select(F.col("id_line").alias("id"), F.lit("F1").alias("frame"), (F.col("tx") % 7).alias("nuc_start"), (F.col("tx") % 7 + 20).alias("nuc_end"), (F.col("tx") % 3).alias("rel_start"), F.concat(F.lit("P"), F.col("tx").cast("string")).alias("subject"), match.alias("match"))
    lengths = m.select(F.col("id_line").alias("id"), sizes.alias("length"))
    done = orf.add_cds(m.select("tx", "id_line", "strand", "starts", "ends"), parsed, lengths)
    return done.select("tx", F.col("cds_start").cast("long").alias("cds_start"), F.col("cds_end").cast("long").alias("cds_end"), "id_line")


@query(f"""WITH {v.EXON}, {v.MODEL}, c AS (SELECT tx, ts + tx % 15 AS a, te - tx % 25 AS b FROM model),
x AS (SELECT e.tx, e.k, greatest(s, a) AS s, least(e.e, b) AS e FROM exon e JOIN c ON c.tx = e.tx)
SELECT tx, string_agg(s, ',' ORDER BY k) AS starts, string_agg(e, ',' ORDER BY k) AS ends FROM x WHERE s < e GROUP BY tx""")
def cds_extract(spark, sf_dir):
    m = _models(spark, sf_dir).withColumn("cds_start", F.col("ts") + F.col("tx") % 15).withColumn("cds_end", F.col("te") - F.col("tx") % 25).withColumn("id_line", F.col("tx").cast("string"))
    return orf.coding_models(m).select("tx", _csv("starts").alias("starts"), _csv("ends").alias("ends"))


# ---- read support, filters, statistics -------------------------------------------------------------


@query("""WITH r AS (SELECT p_size AS gene, p_partkey AS trans, CAST(p_retailprice * 100 AS BIGINT) AS span, (CASE WHEN p_partkey % 3 = 0 THEN 1000000 ELSE 0 END) + (CASE WHEN p_partkey % 2 = 0 THEN 10000 ELSE 0 END) + [900000, 800000, 700000, 600000][CAST(p_partkey % 4 AS INTEGER) + 1] AS score FROM part)
SELECT CAST(gene AS BIGINT) AS gene, trans, CAST(score AS INTEGER) AS score, span FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, span DESC, trans) AS r FROM r) WHERE r = 1""")
def primary_rank(spark, sf_dir):
    p = v.read(spark, sf_dir, "part")
    match = F.element_at(F.array(*map(F.lit, ("full_match", "90_match", "50_match", "bad_match"))), (F.col("p_partkey") % 4).cast("int") + 1)
    rows = p.select(
        F.col("p_size").cast("long").alias("gene"), F.col("p_partkey").alias("trans"), (F.col("p_retailprice") * 100).cast("long").alias("span"), match.alias("match"),
        F.when(F.col("p_partkey") % 3 == 0, "full_length").otherwise("5prime_degrade").alias("degrade"), F.when(F.col("p_partkey") % 2 == 0, "prot_ok").otherwise("NMD1").alias("nmd"),
    )
    return reads.primary_orf(rows)


def _support_models(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = v.support(spark, sf_dir)
    return s.select("gene", "trans").distinct().withColumn("n_exons", F.col("trans") % 3 + 1), s


_SM = f"{v.SUPPORT}, models AS (SELECT DISTINCT gene, trans, trans % 3 + 1 AS n_exons FROM support)"
_SC = "c AS (SELECT gene, trans, n_exons, count(DISTINCT source) AS sources, count(DISTINCT read_id) AS reads, count(*) OVER (PARTITION BY gene) AS in_gene FROM models JOIN support USING (gene, trans) GROUP BY gene, trans, n_exons)"


@query(f"WITH {_SM}, {_SC} SELECT gene, trans, sources, reads FROM c WHERE NOT (in_gene = 1 AND sources = 1 AND reads = 1 AND n_exons = 1)")
def single_read_gene(spark, sf_dir):
    return reads.single_read(*_support_models(spark, sf_dir))


@query(f"WITH {_SM}, {_SC} SELECT gene, trans, sources, reads FROM c WHERE NOT (in_gene = 1 AND sources = 1 AND reads = 1 AND n_exons = 1) AND (reads >= 60 OR n_exons > 1)")
def single_read_transcript(spark, sf_dir):
    return reads.single_read(*_support_models(spark, sf_dir), level="transcript", min_reads=60)


@query(f"""WITH {_SM}, pa AS (SELECT event_type AS source, event_id AS read_id, value AS a_percent FROM events),
f AS (SELECT gene, trans, min(CASE WHEN coalesce(a_percent >= 10, false) THEN 1 ELSE 0 END) AS primed, count(DISTINCT read_id) AS reads FROM support LEFT JOIN pa USING (source, read_id) GROUP BY gene, trans),
g AS (SELECT *, min(primed) OVER (PARTITION BY gene) AS all_primed FROM f JOIN models USING (gene, trans)) SELECT gene, trans, reads FROM g WHERE primed = 0 OR n_exons > 1""")
def polya_filter(spark, sf_dir):
    m, s = _support_models(spark, sf_dir)
    pa = v.read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("read_id"), F.col("value").alias("a_percent"))
    return reads.polya_filter(m, s, pa, percent=10.0, level="transcript", action="all", keep_multi=True)


@query(f"""WITH {v.SUPPORT}, g AS (SELECT gene, count(DISTINCT read_id) AS gene_reads FROM support GROUP BY gene)
SELECT gene, trans, gene_reads, count(DISTINCT read_id) AS trans_reads FROM support JOIN g USING (gene) GROUP BY ALL""")
def support_levels(spark, sf_dir):
    return reads.support_levels(v.support(spark, sf_dir))


_MM = f"{v.SUPPORT}, mm AS (SELECT DISTINCT trans // 20 AS gene, trans // 4 AS trans, source, trans AS source_trans FROM support), j AS (SELECT mm.gene, mm.trans, mm.source, s.read_id FROM mm JOIN support s ON s.source = mm.source AND s.trans = mm.source_trans)"


@query(f"""WITH {_MM}, g AS (SELECT gene, CAST(sum(c) AS BIGINT) AS gene_reads FROM (SELECT gene, source, count(DISTINCT read_id) AS c FROM j GROUP BY ALL) GROUP BY gene)
SELECT j.gene, j.trans, gene_reads, count(DISTINCT read_id) AS trans_reads, string_agg(DISTINCT source, ',' ORDER BY source) AS source_line FROM j JOIN g ON g.gene = j.gene GROUP BY ALL""")
def support_levels_merge(spark, sf_dir):
    s = v.support(spark, sf_dir)
    mm = s.select(F.floor(F.col("trans") / 20).alias("gene"), F.floor(F.col("trans") / 4).alias("trans"), "source", F.col("trans").alias("source_trans")).distinct()
    return reads.support_levels_merged(mm, s)


@query(f"""WITH {v.SUPPORT}, j AS (SELECT DISTINCT gene, trans, read_id // 3 AS cluster FROM support), r AS (SELECT j.gene, j.trans, j.cluster, c.read_id FROM j JOIN (SELECT event_id // 3 AS cluster, event_id AS read_id FROM events) c USING (cluster)),
g AS (SELECT gene, count(*) AS gene_reads FROM r GROUP BY gene) SELECT r.gene, r.trans, count(DISTINCT read_id) AS trans_reads, count(DISTINCT cluster) AS n_clusters, gene_reads FROM r JOIN g ON g.gene = r.gene GROUP BY ALL""")
def support_cluster(spark, sf_dir):
    s = v.support(spark, sf_dir)
    members = s.select("gene", "trans", F.floor(F.col("read_id") / 3).alias("cluster")).distinct()
    return reads.support_clusters(members, v.read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("cluster"), F.col("event_id").alias("read_id")))


@query(f"""WITH {_SM}, g AS (SELECT gene, max(n_exons) AS exons, count(*) AS models FROM models GROUP BY gene), r AS (SELECT gene, count(DISTINCT read_id) AS reads FROM support GROUP BY gene)
SELECT count(*) AS genes, CAST(sum(models) AS BIGINT) AS all_models, CAST(count_if(exons > 1 AND reads > 1) AS BIGINT) AS multi_genes, CAST(coalesce(sum(models) FILTER (exons > 1 AND reads > 1), 0) AS BIGINT) AS multi_models,
CAST(coalesce(sum(reads) FILTER (exons > 1 AND reads > 1), 0) AS BIGINT) AS multi_reads FROM g JOIN r USING (gene)""")
def degradation(spark, sf_dir):
    return reads.degradation(*_support_models(spark, sf_dir))


@query("""WITH f AS (SELECT event_id, user_id AS gene, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS opens FROM events),
r AS (SELECT row_number() OVER (ORDER BY event_id) AS read_count, coalesce(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS genes FROM f)
SELECT read_count, CAST(genes AS BIGINT) AS genes FROM r WHERE read_count % 20 = 0""")
def saturation_curve(spark, sf_dir):
    e = v.read(spark, sf_dir, "events")
    return reads.saturation(e.select(F.col("event_id").alias("ord"), F.col("event_id").alias("read_id"), F.col("user_id").alias("gene")), 20)


# Every event counts: two thirds have one source, the others both.
_CH = "s AS (SELECT user_id // 5 AS gene, user_id AS trans, unnest(CASE event_id % 6 WHEN 0 THEN ['ref', 'alt'] WHEN 3 THEN ['ref', 'alt'] WHEN 2 THEN ['ref'] WHEN 4 THEN ['ref'] ELSE ['alt'] END) AS source, CASE WHEN user_id % 2 = 0 THEN event_id // 4 % 700 ELSE 100000 + (user_id // 5) * 10 + event_id % 7 END AS read_id FROM events)"


def _change_rows(spark, sf_dir) -> DataFrame:
    e = v.read(spark, sf_dir, "events")
    source = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("ref"), F.lit("alt"))).when(F.col("event_id") % 2 == 0, F.array(F.lit("ref"))).otherwise(F.array(F.lit("alt")))
    rows = e.select(F.floor(F.col("user_id") / 5).alias("gene"), F.col("user_id").alias("trans"), F.explode(source).alias("source"), F.when(F.col("user_id") % 2 == 0, F.floor(F.col("event_id") / 4) % 700).otherwise(F.floor(F.col("user_id") / 5) * 10 + F.col("event_id") % 7 + 100000).alias("read_id"))
    return rows.withColumn("gene", F.col("gene").cast("string")).withColumn("trans", F.col("trans").cast("string"))


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return reads.model_changes(_change_rows(spark, sf_dir), "ref", "alt")


@query(f"WITH {_CH} SELECT read_id, string_agg(DISTINCT CAST(gene AS VARCHAR), ',' ORDER BY CAST(gene AS VARCHAR)) AS genes FROM s GROUP BY read_id HAVING count(DISTINCT gene) > 1")
def model_changes_gene(spark, sf_dir):
    return _changes(spark, sf_dir)[0]


@query(f"""WITH {_CH}, g AS (SELECT read_id FROM s GROUP BY read_id HAVING count(DISTINCT gene) = 1), r AS (SELECT DISTINCT read_id, CAST(trans AS VARCHAR) AS t FROM s WHERE source = 'ref'), a AS (SELECT DISTINCT read_id, CAST(trans AS VARCHAR) AS t FROM s WHERE source = 'alt'),
n AS (SELECT * FROM a EXCEPT SELECT * FROM r) SELECT g.read_id, (SELECT string_agg(t, ',' ORDER BY t) FROM n WHERE n.read_id = g.read_id) AS alt_models, (SELECT string_agg(t, ',' ORDER BY t) FROM r WHERE r.read_id = g.read_id) AS ref_models FROM g
WHERE read_id IN (SELECT read_id FROM n) AND read_id IN (SELECT read_id FROM r)""")
def model_changes_trans(spark, sf_dir):
    return _changes(spark, sf_dir)[1]


# ---- variants, splitting, conversion ---------------------------------------------------------------

_VAR = f"""{v.EXON}, variation AS (SELECT 'c' || (o_custkey // 50) AS scaf, (date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 100) * 2000 + l_partkey % 3 AS pos,
  ['M', 'I', 'D'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS vtype, ['A', 'C', 'G', 'T'][CAST(l_partkey % 4 AS INTEGER) + 1] AS alt, l_orderkey AS read_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
calls AS (SELECT scaf, pos, vtype, alt, count(DISTINCT read_id) AS n_reads FROM variation GROUP BY ALL HAVING count(DISTINCT read_id) >= 5)"""
_COVER = "cover AS (SELECT v.scaf, v.pos, v.read_id FROM variation v SEMI JOIN calls c ON c.scaf = v.scaf AND c.pos = v.pos UNION SELECT c.scaf, c.pos, e.tx FROM calls c JOIN exon e ON e.scaf = c.scaf AND e.s <= c.pos AND c.pos < e.e)"


def _variation(spark, sf_dir) -> DataFrame:
    o = v.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    rows = o.join(_dealt(li, spark, sf_dir, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pick = lambda names, c, n: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n).cast("int") + 1)
    pos = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) / 100) * 2000 + F.col("l_partkey") % 3
    return rows.select(F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 50).cast("string")).alias("scaf"), pos.alias("pos"), pick("MID", "l_suppkey", 3).alias("vtype"), pick("ACGT", "l_partkey", 4).alias("alt"), F.col("l_orderkey").alias("read_id"))


def _cover(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n, rows = v.n_rows(spark, sf_dir), loci.kept(_variation(spark, sf_dir))
    called = loci.kept(variants.calls(rows, n_rows=n))
    return called, variants.covering(called, rows, v.exons(spark, sf_dir).withColumnRenamed("tx", "read_id"), n_rows=n)


@query(f"WITH {_VAR} SELECT * FROM calls")
def variant_calls(spark, sf_dir):
    return variants.calls(_variation(spark, sf_dir), n_rows=v.n_rows(spark, sf_dir))


@query(f"WITH {_VAR}, {_COVER}, n AS (SELECT scaf, pos, count(*) AS cov_count FROM cover GROUP BY ALL) SELECT calls.*, cov_count FROM calls JOIN n USING (scaf, pos)")
def variant_coverage(spark, sf_dir):
    return variants.coverage(*_cover(spark, sf_dir), v.n_rows(spark, sf_dir))


@query(f"""WITH {_VAR}, {_COVER}, l AS (SELECT scaf, pos, string_agg(read_id, ',' ORDER BY read_id) AS reads FROM cover GROUP BY ALL)
SELECT scaf, reads, string_agg(pos, ',' ORDER BY pos) AS positions FROM l GROUP BY scaf, reads""")
def varcov_groups(spark, sf_dir):
    return variants.coverage_groups(_cover(spark, sf_dir)[1], v.n_rows(spark, sf_dir))


@query("WITH t AS (SELECT count(*) AS n FROM documents) SELECT doc_id AS rec_no, doc_id // ((n + 6) // 7) AS chunk FROM documents, t")
def split_chunks(spark, sf_dir):
    d = v.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_no"))
    return convert.split_chunks(d, d.count(), 7)


@query()
def split_greedy(spark, sf_dir):
    e = v.exons(spark, sf_dir).select("scaf", F.col("tx").alias("ord"))
    return convert.split_scaffolds(e, 8).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("scaf").alias("n_scaffolds"))


@query("SELECT p_partkey, concat_ws(';', p_type, p_brand) AS id FROM part")
def id_reshuffle(spark, sf_dir):
    p = v.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";", "p_brand", "p_name", "p_type").alias("id"))
    return convert.reshuffle_ids(p, "id", [3, 1])


@query(f"WITH {v.SEQ} SELECT CAST(length(regexp_extract(seq, 'A*$')) AS INTEGER) AS tail, count(*) AS reads FROM seqs GROUP BY 1")
def tail_histogram(spark, sf_dir):
    runs = v.sequences(spark, sf_dir).select(F.length(F.regexp_extract("seq", "(A*)$", 1)).alias("polya_count"))
    return cleanup.tail_histogram(runs).select(F.col("polya_num").alias("tail"), F.col("polya_num_count").alias("reads"))


# ---- kernels and reports ----------------------------------------------------------------------------


@query()
def nocap_models(spark, sf_dir):
    """Groups of models without a cap, by gene: order-dependent, so without SQL."""
    return nocap.nocap_members(_genes(spark, sf_dir).withColumn("read_id", F.col("tx").cast("string")), 10, 2, 5, v.n_rows(spark, sf_dir))


@query()
def polya_trim(spark, sf_dir):
    """Tails found by a state machine over runs, so without SQL."""
    rows = v.sequences(spark, sf_dir).select(F.col("id").alias("rec_no"), F.col("id").cast("string").alias("description"), "seq")
    return cleanup.trim(rows).select("rec_no", F.length("trimmed").alias("kept"), F.length("tail").alias("tail"), "polya_count", "status")


@query(f"""WITH {v.EXON}, {v.MODEL}, m AS (SELECT tx, strand, unnest(starts) + 1 AS s, unnest(ends) AS e, unnest(range(1, n + 1)) AS k, n, ts + 1 AS l, te AS r, ts + tx % 40 + 1 AS a, te - tx % 25 AS b FROM model),
f AS (SELECT *, CASE WHEN strand = '+' THEN k ELSE n - k + 1 END AS number, s > b AS beyond, a > e AS ahead, s > a AND e < b AS within FROM m),
g AS (SELECT *, NOT beyond AND NOT ahead AND NOT within AND s < b AND e >= b AS hb, NOT beyond AND NOT ahead AND NOT within AND a > s AND a <= e AS ha, strand = '+' AS p FROM f),
x AS (SELECT tx, number, 'exon' AS feature, s AS start, e AS "end" FROM g
UNION ALL SELECT tx, number, 'CDS', CASE WHEN ha THEN CASE WHEN p THEN a ELSE a + 3 END ELSE s END, CASE WHEN hb THEN CASE WHEN p THEN b - 3 ELSE b END ELSE e END FROM g WHERE NOT beyond AND NOT ahead
UNION ALL SELECT tx, number, 'start_codon', CASE WHEN p THEN a ELSE b - 2 END, CASE WHEN p THEN a + 2 ELSE b END FROM g WHERE (p AND ha AND a <> l) OR (NOT p AND hb AND b <> r)
UNION ALL SELECT tx, number, 'stop_codon', CASE WHEN p THEN b - 2 ELSE a END, CASE WHEN p THEN b ELSE a + 2 END FROM g WHERE (p AND hb) OR (NOT p AND ha)
UNION ALL SELECT tx, number, CASE WHEN p THEN 'five_prime_utr' ELSE 'three_prime_utr' END, s, CASE WHEN ahead THEN e WHEN p THEN a - 1 ELSE a END FROM g WHERE ahead OR ha
UNION ALL SELECT tx, number, CASE WHEN p THEN 'three_prime_utr' ELSE 'five_prime_utr' END, CASE WHEN beyond THEN s ELSE b + 1 END, e FROM g WHERE beyond OR hb)
SELECT tx, number, feature, start, "end" FROM x WHERE "end" >= start""")
def coding_features(spark, sf_dir):
    m = _models(spark, sf_dir)
    x = m.select("tx", "strand", F.size("starts").alias("n"), (F.col("ts") + 1).alias("left"), F.col("te").alias("right"), (F.col("ts") + F.col("tx") % 40 + 1).alias("cds_start"), (F.col("te") - F.col("tx") % 25).alias("cds_end"), F.posexplode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("k", "x"))
    number = F.when(F.col("strand") == "+", F.col("k") + 1).otherwise(F.col("n") - F.col("k")).cast("long")
    x = x.withColumn("number", number).withColumn("start", F.col("x.s") + 1).withColumn("end", F.col("x.e")).drop("k", "x")
    return convert.coding_features(x).select("tx", "number", "feature", "start", "end")


@query(f"""WITH {_SM}, {_SC}, kept AS (SELECT gene, trans FROM c WHERE NOT (in_gene = 1 AND sources = 1 AND reads = 1 AND n_exons = 1) AND (reads >= 60 OR n_exons > 1)),
g AS (SELECT gene, row_number() OVER (ORDER BY min(m.trans)) AS gn FROM models m WHERE gene IN (SELECT gene FROM kept) GROUP BY gene)
SELECT kept.gene, kept.trans, 'G' || gn AS new_gene, 'G' || gn || '.' || row_number() OVER (PARTITION BY kept.gene ORDER BY kept.trans) AS new_trans FROM kept JOIN g USING (gene)""")
def renumbered_models(spark, sf_dir):
    m, s = _support_models(spark, sf_dir)
    kept = reads.single_read(m, s, level="transcript", min_reads=60)
    return reads.renumbered(m.withColumn("ord", F.col("trans")), kept).where("new_gene IS NOT NULL").select("gene", "trans", "new_gene", "new_trans")


@query(f"""WITH {_SM}, t AS (SELECT gene, count(*) AS models, max(n_exons) AS exons, count(*) FILTER (n_exons = 1) AS singles FROM models GROUP BY gene), r AS (SELECT gene, count(DISTINCT read_id) AS reads FROM support GROUP BY gene), j AS (SELECT * FROM t JOIN r USING (gene))
SELECT CAST(coalesce(sum(models) FILTER (exons > 1 AND reads > 1), 0) AS BIGINT) AS multi_exon_multi_read_trans, CAST(sum(models) AS BIGINT) AS trans, CAST(sum(singles) AS BIGINT) AS single_exon_trans, CAST(sum(models - singles) AS BIGINT) AS multi_exon_trans,
count(*) AS genes, count(*) FILTER (exons < 2) AS single_exon_genes, count(*) FILTER (exons > 1) AS multi_exon_genes, count(*) FILTER (exons < 2 AND reads = 1) AS single_exon_single_read_genes, count(*) FILTER (exons > 1 AND reads < 2) AS multi_exon_single_read_genes FROM j""")
def degradation_tally(spark, sf_dir):
    m, s = _support_models(spark, sf_dir)
    return reads.degradation_tally(s.join(m, ["gene", "trans"]))


_ONE = f"WITH {_CH}, r AS (SELECT read_id FROM s GROUP BY read_id HAVING count(DISTINCT gene) > 1), moved AS (SELECT DISTINCT gene FROM s WHERE read_id IN (SELECT read_id FROM r)), k AS (SELECT gene, min(source) AS source FROM s GROUP BY gene HAVING count(DISTINCT source) = 1)"


@query(f"{_ONE} SELECT source, CAST(gene AS VARCHAR) AS gene FROM moved JOIN k USING (gene) UNION ALL SELECT 'genes', CAST(count(*) AS VARCHAR) FROM moved UNION ALL SELECT 'reads', CAST(count(*) AS VARCHAR) FROM r")
def model_changes_report(spark, sf_dir):
    counts, genes, _ = reads.model_changes_report(_change_rows(spark, sf_dir), "ref", "alt")
    total = lambda name, to: counts.where(F.col("name") == name).select(F.lit(to).alias("source"), F.col("n").cast("string").alias("gene"))
    return genes.unionByName(total("num_merge_diff_gene", "genes")).unionByName(total("num_diff_gene_reads", "reads"))
