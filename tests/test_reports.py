"""Readers, reports and commands on small files of the tests' own."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from spliceflow import __main__ as cli
from spliceflow.functions import alignment
from spliceflow.operators import fragments, genome, loci, nocap, reads, reports
from spliceflow.sources import readers


def lines(folder):
    return [x for p in sorted(glob.glob(f"{folder}/part-*")) for x in open(p).read().splitlines()]


def run(spark, monkeypatch, *argv):
    monkeypatch.setattr(type(spark.builder), "getOrCreate", lambda self: spark)
    cli.main([str(x) for x in argv])


def ordered(rows, *by):
    return [r["line"] for r in rows.orderBy(*by).collect()]


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    for name, n in (("b.txt", 3000), ("a.txt", 2000)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r["ord"], r["value"]) for r in readers.lines(spark, str(tmp_path)).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate([f"a.txt{i}" for i in range(2000)] + [f"b.txt{i}" for i in range(3000)]))


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "x.fa").write_text("\n>a b>c d\nacGT\nAC\n>e\r\nTT\r\n>f x\n")
    got = [(r["id"], r["description"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "x.fa")).orderBy("rec_no").collect()]
    assert got == [("a", "a b>c d", "ACGTAC"), ("e", "e", "TT"), ("f", "f x", "")]


def test_cigar_with_an_open_number(spark):
    with pytest.raises(Exception, match="without an operation"):
        spark.createDataFrame([("5M3",)], "c string").select(alignment.cigar_ops(F.col("c"))).collect()


def test_shortest_numbers():
    assert [reports.shortest(x) for x in (0.2, 3.0, 1e-7, 1 / 3, 1e22, float("nan"))] == ["0.2", "3.0", "0.0000001", "0.3333333333333333", "10000000000000000000000.0", "NaN"]


def test_single_exon_in_every_place():
    """A short model of one exon against each exon of a long one, by the rule written out."""
    long = {"s": [100, 300, 500], "e": [200, 400, 600]}
    for a in range(40, 640, 7):
        for b in (a + 30, a + 60, a + 105, a + 130):
            held = None
            for i, (s, e) in enumerate(zip(long["s"], long["e"])):
                if s < b and a < e and s - a < (50 if i == 0 else 10) and b - e < (50 if i == 2 else 10):
                    held = (min(100, a) if i == 0 else 100, max(600, b) if i == 2 else 600)
            assert fragments._contained(long, {"s": [a], "e": [b]}, 10, 50, 20) == held, (a, b)


def test_islands_and_genes_over_bins(spark, monkeypatch):
    monkeypatch.setattr(loci, "BIN", 64)
    rng = random.Random(2)
    rows = [(i, "c", "+-"[i % 2], k, s := rng.randrange(3000), s + rng.choice((5, 20, 300))) for i in range(120) for k in range(2)]
    exons = spark.createDataFrame(rows, "tx long, scaf string, strand string, k int, s long, e long")
    for touching in (True, False):
        want, reach, n = {}, None, 0
        for tx, _, _, k, s, e in sorted(rows, key=lambda r: (r[4], r[5], r[0], r[3])):
            n += reach is None or (s > reach if touching else s >= reach)
            reach = max(reach or e, e)
            want[tx, k] = n
        got = loci.islands(exons, ["scaf"], "s", "e", ["e", "tx", "k"], "island", touching).collect()
        assert {(r["tx"], r["k"]): r["island"] for r in got} == want
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a[2] == b[2] and a[4] <= b[5] and b[4] <= a[5]:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    assert {r["tx"]: r["gene"] for r in loci.gene_groups(exons).collect()} == {x: find(x) for x in root}


def test_stretches_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(genome, "TILE", 8)
    rng = random.Random(5)
    seq = {n: "".join(rng.choice("ACGT") for _ in range(k)) for n, k in (("a", 70), ("b", 8), ("c", 1))}
    spans = [(i, rng.choice("abcd"), sorted((s, s + rng.randrange(20)) for s in rng.sample(range(-5, 75), 3))) for i in range(60)]
    rows = spark.createDataFrame(spans, "ord long, scaffold string, x array<struct<s: long, e: long>>")
    got = genome.stretches(rows, spark.createDataFrame(list(seq.items()), "id string, seq string"), F.col("x"), "ref").collect()
    assert {r["ord"]: r["ref"] for r in got} == {i: "".join(seq.get(n, "")[max(s, 0) : max(e, 0)] for s, e in x) for i, n, x in spans}


def test_ranked_and_saturation(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(100), f"r{rng.randrange(700)}") for i in range(1000)]
    df = spark.createDataFrame(rows, "ord long, gene long, read_id string").repartition(7)
    assert [r["n"] for r in loci.ranked(df, ["ord"], "n").orderBy("ord").collect()] == list(range(1, 1001))
    first, genes, want = {}, set(), []
    for _, g, r in rows:
        first.setdefault(r, g)
    for n, g in enumerate(first.values(), 1):
        if n % 50 == 0:
            want.append((n, len(genes)))
        genes.add(g)
    assert sorted(map(tuple, reads.saturation(df, 50).collect())) == want


def test_shapes_lead_like_their_reads():
    """Equal reads on their own and as one shape give the same groups."""
    rng = random.Random(3)

    def shape():
        n, x = rng.randint(1, 4), lambda: rng.choice((0, 0, 1, 6, 12, -3))
        return [-100 * i + x() for i in range(n)], [-100 * i + 30 + x() for i in range(n)]

    def groups(names, edges, of):
        reads_of = {}
        for i, k in enumerate(of):
            reads_of.setdefault(k, []).append(i)
        keys = list(reads_of)
        steps = nocap.nocap_steps([min(names[i] for i in reads_of[k]) for k in keys], [edges[reads_of[k][0]] for k in keys], [(reads_of[k][0], reads_of[k][-1]) for k in keys], 10, 2, 5)
        rows = [sorted((t, -len(edges[i][0]), i) for t, x, a, b in g for i in reads_of[keys[x]] if a <= i <= b) for g in steps]
        return [[i for *_, i in g] for g in rows]

    for _ in range(300):
        pool = [shape() for _ in range(rng.randint(1, 6))]
        edges = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        names = [f"r{i}" for i in rng.sample(range(100), len(edges))]
        alone = groups(names, edges, list(range(len(edges))))
        assert groups(names, edges, [str(e) for e in edges]) == alone


@pytest.fixture
def support(tmp_path):
    (tmp_path / "reads.bed").write_text("".join(f"c\t0\t9\t{t};{r}\t40\t+\t0\t9\t0\t{n}\t9,\t0,\n" for t, r, n in (("G1.1", "a/x", 1), ("G1.1", "b", 1), ("G2.1", "c", 2), ("G1.2", "b", 1))))
    (tmp_path / "list.csv").write_text("cluster_id,read\na,r1\na,r2\nb,r3\na,r1\n")
    (tmp_path / "levels.txt").write_text("merge_gene_id\tx\nG1\tG1.1\t3\t3\ts1,s2\ts2:r3;s1:r1,m:2\nG2\tG2.1\t1\t1\ts1\ts1:r9\nG3\tG3.1\t1\t1\ts1\ts1:r7\n")
    (tmp_path / "models.bed").write_text("".join(f"c\t0\t{9 + n}\t{g};{g}.{n}\t40\t+\t0\t9\t0\t{n}\t{'9,' * n}\t{'0,' * n}\n" for g, n in (("G1", 1), ("G3", 1), ("G2", 2))))
    return tmp_path


def test_support_files(spark, monkeypatch, support):
    kind, rows = readers.clusters(spark, str(support / "list.csv"))
    assert kind == "list" and rows.count() == 4
    assert readers.clusters(spark, str(support / "reads.bed"))[0] == "no_cluster"
    (support / "bad").write_text("\t".join("abcdefghijkl"))
    with pytest.raises(ValueError):
        readers.clusters(spark, str(support / "bad"))
    run(spark, monkeypatch, "support-clusters", support / "reads.bed", support / "list.csv", "-o", support / "out")
    assert lines(support / "out")[1:] == ["G1\tG1.1\t4\t3\ta:r1,r2;b:r3", "G1\tG1.2\t4\t1\tb:r3", "G2\tG2.1\t0\t0\tc:"]
    got = readers.levels(spark, str(support / "levels.txt")).orderBy("ord", "pos").collect()
    assert [(r["trans"], r["source"], r["read_id"]) for r in got] == [("G1.1", "s2", "r3"), ("G1.1", "s1", "r1"), ("G1.1", "s1", "m:2"), ("G2.1", "s1", "r9"), ("G3.1", "s1", "r7")]
    for kind, path, n in (("trans_read", "reads.bed", 4), ("read_support", "levels.txt", 5), ("cluster", "list.csv", 4)):
        assert readers.support_reads(spark, str(support / path), kind).count() == n
    with pytest.raises(ValueError):
        readers.support_reads(spark, "x", "other")


def test_levels_and_merged_support(spark, monkeypatch, support):
    (support / "files").write_text(f"s1\t{support}/reads.bed\ttrans_read\ns2\t{support}/list.csv\tcluster\n")
    (support / "merge.txt").write_text("".join(f"c\t0\t9\t{x}\n" for x in ("G1.1;s2_a", "G1.1;s1_G1.1", "G1.1;s1_G1.2", "G1.2;s1_G2.1", "G2.1;s1_G2.1", "G2.2;s9_x")))
    run(spark, monkeypatch, "support-levels", support / "files", "-m", support / "merge.txt", "-o", support / "l")
    assert lines(support / "l_read_support.txt")[1:] == ["G1\tG1.1\t5\t4\ts1,s2\ts1:a/x,b;s2:r1,r2", "G1\tG1.2\t5\t1\ts1\ts1:c", "G2\tG2.1\t1\t1\ts1\ts1:c"]
    (support / "own").write_text(f"s1\t{support}/reads.bed\ttrans_read\n")
    run(spark, monkeypatch, "support-levels", support / "own", "-o", support / "o")
    assert lines(support / "o_read_support.txt")[1:] == ["G1\tG1.1\t2\t2\ts1\ts1:a/x,b", "G2\tG2.1\t1\t1\ts1\ts1:c", "G1\tG1.2\t2\t1\ts1\ts1:b"]
    run(spark, monkeypatch, "support-clusters", support / "reads.bed", support / "list.csv", "-o", support / "cl")
    (support / "cl.txt").write_text("\n".join(lines(support / "cl")) + "\n")
    (support / "m").write_text(f"cl.txt\ts1\t{support}/\n")
    run(spark, monkeypatch, "support-merged", support / "merge.txt", support / "m", "-o", support / "mm")
    got = lines(support / "mm")[1:]
    # A cluster without reads has one empty read.
    assert got[0] == "G1\tG1.1\t4\t3\ts2,s1\ts2_a,s1_G1.1,s1_G1.2\t;r1,r2,r3;r3" and got[3] == "G2\tG2.2\t1\t0\ts9\ts9_x\t"
    (support / "m").write_text(f"cl.txt\ts1\t{support}/\ncl.txt\ts1\t{support}/\n")
    with pytest.raises(ValueError):
        run(spark, monkeypatch, "support-merged", support / "merge.txt", support / "m", "-o", support / "mm")


def test_filter_and_split_files(spark, monkeypatch, support):
    run(spark, monkeypatch, "filter-single-read", support / "models.bed", "-r", support / "levels.txt", "-l", "transcript", "-k", "remove_multi", "-o", support / "s")
    assert lines(support / "s_singleton_report.txt")[1:] == ["G1\tG1.1\ts2,s1\t3\tG1\tG1.1\t1", "G3\tG3.1\ts1\t1\tremoved_gene\tremoved_transcript\t1", "G2\tG2.2\t\t0\tall_trans_removed\tremoved_transcript\t2"]
    assert [x.split("\t")[3] for x in lines(support / "s.bed")] == ["G1;G1.1"] and [x.split("\t")[3] for x in lines(support / "s_singleton.bed")] == ["G3;G3.1", "G2;G2.2"]
    (support / "polya").write_text("cluster_id\tx\nr7\tt\t+\t80.0\t16\tAAAA\nr1\tt\t+\t90\t18\tAAAA\n")
    (support / "pl").write_text(f"s1\t{support}/polya\n")
    run(spark, monkeypatch, "filter-polya", support / "models.bed", "-r", support / "levels.txt", "-f", support / "pl", "-o", support / "p")
    assert lines(support / "p_polya_report.txt")[1:] == ["G1\tG1.1\ts2,s1\t3\tG1\tG1.1\t1", "G3\tG3.1\ts1\t1\tremoved_gene\tremoved_transcript\t1", "G2\tG2.2\t\t0\tG2\tG2.1\t2"]
    assert lines(support / "p_polya_support.txt")[1:] == ["G3.1\ts1\tr7\tt\t+\t80.0\t16\tAAAA"]
    (support / "x.fa").write_text("".join(f">r{i} >\nAC\nGT\n" for i in range(5)))
    run(spark, monkeypatch, "split-fasta", support / "x.fa", "-n", 3, "-o", support / "c")
    assert [lines(support / f"c_{i}.fa")[0] for i in (1, 2, 3)] == [">r0 >", ">r2 >", ">r4 >"] and len(lines(support / "c_1.fa")) == 6
    (support / "x.sam").write_text("@HD\n@SQ\n" + "".join(f"q{i}\t0\t{c}\t1\n" for i, c in enumerate("aabbbac")))
    run(spark, monkeypatch, "split-sam", support / "x.sam", "-n", 2, "-o", support / "w")
    assert [x.split("\t")[0] for x in lines(support / "w_1.sam")] == ["@HD", "@SQ", "q0", "q1", "q5"] and [x.split("\t")[0] for x in lines(support / "w_2.sam")] == ["@HD", "@SQ", "q2", "q3", "q4"]
    assert [x.split("\t")[0] for x in lines(support / "w_3.sam")] == ["@HD", "@SQ", "q6"]
