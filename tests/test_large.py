"""What lets a query grow with its tables: tasks of bounded size, tables read once, groups handled many at once."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from spliceflow.functions import sequence
from spliceflow.operators import convert, fragments, groups, loci, nocap, orf
from spliceflow.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def models(n, width, seed):
    rng, out = random.Random(seed), []
    for tx in range(n):
        x = [rng.randrange(0, width)]
        for _ in range(2 * rng.randint(1, 4) - 1):
            x.append(x[-1] + rng.choice((8, 20, 40, 41, 300)))
        out.append({"tx": tx, "s": x[::2], "e": x[1::2]})
    return out


def test_fragments_meet_as_every_pair_does(spark):
    """against the rule over all pairs, and many genes in one call."""

    def every_pair(rows):
        gone, size = {}, lambda x: (len(x["s"]), x["e"][-1] - x["s"][0], -x["s"][0])
        for a in rows:
            for b in rows:
                if a is b or a["tx"] in gone or b["tx"] in gone or a["e"][-1] < b["s"][0] or b["e"][-1] < a["s"][0]:
                    continue
                long, short = (a, b) if size(a) >= size(b) else (b, a)
                if (bounds := fragments._contained(long, short, 10, 500, 20)) is not None:
                    gone[short["tx"]] = long["tx"]
                    long["s"][0], long["e"][-1] = bounds
        return gone

    copy = lambda rows: [{"tx": r["tx"], "s": list(r["s"]), "e": list(r["e"])} for r in rows]
    want = {}
    for seed in range(40):
        rows, again = copy(models(30, 400 + 100 * seed, seed)), models(30, 400 + 100 * seed, seed)
        assert fragments.absorb(again) == (gone := every_pair(rows)) and again == rows
        want |= {(seed, r["tx"]): (gone.get(r["tx"]), r["s"][0], r["e"][-1]) for r in rows}
    rows = [(seed, r["tx"], r["s"], r["e"]) for seed in range(40) for r in models(30, 400 + 100 * seed, seed)]
    got = fragments.absorb_fragments(spark.createDataFrame(rows, "gene long, tx long, starts array<long>, ends array<long>"))
    assert {(r["gene"], r["tx"]): (r["absorbed_by"], r["start"], r["end"]) for r in got.collect()} == want
    assert "FlatMapGroups" not in plan(got)


def test_genes_without_a_cap_are_not_called_one_by_one(spark):
    """F2"""
    rows = [(g, 10 * g + i, f"r{i}", "+", [0, 100], [50, 150 + i % 2]) for g in range(50) for i in range(4)]
    got = nocap.nocap_members(spark.createDataFrame(rows, "gene long, tx long, read_id string, strand string, starts array<long>, ends array<long>"), 10, 2, 5)
    assert sorted((r["gene"], r["nth"], r["at"], r["tx"]) for r in got.collect()) == [(g, 0, i, 10 * g + i) for g in range(50) for i in range(4)]
    assert "FlatMapGroups" not in plan(got)


@pytest.mark.parametrize("held", [2, 3, 40])
def test_chains_held_in_parts(spark, monkeypatch, held):
    """chains that are cut by bins and by what is held come out whole; exons are dealt once."""
    monkeypatch.setattr(loci, "HELD", held)
    monkeypatch.setattr(loci, "BIN", 64)
    rng = random.Random(held)
    rows = [(i, "ab"[i % 2], "+", k, s := rng.randrange(1500), s + rng.choice((5, 20, 200))) for i in range(80) for k in range(2)]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[4] <= b[5] and b[4] <= a[5]:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    exons = spark.createDataFrame(rows, "tx long, scaf string, strand string, k int, s long, e long")
    assert {r["tx"]: r["gene"] for r in loci.gene_groups(exons).collect()} == {x: find(x) for x in root}


@tables
@pytest.mark.parametrize("name", ["bed12_render", "cds_extract", "coding_features", "model_dedup", "variant_calls", "variant_coverage", "varcov_groups", "collapse_vote", "collapse_longest_ends", "merge_priority_vote", "merge_sources"])
def test_tasks_grow_in_number(spark, monkeypatch, name):
    """F5 to F8, F10 to F16: every exchange of rows is dealt by their number, not by a setting (4 here)."""
    monkeypatch.setattr(groups, "ROWS", 256)
    dealt = re.findall(r"hashpartitioning\(.*, (\d+)\), (\w+)", plan(catalog.queries()[name](spark, SF)))
    assert dealt and {n for n, _ in dealt} == {str(-(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 256))}


@tables
def test_islands_are_dealt_by_bins(spark, monkeypatch):
    """F19"""
    monkeypatch.setattr(groups, "ROWS", 256)
    assert re.search(r"hashpartitioning\(scaf#\d+, strand#\d+, _bin#\d+L?, 2\d\), REPARTITION_BY_NUM", plan(catalog.queries()["exon_islands"](spark, SF)))


@tables
def test_round_trip_reads_once(spark):
    """orders and lineitem are read once for all lines."""
    assert plan(catalog.queries()["gtf2bed_roundtrip"](spark, SF)).count("FileScan parquet") == 2


@tables
@pytest.mark.parametrize("name", ["bed2gtf_features", "merge_priority_vote", "merge_sources"])
def test_groups_read_models_once(spark, name):
    """what follows the grouping reads its table, not orders and lineitem again, and each once."""
    got = plan(catalog.queries()[name](spark, SF))
    assert "l_linenumber" not in got.replace("InMemoryRelation", "\0").split("\0")[0] and "SortMergeJoin" not in got.split("InMemoryRelation")[0]


def test_gene_line_of_the_first_model(spark):
    """the gene's line has the first model's scaffold and strand and the bounds of all."""
    rows = [(5, "g", "b", "y", "-", [10, 30], [20, 40]), (3, "g", "a", "x", "+", [15], [50])]
    got = convert.bed_to_gtf(spark.createDataFrame(rows, "ord long, gene string, trans string, scaf string, strand string, starts array<long>, ends array<long>"))
    lines = [(r["gene_ord"], r["ord"], r["place"], *r["line"].split("\t")) for r in got.orderBy("ord", "place").collect()]
    assert lines[0][:8] == (3, -1, 0, "x", "PBRI", "gene", "11", "50") and lines[0][9] == "+" and len(lines) == 6
    assert plan(got).count("Scan ExistingRDD") == 1


def test_frames_and_spans_by_hand():
    """proteins by codon, reading frames by segment."""
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 90, 301, 1000)] + ["ATGTAA", "TAAATGATGTAG", "AAATAAATGTAGATG"]
    for seq, found in zip(seqs, sequence.proteins(seqs)):
        for f in range(3):
            protein = "".join(sequence.CODONS[seq[i : i + 3]] for i in range(f, len(seq) - 2, 3))
            assert found[f].tobytes().decode() == protein
            want, before = set(), 0
            for k, seg in enumerate(protein.split("$")[:-1]):
                want |= {(before + a, before + len(seg)) for a in ([1] if k == 0 and seg else []) + ([seg.index("M") + 1] if "M" in seg else [])}
                before += len(seg) + 1
            assert sorted(orf._spans(found[f])) == sorted(want)


def test_longest_frames_of_a_sequence(spark):
    """ranks need no frames but the longest, and no window over a frame's segments."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(400))) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, seq string")
    few, all_ = orf.top_orfs(orf.orfs(df, 4)), orf.top_orfs(orf.orfs(df))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.collect())) and "Window" not in plan(orf.orfs(df))
