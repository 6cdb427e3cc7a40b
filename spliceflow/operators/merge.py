"""Merging annotations of several sources with a priority per source and edge."""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.functions.render import bed_line
from spliceflow.operators import loci
from spliceflow.operators.collapse import numbered


# Colours of models by the rank of their only source; the last one is also for several sources.
COLOURS = ("255,0,0", "255,100,0", "255,200,0", "200,255,0", "0,255,200", "0,200,255", "0,100,255", "0,0,255", "100,0,255", "200,0,255")


@dataclass(frozen=True)
class Source:
    """A BED table and what its edges are worth (lower numbers win)."""

    name: str
    models: DataFrame
    capped: bool = True
    start: int = 1
    junction: int = 1
    end: int = 1


def manifest(spark: SparkSession, path: str, read) -> list[Source]:
    """Sources from a four-column list: file, capped or no_cap, "start,junction,end", name."""
    folder = path.rpartition("/")[0]
    out = []
    for row in spark.read.text(path).collect():
        if not row[0].strip():
            continue
        cells = row[0].split("\t")
        if len(cells) != 4 or cells[1] not in ("capped", "no_cap") or len(cells[2].split(",")) != 3:
            raise ValueError(f"not a source line: {row[0]}")
        at = cells[0] if cells[0].startswith("/") else f"{folder}/{cells[0]}"
        out.append(Source(cells[3], read(spark, at), cells[1] == "capped", *map(int, cells[2].split(","))))
    return out


def load(sources: list[Source]) -> DataFrame:
    """All models with their source's name, cap and priorities, and a number in source and file order."""
    each = [
        s.models.select(
            F.col("scaffold").alias("scaf"), "strand", F.col("exon_starts").alias("starts"), F.col("exon_ends").alias("ends"), "trans_id", "gene_id", "cds_start", "cds_end", F.lit(s.name).alias("src"), F.lit(s.capped).alias("capped"),
            F.lit(s.start).alias("p_start"), F.lit(s.junction).alias("p_junction"), F.lit(s.end).alias("p_end"), (F.lit(i << 40) + F.col("ord")).alias("tx"),
        )
        for i, s in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, each)
    return rows.withColumn("n", F.size("starts")).withColumn("ts", F.col("starts")[0]).withColumn("te", F.element_at("ends", -1))


def phased_groups(items: list[tuple[int, bool, int]], capped_links: dict[int, set[int]], loose_links: dict[int, set[int]]) -> list[list[int]]:
    """``items``: (tx, capped, exons) in order. Capped components; then models without a cap join every
    capped group with a member, however it got there, of as many exons or more that matches; then those
    left over form components."""
    capped, size = {t for t, c, _ in items if c}, {t: n for t, _, n in items}
    place = {t: i for i, (t, _, _) in enumerate(items)}

    def closure(left: list[int], links: dict[int, set[int]]) -> list[list[int]]:
        left, seen, out = list(left), set(), []
        inside = set(left)
        for t in left:
            if t in seen:
                continue
            group, todo = [], [t]
            seen.add(t)
            while todo:
                x = todo.pop()
                group.append(x)
                more = (links.get(x, set()) & inside) - seen
                seen |= more
                todo += more
            out.append(sorted(group))
        return out

    groups = closure([t for t, c, _ in items if c], capped_links)
    joined = set()
    for g in groups:
        # In order of the models without a cap: one that joins counts for those behind it.
        fits = [x for t in g for x in loose_links.get(t, ()) if x not in capped and size[t] >= size[x]]
        queue, inside = sorted({place[x] for x in fits}), set(g)
        while queue:
            at = heapq.heappop(queue)
            x = items[at][0]
            if x in inside:
                continue
            g.append(x)
            inside.add(x)
            joined.add(x)
            for y in loose_links.get(x, ()):
                if y not in capped and y not in inside and place[y] > at and size[x] >= size[y]:
                    heapq.heappush(queue, place[y])
    return groups + closure([t for t, c, _ in items if not c and t not in joined], loose_links)


def _phased(rows: DataFrame, five: int, junction: int, three: int) -> DataFrame:
    """(tx, gene, model): phases depend on order, so a gene is one group of the kernel; it meets only the
    pairs that match, found by joins on bands."""
    capped = loci.capped_pairs(rows.where("capped"), five, junction, three).withColumn("loose", F.lit(False))
    loose = loci.loose_pairs(rows, five, junction, three).select(F.col("long_tx").alias("a"), F.col("short_tx").alias("b"), F.lit(True).alias("loose"))
    side = lambda c: rows.select(F.col("tx").alias(c), F.col("gene").alias(f"g{c}"))
    links = capped.unionByName(loose).join(side("a"), "a").join(side("b"), "b").where("ga = gb").select(F.col("ga").alias("gene"), "a", "b", "loose")

    def work(gene: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        gene = gene.sort_values(["ts", "te", "tx"])
        links: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
        for a, b, loose in zip(pairs["a"], pairs["b"], pairs["loose"]):
            links[loose][int(a)].add(int(b))
            links[loose][int(b)].add(int(a))
        items = [(int(t), bool(c), int(n)) for t, c, n in zip(gene["tx"], gene["capped"], gene["n"])]
        out = [(t, int(gene["gene"].iloc[0]), i) for i, g in enumerate(phased_groups(items, *links)) for t in g]
        return pd.DataFrame(out, columns=["tx", "gene", "nth"])

    found = rows.select("gene", "tx", "capped", "n", "ts", "te").groupBy("gene").cogroup(links.groupBy("gene")).applyInPandas(work, "tx long, gene long, nth long")
    return found.select("tx", "gene", F.concat_ws("-", F.col("gene").cast("string"), F.col("nth").cast("string")).alias("model"))


def colour(sources: Column, names: list[str]) -> Column:
    """Of an array of sorted source names: the colour of the only one's rank, or that of several."""
    rank = F.create_map(*(F.lit(x) for i, n in enumerate(sorted(set(names))) for x in (n, COLOURS[min(i, len(COLOURS) - 1)])))
    return F.when(F.size(sources) > 1, F.lit(COLOURS[-1])).otherwise(F.element_at(rank, sources[0]))


def sources_of() -> Column:
    """Aggregates the names of a model's sources."""
    return F.array_sort(F.collect_set("src"))


def merge(
    sources: list[Source], five: int = 20, junction: int = 10, three: int = 20, ids_of: tuple[str, ...] = (), cds_of: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Merged models (G numbers, sources, report columns, BED line) and provenance (merged id, source,
    source model and gene, BED line of the source model).

    Ids of members from the sources in ``ids_of`` are added to the id; the last member from ``cds_of``
    gives the thick bounds, if it has a CDS.
    """
    for name in (*ids_of, *cds_of):
        if name not in {s.name for s in sources}:
            raise ValueError(f"not a source: {name}")
    rows = load(sources)
    exon = rows.select("tx", "scaf", "strand", F.posexplode(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias("k", "x")).select("tx", "scaf", "strand", "k", "x.s", "x.e")
    rows = rows.join(loci.gene_groups(exon), "tx")
    if all(s.capped for s in sources):
        one = rows.groupBy("gene", "scaf", "strand", "n", "starts", "ends", "ts").agg(F.min("tx").alias("tx"))
        side = lambda c: one.select(F.col("tx").alias(c), F.col("gene").alias(f"g{c}"))
        pairs = loci.capped_pairs(one, five, junction, three).join(side("a"), "a").join(side("b"), "b").where("ga = gb")
        group = loci.components(pairs, "a", "b").select(F.col("id").alias("rep"), "component")
        members = rows.join(one.select("gene", "strand", "starts", "ends", F.col("tx").alias("rep")), ["gene", "strand", "starts", "ends"]).join(group, "rep", "left")
        members = members.withColumn("model", F.coalesce("component", "rep").cast("string"))
    else:
        members = rows.join(_phased(rows, five, junction, three).select("tx", "model"), "tx")
    # Edges by distance from the 3' end; a shorter model's 5' edge counts last.
    deepest = members.groupBy("model").agg(F.max("n").alias("most"))
    f = loci.flipped(members.join(deepest, "model")).withColumn("uid", F.concat_ws("_", "src", "trans_id"))
    edge = f.select("model", "strand", "n", "most", "p_start", "p_junction", "p_end", "uid", F.posexplode(F.arrays_zip(F.col("f5").alias("a"), F.col("f3").alias("b"))).alias("i", "x"))
    end5, end3 = F.col("i") == F.col("n") - 1, F.col("i") == 0
    prio5 = F.when(end5 & (F.col("n") < F.col("most")), F.lit(999)).when(end5, F.col("p_start")).otherwise(F.col("p_junction"))
    prio3 = F.when(end5, F.col("p_junction")).when(end3, F.col("p_end")).otherwise(F.col("p_junction"))
    both = F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("x.a").alias("coord"), prio5.alias("prio")), F.struct(F.lit("e").alias("side"), F.col("x.b").alias("coord"), prio3.alias("prio"))))
    edge = edge.select("model", "strand", "i", "uid", both.alias("y")).select("model", "strand", "i", "uid", "y.*")
    won = loci.vote(edge.drop("uid"), ["model", "strand", "i"], wobble_of_winner=True, with_prio=True)
    backing = edge.join(won, ["model", "strand", "i", "side", "prio", "coord"]).groupBy("model", "i", "side").agg(F.array_join(F.array_sort(F.collect_set("uid")), ",").alias("who"))
    won = won.join(backing, ["model", "i", "side"])
    true = F.when(F.col("strand") == "+", F.col("coord")).otherwise(-F.col("coord"))
    is_start = (F.col("side") == "s") == (F.col("strand") == "+")
    place = F.when(F.col("strand") == "+", -F.col("i")).otherwise(F.col("i"))
    pick = lambda of: F.array_sort(F.collect_list(F.when(of, F.struct(true.alias("coord"), "wobble"))))
    said = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(of, F.struct(place.alias("g"), "who")))), lambda x: x["who"]), ";")
    bounds = won.groupBy("model").agg(pick(is_start).alias("s"), pick(~is_start).alias("e"), said(is_start).alias("exon_start_support"), said(~is_start).alias("exon_end_support"))
    bounds = bounds.withColumns({"starts": F.col("s.coord"), "ends": F.col("e.coord"), "start_wobble": F.col("s.wobble"), "end_wobble": F.col("e.wobble")}).drop("s", "e")
    among = lambda names: F.col("src").isin(*names) if names else F.lit(False)
    extra = F.array_sort(F.collect_list(F.when(among(ids_of), F.struct("tx", F.concat_ws(";", "gene_id", "trans_id").alias("id")))))
    cds = F.max(F.when(among(cds_of), F.struct("tx", F.col("cds_start").alias("a"), F.col("cds_end").alias("b"))))
    where = members.groupBy("model").agg(
        *(F.first(c).alias(c) for c in ("gene", "scaf", "strand")), sources_of().alias("sources"), F.min("tx").alias("least"), extra.alias("extra"), cds.alias("cds"),
        F.count(F.lit(1)).alias("num_clusters"),
    )
    built = bounds.join(where, "model").withColumn("key", F.concat(F.flatten(F.zip_with("starts", "ends", lambda a, b: F.array(a, b))), F.array("least")))
    # A gene lies in one locus and loci lie apart, so genes by their start are genes by locus.
    genes = rows.groupBy("gene").agg(F.first("scaf").alias("g1"), F.min("ts").alias("g2"), F.first("strand").alias("g3"))
    out = numbered(genes, built).withColumn("gene_id", F.concat(F.lit("G"), F.col("gene_no").cast("string"))).withColumn("trans_id", F.concat("gene_id", F.lit("."), F.col("model_no").cast("string")))
    has = F.coalesce(F.col("cds.a") != 0, F.lit(False))
    thick = (F.when(has, F.col("cds.a")).otherwise(F.col("starts")[0]), F.when(has, F.col("cds.b")).otherwise(F.element_at("ends", -1)))
    ids = F.concat_ws(";", "gene_id", "trans_id", F.col("extra.id"))
    out = out.withColumn("line", bed_line(F.col("scaf"), ids, F.col("strand"), F.col("starts"), F.col("ends"), rgb=colour(F.col("sources"), [s.name for s in sources]), thick=thick))
    mine = members.select("model", "tx", "scaf", "strand", "starts", "ends", "gene_id", F.col("src").alias("source"), F.col("trans_id").alias("source_trans"))
    uid = F.concat(F.col("trans_id"), F.lit(";"), F.concat_ws("_", "source", "source_trans"))
    from_ = mine.join(out.select("model", "trans_id", F.col("gene_id").alias("gene"), "gene_no", "model_no"), "model").withColumn("line", bed_line(F.col("scaf"), uid, F.col("strand"), F.col("starts"), F.col("ends")))
    from_ = from_.select("gene", "trans_id", "source", "source_trans", F.col("gene_id").alias("source_gene"), "tx", "gene_no", "model_no", "scaf", F.col("starts")[0].alias("start"), F.element_at("ends", -1).alias("end"), "line")
    report = ("num_clusters", "start_wobble", "end_wobble", "exon_start_support", "exon_end_support")
    return out.select("gene_no", "model_no", "gene_id", "trans_id", "scaf", "strand", "starts", "ends", F.array_join("sources", ",").alias("sources"), *report, "line"), from_


def trans_report(models: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per merged model: members, sources, wobble and the members behind each chosen edge."""
    who = F.array_sort(F.collect_list(F.struct("tx", F.concat_ws("_", "source", "source_trans").alias("id"))))
    of = provenance.groupBy("trans_id").agg(F.array_join(who.getField("id"), ",").alias("all_source_trans"))
    csv = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return models.join(of, "trans_id").select(
        "gene_no", "model_no", F.col("trans_id").alias("transcript_id"), "num_clusters", "sources", csv("start_wobble").alias("start_wobble_list"), csv("end_wobble").alias("end_wobble_list"),
        "exon_start_support", "exon_end_support", "all_source_trans",
    )


def gene_report(provenance: DataFrame) -> DataFrame:
    """Per merged gene: source models, merged models, sources, bounds and source genes."""
    one = provenance.withColumn("from_gene", F.concat_ws("_", "source", F.substring_index("source_trans", ".", 1)))
    names = one.select("gene", "source", "from_gene").distinct()
    summary = names.groupBy("gene", "source").count().groupBy("gene").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", F.col("count").cast("string")))), ",").alias("source_summary"))
    out = one.groupBy("gene_no", "gene").agg(
        F.countDistinct("tx").alias("num_clusters"), F.countDistinct("trans_id").alias("num_final_trans"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.first("scaf").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set("from_gene")), ",").alias("source_genes"),
    )
    return out.join(summary, "gene").select("gene_no", F.col("gene").alias("gene_id"), "num_clusters", "num_final_trans", "sources", "chrom", "start", "end", "source_genes", "source_summary")
