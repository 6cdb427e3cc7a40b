"""Pairwise text reports of protein searches: one row a query, then the best hit of each transcript."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.sources.readers import records

_PERCENT = re.compile(r" Identities = [^/,]*/\S+ \(([^%,]*)%")
_SCHEMA = "ord long, query string, hits array<struct<subject: string, subject_length: bigint, identity: string, aligned: bigint>>"


def _subject(name: str, style: str) -> str:
    words = name.split()
    if style == "uniref":
        return words[0] if words else ""
    if style == "ensembl":
        found = {k: v for k, _, v in (w.partition(":") for w in words) if k in ("gene", "transcript")}
        return f"{found.get('gene', '')},{found.get('transcript', '')}"
    return name


def _number(text: str) -> int:
    return int(text) if text.strip().lstrip("-").isdigit() else 0


def _closed(block: list[str]) -> list[str] | None:
    """A hit's lines up to the first two blank ones that have anything behind them; None if there are none."""
    for k in range(2, len(block)):
        if not block[k - 1] and not block[k - 2]:
            return block[: k - 2]
    return None


def _hit(block: list[str], style: str) -> tuple[str, int, str, int]:
    """(subject, its length, identity, aligned places) of one hit; of its alignments the last one counts."""
    size = next((k for k, x in enumerate(block) if x.startswith("Length=")), None)
    name = "" if size is None else _subject(block[0][1:].lstrip() + "".join(block[1:size]), style)
    scores = [k for k, x in enumerate(block) if x.startswith(" Identities")]
    cells = {k: x.split() for k, x in enumerate(block) if x.startswith("Sbjct ")}
    percent = _PERCENT.match(block[scores[-1]]) if scores else None
    begins = [next((cells[k] for k in cells if k > s), None) for s in scores]
    first = next((c[1] if len(c) > 1 else "" for c in reversed(begins) if c), "")
    end = next((c[3] for c in reversed(cells.values()) if len(c) > 3), "")
    return name, 0 if size is None else _number(block[size][7:]), percent.group(1) if percent else "0", _number(end) + 1 - _number(first)


def parse_query(block: str, style: str = "uniref", last: bool = False) -> tuple[str, list[tuple[str, int, str, int]]] | None:
    """(query, hits) from what follows ``Query=``; None for sequences marked missing_nucleotides.

    Two blank lines with anything behind them (the next query at least) close a hit; others are lost.
    """
    lines = [x.rstrip("\r") for x in block.removesuffix("\n").split("\n")]
    head, at = (lines[0].split() or [""])[0], 1
    if lines[0].endswith("-") and len(lines) > 1:
        head, at = head + lines[1], 2
    if "missing_nucleotides" in lines[0] or "missing_nucleotides" in head:
        return None
    size = next((k for k in range(at, len(lines)) if lines[k].startswith("Length=")), len(lines))
    head += "".join(lines[at:size])
    body = lines[size + 1 :] + ([] if last else ["Query="])
    marks = [k for k, x in enumerate(body) if x.startswith(">")]
    # A hit's block ends with the mark of the next one, which stands behind its blank lines.
    found = [_closed(body[a : b + 1]) for a, b in zip(marks, [*marks[1:], len(body)])]
    return head, [_hit(x, style) for x in found if x]


def blastp(spark: SparkSession, path: str, style: str = "uniref") -> DataFrame:
    """(ord, query, hits): one row a query, in file order; ``style``: uniref or ensembl subject names."""
    blocks = records(spark, path, "Query=")
    total = blocks.count()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for o, text in zip(f["ord"], f["value"]):
                got = parse_query(text, style, o == total - 1)
                if got:
                    rows.append((o, got[0], [dict(zip(("subject", "subject_length", "identity", "aligned"), h)) for h in got[1]]))
            yield pd.DataFrame(rows, columns=["ord", "query", "hits"])

    return blocks.where("ord > 0").mapInPandas(work, _SCHEMA)


def best_hits(queries: DataFrame) -> DataFrame:
    """Per transcript (in order of appearance) the hit with the largest aligned share of its subject, the
    first of equal ones; without a hit, the longest reading frame as ``no_hit``."""
    p = F.split("query", ":")
    cell = lambda back: F.element_at(p, -back)
    places = [cell(7).alias("frame"), cell(6).alias("nuc_start"), cell(5).alias("nuc_end"), cell(4).alias("rel_start"), cell(3).alias("rel_end")]
    rows = queries.withColumn("tid", F.substring_index(p[0], "(", 1)).select("ord", "tid", *places, cell(2).cast("long").alias("orf_length"), "hits")
    order = rows.groupBy("tid").agg(F.min("ord").alias("ord"))
    place = ("frame", "nuc_start", "nuc_end", "rel_start", "rel_end")
    share = F.try_divide(F.col("h.aligned").cast("double"), F.col("h.subject_length").cast("double"))
    hit = rows.select("ord", "tid", *place, F.posexplode("hits").alias("k", "h")).withColumn("share", share).where("share > 0")
    best = hit.groupBy("tid").agg(F.max(F.struct("share", (-F.col("ord")).alias("o"), (-F.col("k")).alias("k"), F.struct(*place, F.col("h.subject").alias("subject"), F.col("h.identity").alias("identity")).alias("row"))).alias("b"))
    longest = rows.where("orf_length > 0").groupBy("tid").agg(F.max(F.struct("orf_length", (-F.col("ord")).alias("o"), F.struct(*place).alias("row"))).alias("l"))
    s = F.col("b.share")
    match = F.when((s >= 1) & (s < 2), "full_match").when(s >= 0.9, "90_match").when(s >= 0.5, "50_match").otherwise("bad_match")
    out = order.join(best, "tid", "left").join(longest, "tid", "left")
    return out.select(
        "ord", "tid", *(F.coalesce(f"b.row.{c}", f"l.row.{c}").alias(c) for c in place), F.coalesce("b.row.subject", F.lit("none")).alias("subject"),
        F.when(s.isNull(), "no_hit").otherwise(match).alias("match"), F.coalesce(F.floor(s * 100).cast("string"), F.lit("0")).alias("percent"), F.coalesce("b.row.identity", F.lit("0")).alias("identity"),
    )
