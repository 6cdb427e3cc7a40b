"""Column expressions that render rows as interchange lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _csv(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def bed_line(scaffold: Column, id_line: Column, strand: Column, starts: Column, ends: Column, score: str = "40", rgb: str | Column = "255,0,0", thick: tuple[Column, Column] | None = None, span: tuple[Column, Column] | None = None) -> Column:
    """A BED12 line from absolute exon bounds."""
    start, end = span or (F.element_at(starts, 1), F.element_at(ends, -1))
    a, b = thick or (start, end)
    s = lambda c: c.cast("string")
    return F.concat_ws(
        "\t", scaffold, s(start), s(end), id_line, F.lit(score), strand, s(a), s(b), F.lit(rgb), s(F.size(starts)),
        _csv(F.zip_with(ends, starts, lambda x, y: x - y)), _csv(F.transform(starts, lambda x: x - start)),
    )
