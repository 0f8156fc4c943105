"""Sections between anchors, and cells in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(anchors: DataFrame) -> DataFrame:
    """Anchors (doc, page, y) with the place where the next one begins, null for the last."""
    place = F.struct("page", "y")
    after = F.lead(place).over(Window.partitionBy("doc").orderBy("page", "y"))
    return anchors.select("doc", "page", "y", after["page"].alias("next_page"), after["y"].alias("next_y"))


def in_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Each cell (cell_id, x0, x1) in the column (role, c0, c1) that it overlaps most, null if none.

    Columns are those of one sheet, a handful; they are broadcast as one array.
    """
    listed = columns.agg(F.array_sort(F.collect_list(F.struct("c0", "c1", "role"))).alias("columns"))
    over = F.transform("columns", lambda c: F.struct((F.least("x1", c["c1"]) - F.greatest("x0", c["c0"])).alias("overlap"), (-c["c0"]).alias("first"), c["role"].alias("role")))
    hits = F.filter(over, lambda c: c["overlap"] > 0)
    best = F.array_max(hits)
    return cells.crossJoin(F.broadcast(listed)).select(*cells.columns, best["role"].alias("role"))
