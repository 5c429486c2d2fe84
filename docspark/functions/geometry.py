"""Rectangles: structs with x0, y0, x1, y1 (and page), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two rectangles share; 0 where they don't meet."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 on different pages or where the union has no area."""
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(a["page"] != b["page"], 0.0).when(union <= 0, 0.0).otherwise(both / union)


def padded(b: Column, page_width: Column, page_height: Column, by: float = 5.0) -> Column:
    """The rectangle grown on every side, within the page."""
    return F.struct(
        F.greatest(F.lit(0.0), b["x0"] - by).alias("x0"),
        F.greatest(F.lit(0.0), b["y0"] - by).alias("y0"),
        F.least(page_width, b["x1"] + by).alias("x1"),
        F.least(page_height, b["y1"] + by).alias("y1"),
    )


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Same page, and all four coordinates differ by less than the tolerance."""
    close = a["page"] == b["page"]
    for k in ("x0", "y0", "x1", "y1"):
        close = close & (F.abs(a[k] - b[k]) < tolerance)
    return close
