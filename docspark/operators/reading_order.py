"""Reading order of one- and two-column pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FULL_WIDTH = 0.6


def reading_order(df: DataFrame, full_width: float = FULL_WIDTH, keep_overlaps: bool = False) -> DataFrame:
    """Adds zone, column (0 left, 1 right, 2 full width) and pos, the place in the document.

    Full-width blocks divide a page into zones; within a zone the left column comes before the right one, then the full-width block that
    closes the zone.  A column block belongs to the zone with ``previous bottom < y0 < top``, or after the last full-width block if
    ``y0 >= bottom``.  One that begins beside a full-width block belongs to no zone and is left out, unless ``keep_overlaps``: then
    it is read in the zone after that block.
    """
    on_page = Window.partitionBy("doc_id", "page")
    ratio = (F.col("x1") - F.col("x0")) / F.col("page_width")
    full = (F.col("page_width") <= 0) | (ratio >= full_width)
    first_width = F.first("page_width").over(on_page.orderBy("block_ord"))
    middle = F.when(first_width > 0, first_width / 2).otherwise(F.lit(float("inf")))
    side = F.when((F.col("x0") + F.col("x1")) / 2 <= middle, 0).otherwise(1)
    df = df.withColumn("column", F.when(full, 2).otherwise(side))
    bars = F.array_sort(F.collect_list(F.when(F.col("column") == 2, F.struct("y0", "block_ord", "y1"))).over(on_page))
    df = df.withColumn("__bars", bars)
    y0 = F.col("y0")
    tops = F.transform("__bars", lambda b: b["y0"])
    bottoms = F.transform("__bars", lambda b: b["y1"])
    fits = F.transform(F.arrays_zip(F.concat(F.array(F.lit(-1.0)), bottoms).alias("over"), tops.alias("top")), lambda z: (z["over"] < y0) & (y0 < z["top"]))
    n = F.size("__bars")
    # the last pair has no top: its comparison is null, never true
    inside = F.array_position(F.transform(fits, lambda f: F.coalesce(f, F.lit(False))), True) - 1
    last = F.when(n > 0, F.element_at(bottoms, -1)).otherwise(-1.0)
    own = F.array_position(F.transform("__bars", lambda b: b["block_ord"]), F.col("block_ord")) - 1
    zone = F.when(F.col("column") == 2, own).when(inside >= 0, inside).when(y0 >= last, n.cast("long"))
    if keep_overlaps:
        zone = F.coalesce(zone, F.size(F.filter(tops, lambda t: t <= y0)).cast("long"))
    df = df.withColumn("zone", zone).drop("__bars").where("zone is not null")
    order = Window.partitionBy("doc_id").orderBy("page", "zone", "column", "y0", "block_ord")
    return df.withColumn("pos", F.row_number().over(order) - 1)
