"""Column expressions over long arrays and texts, with work in proportion to their length.

Inside a lambda Spark evaluates an expression again for every element, and appending to an array copies it; so values are bound to
names first, and running results are made block by block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
#: Code points in a block of text.
WIDTH = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, op: Callable[[Column, Column], Column], start: Column, levels: int = 2) -> Column:
    """For each element of an array of longs, the result of ``op`` over ``start`` and all elements before it."""
    none = F.array().cast("array<bigint>")

    def appended(block: Column, first: Column) -> Column:
        zero = F.struct(first.alias("now"), none.alias("out"))
        step = lambda a, x: F.struct(op(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
        return F.aggregate(block, zero, step, lambda a: a["out"])

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

        def with_blocks(bs: Column) -> Column:
            firsts = scan(F.transform(bs, lambda b: F.aggregate(b, start, op)), op, start, levels - 1)
            return let(firsts, lambda f: F.flatten(F.transform(bs, lambda b, i: appended(b, F.get(f, i)))))

        return let(blocks, with_blocks)

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, appended(v, start)).otherwise(blocked(v)) if levels else appended(v, start))


def sums_before(values: Column) -> Column:
    """For each element of an array of longs, the sum of all before it."""
    return scan(values, lambda a, x: a + x, F.lit(0).cast("long"))


def greatest_before(values: Column, least: int) -> Column:
    """For each element of an array of longs, the greatest before it, or ``least``."""
    return scan(values, lambda a, x: F.greatest(a, x), F.lit(least).cast("long"))


def text_blocks(text: Column) -> Column:
    """The text in blocks of WIDTH code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text in blocks; work follows their number, not their place."""
    first = F.floor(start / WIDTH).cast("int")
    last = F.floor((end - 1) / WIDTH).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(some, (start - F.lit(WIDTH).cast("long") * first + 1).cast("int"), (end - start).cast("int"))).otherwise("")
