"""Join of points to the ranges that hold them, for ranges of any width that may overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the blocks: a block of level k holds 2**k whole numbers and begins at a multiple of 2**k.
LEVELS = 62


def range_blocks(low: Column, high: Column) -> Column:
    """The blocks (level, number) that cover [low, high] exactly, without overlap: at most two of a level.

    At level k the blocks that lie inside the range run from ceil(low / 2**k) to floor((high + 1) / 2**k) - 1; the first is taken
    where its number is odd and the last where its number is even, since larger blocks cover the rest.
    """
    def of_level(k: Column) -> Column:
        # -floor(-low / 2**k); both shifts keep the sign
        first = -F.call_function("shiftright", -low, k)
        last = F.call_function("shiftright", high + F.lit(1), k) - F.lit(1)
        inside = first <= last
        starts, ends = inside & (F.pmod(first, F.lit(2)) == 1), inside & (F.pmod(last, F.lit(2)) == 0)
        taken = F.array(F.when(starts, F.struct(k.alias("level"), first.alias("number"))),
                        F.when(ends, F.struct(k.alias("level"), last.alias("number"))))
        return F.filter(taken, lambda b: b.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, keys: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Rows of ``points`` with every row of ``ranges`` of equal ``keys`` whose [``low``, ``high``] holds ``point``; whole numbers.

    ``how`` is ``inner``, or ``left`` to keep points in no range once, with nulls. Ranges that are empty (``low`` > ``high``) or have a
    null end hold nothing, and a null point lies in none. Values keep below 2**61 in size. Equal ranges each give a row.

    A range of any width is cut into at most 2 log2(width) blocks and a point asks for its block on each level that any
    range uses (at most 63, their numbers come to the driver), so the join is one of equal keys: no range is spread over its values, no pair is
    formed that does not match, and wide or overlapping ranges cost what narrow ones do.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    blocks = ranges.select(*[F.col(c) for c in ranges.columns], F.explode(range_blocks(F.col(low).cast("long"), F.col(high).cast("long"))).alias("_block"))
    blocks = blocks.select(*ranges.columns, F.col("_block.level").alias("_level"), F.col("_block.number").alias("_number"))
    levels = sorted(r["_level"] for r in blocks.select("_level").distinct().collect())
    number = lambda k: F.struct(F.lit(k).alias("_level"), F.shiftright(F.col(point).cast("long"), k).alias("_number"))
    asked = F.array(*map(number, levels)) if levels else F.array().cast("array<struct<_level: int, _number: bigint>>")
    matched = points.select("*", F.inline(asked)).join(blocks, [*keys, "_level", "_number"]).drop("_level", "_number")
    if how == "inner":
        return matched
    # a point's value and keys decide whether it lies anywhere: one row per value is enough to tell
    inside = matched.select(*keys, point).distinct()
    alone = points.join(inside, [*keys, point], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
