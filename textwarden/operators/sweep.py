"""Which ranges lie in, or touch, others of their keys: a sweep instead of a join on ranges.

Ranges and the items asked about are put in one order by where they begin. The furthest
end of all ranges that began before an item tells whether one of them covers it, so each
row is read once, however many ranges a key has. A key may hold most of the rows: positions
are dealt in blocks of a fixed length, the sweep runs in each block, and what reaches into
a block from those before it comes from one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 1 << 14


def _same(keys: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def reached(items: DataFrame, ranges: DataFrame, keys: list[str], begin: Column, first: Column, last: Column) -> DataFrame:
    """``items`` with ``_reach``: the largest ``last`` of the ranges of the same keys whose ``first`` is not after ``begin``; null without one.

    ``begin`` is an expression over ``items``, ``first`` and ``last`` are over
    ``ranges``, all whole numbers. Null keys are equal to each other; a range with a null
    end is none. Other columns of the items stay, repeated items stay as often.
    """
    columns = F.struct(*[F.col(c) for c in items.columns])
    asked = items.select(*keys, begin.cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_last"), columns.alias("_item"))
    given = ranges.select(*keys, first.cast("long").alias("_at"), F.lit(0).alias("_kind"), last.cast("long").alias("_last")).where("_at is not null and _last is not null")
    rows = asked.unionByName(given, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_inner", F.max("_last").over(inside)).where("_kind = 1")
    # One row a block: what the blocks before it reach.
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_block").agg(F.max("_last").alias("_most")).withColumn("_carried", F.max("_most").over(before)).where("_carried is not null")
    joined = swept.alias("s").join(blocks.drop("_most").alias("b"), _same([*keys, "_block"], "s", "b"), "left")
    return joined.select("s._item.*", F.greatest(F.col("s._inner"), F.col("b._carried")).alias("_reach"))


def _without_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def inside_one(items: DataFrame, ranges: DataFrame, keys: list[str], begin: str, end: str, first: str, last: str, inside: bool = True) -> DataFrame:
    """Items of which some range covers ``begin`` to ``end``; with ``inside`` false the others. Null keys match nothing."""
    swept = reached(items, _without_nulls(ranges, keys), keys, F.col(begin), F.col(first), F.col(last))
    covered = F.coalesce(F.col("_reach") >= F.col(end), F.lit(False))
    return swept.where(covered if inside else ~covered).drop("_reach")


def touching_none(items: DataFrame, ranges: DataFrame, keys: list[str], begin: str, end: str, first: str, last: str) -> DataFrame:
    """Items (``begin`` to ``end``, exclusive) that share no position with a range; null keys are equal."""
    swept = reached(items, ranges, keys, F.col(end) - 1, F.col(first), F.col(last))
    return swept.where(~F.coalesce(F.col("_reach") > F.col(begin), F.lit(False))).drop("_reach")
