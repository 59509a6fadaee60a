"""Exact values at given ranks of each key, without sorting or gathering the rows of a large key.

A key's range of values is cut into buckets, which are counted where the rows are; the bucket
that holds a rank becomes the next range, from its least to its largest value, until
these are one. Each round reads the values still in range and keeps one row a rank.
Keys of few rows are ranked by a window, which is bounded by what a task may sort; both
ways give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.sources.tables import scratch_path

#: Rows of a key that a task sorts; buckets of a range.
MOST_SORTED, BUCKETS = 100_000, 4096


def _equal(keys: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def values_at(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], most_sorted: int | None = None) -> DataFrame:
    """``keys, n`` and for each of ``ranks`` the value at that rank (from 0, an expression over ``n``) in ascending order.

    ``value`` must hold no nulls and no NaN; null keys are a key. A rank outside 0 to n - 1 gives null.
    """
    spark, most_sorted = rows.sparkSession, MOST_SORTED if most_sorted is None else most_sorted
    data = rows.select(*keys, F.col(value).alias("_v"))
    sizes_of = lambda d: d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    root = scratch_path(spark, "ranks")
    count = iter(range(10**6))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(count)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # Rows are read once a round: what they are made by is not repeated.
    data = keep(data)
    sizes = keep(sizes_of(data))
    small, large = sizes.where(F.col("n") <= most_sorted), sizes.where(F.col("n") > most_sorted)
    found = [_sorted(data.alias("d").join(small.alias("s"), _equal(keys, "d", "s")).select("d.*", "s.n"), keys, asked)]
    open_ = keep(large.select("*", F.explode(asked).alias("_asked")).select(*keys, "_low", "_high", F.col("_asked.name").alias("_name"), F.col("_asked.rank").alias("_rank")).where("_rank between 0 and n - 1"))
    while True:
        found.append(open_.where("_low = _high").select(*keys, F.col("_name"), F.col("_low").alias("_value")))
        open_ = open_.where("_low < _high")
        if open_.isEmpty():
            break
        open_ = keep(_narrowed(data, open_, keys))
    values = found[0]
    for part in found[1:]:
        values = values.unionByName(part)
    by_key = values.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in ranks])
    return sizes.select(*keys, "n").alias("s").join(by_key.alias("v"), _equal(keys, "s", "v"), "left").select("s.*", *[f"v.{name}" for name in ranks])


def _sorted(data: DataFrame, keys: list[str], asked: Column) -> DataFrame:
    ranked = data.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1)
    hit = ranked.select(*keys, "_v", "_rank", F.explode(asked).alias("_asked")).where("_asked.rank = _rank")
    return hit.select(*keys, F.col("_asked.name").alias("_name"), F.col("_v").alias("_value"))


def _narrowed(data: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket of each open rank as its next range."""
    inside = data.alias("d").join(open_.alias("o"), _equal(keys, "d", "o")).where("_v between _low and _high").select("o.*", "d._v")
    # Halves first: the width of a range may be beyond what a double holds.
    width = F.col("_high") / 2 - F.col("_low") / 2
    share = F.when(width > 0, F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / width * BUCKETS), F.lit(BUCKETS - 1)))
    # The least value of a range is a bucket of its own where the others are too close to it to be told apart.
    bucket = F.when((width > 0) & (share > 0), share).when(F.col("_v") > F.col("_low"), 0).otherwise(-1)
    held = inside.groupBy(*keys, "_name", "_rank", bucket.alias("_bucket")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy(*keys, "_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = placed.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    return at.select(*keys, "_low", "_high", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"))
