"""Nearest values within a group, at any distance and for groups of any size.

Both sides are dealt by ranges of (group, value), so a large group lies in several ranges and no list of pairs comes up. In a
range, running extremes carry the last candidate at or below a value and, in the other direction, the first at or above it.
What a range can't see, the extremes of the ranges before and behind it in the same group, comes from a table with one row for
each group and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.sources.shared import saved


def nearest_sorted(queries: DataFrame, candidates: DataFrame, group: str, query_value: str, value: str, place: str, rows_per_range: int = 1_000_000) -> DataFrame:
    """``queries`` with ``near``, a struct (distance, value, place, delta) of the group's nearest candidate; null without one.

    ``delta`` is candidate less query, ``distance`` its size, both in the type of the values. Of candidates equally far the
    lower value counts, of equal values the lowest place. Null and NaN values have no nearest candidate and are none. In single
    precision, differences of values within a factor of two are exact; beyond, what rounds alike counts as equally far only among
    the two neighbours of a query. Both tables are written to the shared folder, as they are and in their ranges.
    """
    spark = queries.sparkSession
    names = queries.columns
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    own = queries.select(group, F.struct(*names).alias("_row"), F.when(usable(query_value), F.col(query_value)).alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_place"))
    other = candidates.where(usable(value)).select(group, F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_kind"), F.col(place).cast("long").alias("_place"))
    both = saved(own.unionByName(other))  # counted, sampled for ranges and dealt: three passes
    total = both.count()
    ranges = max(1, -(-total // rows_per_range), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 10_000)))
    # ties between rows are broken by a hash, so equal values of a group can be cut, too
    both = both.withColumn("_tie", F.xxhash64("_row", "_place"))
    dealt = saved(both.repartitionByRange(ranges, group, "_v", "_kind", "_tie").withColumn("_range", F.spark_partition_id()).drop("_tie"))
    low = F.when(F.col("_kind") == 0, F.struct(F.col("_v").alias("v"), (-F.col("_place")).alias("p")))
    high = F.when(F.col("_kind") == 0, F.struct(F.col("_v").alias("v"), F.col("_place").alias("p")))
    up = Window.partitionBy(group, "_range").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(group, "_range").orderBy(F.desc("_v"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("_low", F.max(low).over(up)).withColumn("_high", F.min(high).over(down)).where("_kind = 1")
    # one row for each group and range: what the ranges before and behind hold
    borders = dealt.groupBy(group, "_range").agg(F.max(low).alias("_top"), F.min(high).alias("_bottom"))
    along = Window.partitionBy(group).orderBy("_range")
    back = Window.partitionBy(group).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.max("_top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_bottom").over(back).alias("_behind"))
    found = inside.join(borders, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_at")), "left")
    below = F.array_max(F.array("_low", "_before"))
    above = F.array_min(F.array("_high", "_behind"))
    choice = lambda c, p: F.when(c.isNotNull() & F.col("_v").isNotNull(), F.struct(F.abs(c["v"] - F.col("_v")).alias("distance"), c["v"].alias("value"), p.alias("place"), (c["v"] - F.col("_v")).alias("delta")))
    near = F.array_min(F.array(choice(below, -below["p"]), choice(above, above["p"])))
    return found.select("_row.*", near.alias("near"))
