"""Blocks of 1024 points: sparse index, file header, pruning, coded sizes.

Defined results: as in ``series``, rows with a null timestamp are in no block; a null value is a
point like others here; an empty table has no blocks and a header of nulls and zeros.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.codecs import CLASSES
from tidemill.operators import series
from tidemill.schema import BLOCK_POINTS


def blocked(points: DataFrame, width: "int | Column | None" = None) -> DataFrame:
    return series.ranked(points, width).withColumn("block_id", F.expr(f"rank div {BLOCK_POINTS}"))


def index(points: DataFrame, width: "int | Column | None" = None) -> DataFrame:
    """block_id, first_timestamp, last_timestamp, point_count."""
    return (
        blocked(points, width)
        .groupBy("block_id")
        .agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count(F.lit(1)).alias("point_count"))
    )


def touched(block_index: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks that a range scan has to read."""
    return block_index.where((F.col("first_timestamp") <= end) & (F.col("last_timestamp") >= start))


def header(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.count(F.lit(1)).alias("total_points"),
        F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).cast("long").alias("block_count"),
    )


def dod_bits(points: DataFrame, width: "int | Column | None" = None) -> DataFrame:
    """Bits that each block's timestamps take in the codec: 64 for each of the first two, a class for the rest."""
    order = Window.partitionBy("block_id").orderBy("timestamp")
    t = F.col("timestamp")
    dod = t - 2 * F.lag(t, 1).over(order) + F.lag(t, 2).over(order)
    cost = F.when(F.col("dod").isNull(), 64).when(F.col("dod") == 0, 1)
    for _, prefix, payload in CLASSES[:-1]:
        half = 1 << (payload - 1)
        cost = cost.when(F.col("dod").between(-half, half - 1), prefix + payload)
    rest = CLASSES[-1][1] + CLASSES[-1][2]
    return blocked(points, width).withColumn("dod", dod).groupBy("block_id").agg(F.sum(cost.otherwise(rest)).cast("long").alias("dod_bits"))
