"""Newest write wins: one row per timestamp.

The version is a BIGINT, which keeps ``max_by`` a hash aggregate with partial
aggregation before the shuffle; a struct version would sort.

Defined results: versions of one timestamp differ (of equal ones any may win); a null version
loses to all others; rows with a null timestamp are one group, as in any grouping; an empty table
gives no rows. ``between`` drops null timestamps, and ``distinct_count`` does not count them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(points: DataFrame, version: str, *keep: str) -> DataFrame:
    """The value of the highest version of each timestamp; ``keep`` names more key columns."""
    return points.groupBy(*keep, "timestamp").agg(F.max_by("value", version).alias("value"))


def joined(runs: list[DataFrame]) -> DataFrame:
    """All rows of all runs, repeated timestamps too."""
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union


def merged(runs: list[DataFrame]) -> DataFrame:
    """Union of runs, oldest first, with the newest run's value for each timestamp."""
    return newest(joined([run.select("timestamp", "value", F.lit(k).cast("long").alias("generation")) for k, run in enumerate(runs)]), "generation")


def between(points: DataFrame, start: int, end: int) -> DataFrame:
    """Points with start <= timestamp <= end; none if start > end. Reaches the Parquet scan."""
    return points.where(F.col("timestamp").between(start, end))


def distinct_count(points: DataFrame, capacity: int, point_bytes: int) -> DataFrame:
    """Fill of a memtable: distinct timestamps and whether they use up ``capacity`` bytes."""
    n = F.count_distinct("timestamp")
    return points.agg(n.alias("len"), (n * point_bytes >= capacity).alias("is_full"), (n == 0).alias("is_empty"))
