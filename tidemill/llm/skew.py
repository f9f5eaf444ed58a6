"""Joins by checked sizes: few ids are broadcast, and one key may hold a large part of the rows.

In ``with_least`` a key with more than one in ``HEAVY`` of all rows is heavy; there are at most ``HEAVY`` of them, so
their table is broadcast and their rows stay where they are. All other rows are joined by shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import graph

HEAVY = 1_000
#: Most ids that are broadcast (some 70 MB in an executor); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def with_least(rows: DataFrame, keys: list[str], value: str, name: str, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with ``name``: the smallest ``value`` among the rows of the same keys; null where no
    other row has them. Keys are not null; ``name`` and ``_n`` are no columns of ``rows``.

    The smallest values are aggregated before their shuffle."""
    least = rows.groupBy(*keys).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("_n"))
    least = graph.cut_lineage(least.where("_n > 1"))
    total = least.agg(F.sum("_n")).first()[0] or 0
    large = F.broadcast(least.where(F.col("_n") * heavy > total).drop("_n"))
    rest = rows.join(large.select(*keys), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(least.drop("_n").hint("merge"), keys, "left"))


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` (one column, kept in the shared folder) to be broadcast if they are few, else to be shuffled."""
    ids = graph.cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
