"""The record type: a 64-bit timestamp without a unit and a double."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("timestamp", T.LongType(), False), T.StructField("value", T.DoubleType(), False)])
POINT_SEQ = T.StructType([*POINT.fields, T.StructField("seq", T.LongType(), False)])
#: Memory that one distinct timestamp takes of a table's capacity, in bytes.
POINT_BYTES = 64
#: Points in a block.
BLOCK_POINTS = 1024


def checked(points: DataFrame, *columns: str) -> DataFrame:
    """The named columns as BIGINT or DOUBLE; a null in one of them fails the query."""
    kinds = {"value": "double"}
    return points.select(
        *[
            F.coalesce(F.col(c), F.raise_error(F.lit(f"null in column {c}")).cast(kinds.get(c, "long"))).cast(kinds.get(c, "long")).alias(c)
            for c in columns
        ]
    )
