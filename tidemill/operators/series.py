"""Ordered-series operators without a global window.

Rows are dealt to slots, ranges of timestamps. Each slot works on its own rows, and what
crosses a slot's edge (its last row, its sum, its row count) is taken from a table with
one row per slot. Borders of slots follow the data, whatever the unit of its timestamps: up to
``SEGMENTS`` ranges between quantiles, each cut to equal widths, so that a slot has about
``SLOT_ROWS`` rows. A width may be given instead.

Defined results: rows with a null timestamp are left out; of rows of one timestamp, which a
series does not have, any may stand first; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_ROWS, SEGMENTS, MOST_SLOTS = 1 << 17, 64, 1 << 20
SLOT = "_slot"


def slot_of(points: DataFrame, width: "int | Column | None" = None) -> Column:
    """The slot of a row; ``width`` is one of timestamps, or a slot that was made before."""
    t = F.col("timestamp")
    if isinstance(width, Column):
        return width
    if width is not None:
        return F.floor(t / F.lit(width)).cast("long")
    share = [k / SEGMENTS for k in range(1, SEGMENTS)]
    found = points.agg(F.count("timestamp").alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"), F.percentile_approx("timestamp", share, 1000).alias("borders")).first()
    slots = min(MOST_SLOTS, found["n"] // SLOT_ROWS + 1)
    if slots == 1:
        return F.lit(0).cast("long")
    inner = sorted(set(found["borders"]) - {found["low"]})
    edges = [found["low"], *inner[:: -(-SEGMENTS // slots)], found["high"] + 1]
    cuts = -(-slots // (len(edges) - 1))

    def segment(first: int, last: int) -> Column:
        """The slot of a timestamp from edge ``first`` to edge ``last``."""
        if last - first > 1:
            middle = (first + last) // 2
            return F.when(t < edges[middle], segment(first, middle)).otherwise(segment(middle, last))
        low, span = edges[first], edges[last] - edges[first]
        step = max(1, -(-span // cuts))
        return F.lit(first * cuts) + F.floor((t - F.lit(low)) / F.lit(step)).cast("long")

    return segment(0, len(edges) - 1)


def slotted(points: DataFrame, slot: Column) -> DataFrame:
    return points.where("timestamp is not null").withColumn(SLOT, slot)


def _inside() -> Window:
    return Window.partitionBy(SLOT).orderBy("timestamp")


def _over_slots() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(SLOT)


def previous(points: DataFrame, column: str, width: "int | Column | None" = None) -> DataFrame:
    """Adds ``previous``: the column's value in the row before, null in the first row."""
    rows = slotted(points, slot_of(points, width))
    last = rows.groupBy(SLOT).agg(F.max_by(column, "timestamp").alias("last"))
    edge = last.select(SLOT, F.lag("last").over(_over_slots()).alias("edge"))
    first = F.row_number().over(_inside()) == 1
    return (
        rows.withColumn("_own", F.lag(column).over(_inside()))
        .withColumn("_first", first)
        .join(edge, SLOT)
        .withColumn("previous", F.when(F.col("_first"), F.col("edge")).otherwise(F.col("_own")))
        .drop(SLOT, "_own", "_first", "edge")
    )


def delta(points: DataFrame, column: str = "timestamp", width: "int | Column | None" = None) -> DataFrame:
    """(timestamp, delta) of every row but the first."""
    return previous(points, column, width).where(F.col("previous").isNotNull()).select("timestamp", (F.col(column) - F.col("previous")).alias("delta"))


def delta_of_delta(points: DataFrame, width: "int | Column | None" = None) -> DataFrame:
    """(timestamp, dod) of every row but the first two."""
    slot = slot_of(points, width)
    return delta(delta(points, width=slot), "delta", slot).withColumnRenamed("delta", "dod")


def xor(points: DataFrame, bits: str = "bits", width: "int | Column | None" = None) -> DataFrame:
    """(timestamp, xor) of the bit patterns of neighbours, of every row but the first."""
    return previous(points, bits, width).where(F.col("previous").isNotNull()).select("timestamp", F.col(bits).bitwiseXOR(F.col("previous")).alias("xor"))


def _running(points: DataFrame, column: str, total, joined, width) -> DataFrame:
    rows = slotted(points, slot_of(points, width))
    sums = rows.groupBy(SLOT).agg(total(column).alias("sum"))
    before = sums.select(SLOT, total("sum").over(_over_slots().rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = total(column).over(_inside().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, SLOT).withColumn("running", joined(F.coalesce("before", F.lit(0)), F.col("_own"))).drop(SLOT, "_own", "before")


def running_sum(points: DataFrame, column: str, width: "int | Column | None" = None) -> DataFrame:
    """Adds ``running``: the sum of the column up to the row."""
    return _running(points, column, F.sum, lambda a, b: (a + b).cast("long"), width)


def running_xor(points: DataFrame, column: str, width: "int | Column | None" = None) -> DataFrame:
    """Adds ``running``: the XOR of the column up to the row."""
    return _running(points, column, F.bit_xor, lambda a, b: a.bitwiseXOR(b), width)


def ranked(points: DataFrame, width: "int | Column | None" = None) -> DataFrame:
    """Adds ``rank``: the row's place in the series, from 0."""
    rows = slotted(points, slot_of(points, width))
    counts = rows.groupBy(SLOT).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(SLOT, (F.sum("n").over(_over_slots()) - F.col("n")).alias("before"))
    own = F.row_number().over(_inside())
    return rows.withColumn("_own", own).join(before, SLOT).withColumn("rank", F.col("before") + F.col("_own") - 1).drop(SLOT, "_own", "before")


def array_delta(values: Column) -> Column:
    """Differences of neighbours in an array; empty for fewer than two values."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)
    return F.when(n >= 2, pairs).otherwise(F.slice(values, 1, 0))


def array_delta_of_delta(values: Column) -> Column:
    """Second differences in an array; empty for fewer than three values."""
    return F.when(F.size(values) >= 3, array_delta(array_delta(values))).otherwise(F.slice(values, 1, 0))


def array_xor(bits: Column) -> Column:
    """XORs of neighbouring bit patterns in an array; empty for fewer than two."""
    n = F.size(bits)
    pairs = F.zip_with(F.slice(bits, 2, F.greatest(n - 1, F.lit(0))), F.slice(bits, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a.bitwiseXOR(b))
    return F.when(n >= 2, pairs).otherwise(F.slice(bits, 1, 0))
