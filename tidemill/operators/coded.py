"""Blocks of points as coded bytes, one row per block.

Defined results: rows with a null timestamp are in no block; a null value becomes NaN; an
empty table gives no rows.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codecs
from tidemill.operators import blocks

CODED = "block_id long, point_count long, timestamps binary, vals binary"


def encode(points: DataFrame) -> DataFrame:
    """Coded blocks; a block has at most 1024 points, so gathering one is bounded."""
    rows = blocks.blocked(points).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "value"))).alias("points"))

    def coded(batches):
        for batch in batches:
            out = []
            for block, group in zip(batch["block_id"].to_pylist(), batch["points"], strict=True):
                flat = group.values
                t, v = flat.field("timestamp").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
                out.append((block, len(t), codecs.encode_timestamps(t), codecs.encode_values(v)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                names=["block_id", "point_count", "timestamps", "vals"],
            )

    return rows.mapInArrow(coded, CODED)


def decode(coded: DataFrame) -> DataFrame:
    def points(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = codecs.decode_timestamps(row["timestamps"], row["point_count"])
                v = codecs.decode_values(row["vals"], row["point_count"])
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(v)], names=["timestamp", "value"])

    return coded.select("point_count", "timestamps", "vals").mapInArrow(points, "timestamp long, value double")
