"""Connected components of a distributed graph.

Edges are replaced, partition by partition, by stars around the smallest nodes that a
union-find shows; where at most ``PER_TASK`` are left, which is checked, one task finishes them so. Alternating large-star and small-star steps then bring every node next to the
smallest node of its component in a number of rounds that grows with the logarithm of the
longest path. A step groups edges by node for a minimum, which combines before the shuffle, and
joins that minimum back; no node's edges are ever gathered. Lineage is cut after each
round by a checkpoint in the folder that ``spark.checkpoint.dir`` names.

Null nodes are no nodes: edges with one are left out.
"""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (16 bytes each) that one task takes.
PER_TASK = 1 << 20


def shared_folder(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the context's checkpoint folder. Only where neither is
    set, and the master is local, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        folder = tempfile.mkdtemp(prefix="checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for large rows that several steps read. A result may read it
    whenever it runs, so it stays; the folder may be cleared when the session's results have been read."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark, path: str) -> None:
    """Removes a folder in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges (high, low) as stars around the smallest nodes of their components."""

    def stars(batches):
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if found:
            high, low = local_stars(*map(np.concatenate, zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["high", "low"])

    return edges.mapInArrow(stars, "high long, low long")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node tells its smallest neighbour (or itself) to its larger or other neighbours."""
    both = edges if not larger else edges.unionAll(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    # Here a row is (node: high, neighbour: low); for small stars neighbours are smaller.
    least = both.groupBy("high").agg(F.min("low").alias("least")).select(F.col("high").alias("node"), F.least("high", "least").alias("least"))
    joined = both.join(least.hint("merge"), F.col("high") == F.col("node"))
    if larger:
        told = joined.where("low > high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    else:
        told = joined.select(F.col("low").alias("high"), F.col("least").alias("low")).unionAll(least.select(F.col("node").alias("high"), F.col("least").alias("low")))
    return told.where("high > low").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum of the edges; one row per partition reaches the driver, without a shuffle."""

    def summed(batches):
        count, total = 0, 0
        for batch in batches:
            count += batch.num_rows
            total += int(batch.column(0).to_numpy().view(np.uint64).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total % (1 << 62)])], names=["count", "total"])

    rows = edges.select(F.xxhash64("high", "low")).mapInArrow(summed, "count long, total long").collect()
    return sum(r["count"] for r in rows), sum(r["total"] for r in rows) % (1 << 62)


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component) of every node but the smallest ones, by union-find."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    half = len(a)
    for x, y in zip(flat[:half].tolist(), flat[half:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(nodes))])
    rest = roots != np.arange(len(nodes))
    return nodes[rest], nodes[roots[rest]]


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, root) of every node of an edge but the roots; edges are columns ``a`` and ``b``."""
    stars = edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("a is not null and b is not null and high > low")
    # Edges are kept first: what makes them may be a Python function, and two in one task take twice the workers.
    stars = cut_lineage(stars)
    before = (-1, 0)
    # While the edges are more than a task takes; else a union-find has them all at once.
    while (mark := _mark(stars)) != before and mark[0] > per_task:
        before = mark
        stars = contracted(stars.coalesce(1 + mark[0] // per_task))
        stars = cut_lineage(_star(_star(stars, True), False))
    found = contracted(stars.coalesce(1)) if mark[0] <= per_task else stars
    return found.select(F.col("high").alias("node"), F.col("low").alias("root"))
