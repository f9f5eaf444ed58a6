"""A folder that the driver and all executors see."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names. Only where that is unset, and the
    master is local, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        root = tempfile.mkdtemp(prefix="tidemill-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
