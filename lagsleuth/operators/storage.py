"""Shared tables for results that several branches of a plan read again."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The cluster's shared folder; one of our own only in local mode where none is set (tests). A cluster without one is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lagsleuth-")
    return _local[app]


def materialize(df: DataFrame, name: str = "t", *by: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives lost executors, keeps column pruning. A folder for each value of the last columns `by`."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)
