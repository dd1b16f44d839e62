"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_part: ContextVar[str] = ContextVar("part", default="")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process (tests) a temporary folder of this session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are removed at the end; results must be written or collected before it."""
    token = _part.set(f"scratch-{uuid.uuid4().hex}/")
    at = f"{shared_dir(spark)}/graphloom/{_part.get()}"
    try:
        yield
    finally:
        _part.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spool(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives lost executors, and gives Catalyst a true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{_part.get()}{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
