"""Readers of the tables that the queries run over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder ``sf_dir``; nothing is cached or cut."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core below which an input is dealt over all cores first.
SMALL_BYTES = 16_000_000


def over_cores(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows`` of a small ``source``, which may come in fewer partitions than there are cores, dealt over all cores; of a large one as they come."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    small = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES * cores
    return rows.repartition(cores) if small else rows


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that the whole cluster shares, ``spark.checkpoint.dir``; one of our own only in a local session."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named:
        if not (conf.get("spark.master") or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    return f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
