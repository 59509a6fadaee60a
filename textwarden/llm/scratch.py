"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, so a lost
executor costs a reread and never a result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; one of our own only where none is set in a local session (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("textwarden.scratch.dir", None)
    if not named:
        if not (spark.sparkContext.getConf().get("spark.master") or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("textwarden.scratch.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables of one run: ``keep`` writes one and reads it again. They stay, since lazy results still read them."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
