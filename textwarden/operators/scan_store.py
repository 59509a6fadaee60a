"""Texts scanned once over runs: findings are kept by the digest of their text, and a run scans only digests that are new.

A store is two Parquet tables in one folder, both by ``config`` (a fingerprint of the
detectors' configuration) and ``run``: ``findings``, and ``scanned`` with each digest and how
many findings its text has. A run writes its findings first and its digests last, so
findings of a run that broke off belong to no digest and count for nothing; the next run
scans these texts again. Runs must not write at the same time.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig
from textwarden.operators import scan

SCANNED = "digest string, n_findings long, config string, run string"
FINDINGS = "digest string, entity string, start int, end int, score double, label string, value_start int, value_end int, config string, run string"


def fingerprint(config: ScanConfig | None) -> str:
    """What tells configurations apart: findings of one are not those of another."""
    return hashlib.sha256(repr(config or ScanConfig()).encode()).hexdigest()[:16]


class FindingStore:
    """Findings of earlier runs in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self, config: ScanConfig | None = None) -> DataFrame:
        """``digest, n_findings, run`` of all texts scanned with a configuration."""
        return self._read("scanned", SCANNED).where(F.col("config") == fingerprint(config)).select("digest", "n_findings", "run")

    def findings(self, config: ScanConfig | None = None) -> DataFrame:
        """Findings of texts of runs that came to their end."""
        rows = self._read("findings", FINDINGS).where(F.col("config") == fingerprint(config)).drop("config")
        return rows.join(self.scanned(config).where("n_findings > 0").select("digest", "run"), ["digest", "run"]).drop("run")

    def add(self, df: DataFrame, text: str, config: ScanConfig | None = None) -> str:
        """Scan the texts that are new and keep what was found; the name of the run."""
        run = uuid.uuid4().hex
        texts = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("digest", F.sha2("text", 256))
        known = self.scanned(config).select("digest")
        # Digests go first: only texts of new ones are moved, one for each.
        new = texts.join(known, "digest", "left_anti").dropDuplicates(["digest"])
        mark = {"config": F.lit(fingerprint(config)), "run": F.lit(run)}
        found = scan.scan(new, "text", ["digest"], config)
        found.withColumns(mark).write.mode("append").partitionBy("config", "run").parquet(f"{self.path}/findings")
        counts = self._read("findings", FINDINGS).where((F.col("config") == fingerprint(config)) & (F.col("run") == run)).groupBy("digest").agg(F.count("*").alias("n_findings"))
        done = new.select("digest").join(counts, "digest", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)).cast("long"))
        done.withColumns(mark).write.mode("append").partitionBy("config", "run").parquet(f"{self.path}/scanned")
        return run

    def scan(self, df: DataFrame, text: str, keys: list[str], config: ScanConfig | None = None) -> DataFrame:
        """As ``operators.scan.scan``; only texts that no earlier run has scanned are read by the detectors."""
        self.add(df, text, config)
        digests = df.select(*keys, F.sha2(F.col(text), 256).alias("_digest"))
        return digests.join(self.findings(config).withColumnRenamed("digest", "_digest"), "_digest").drop("_digest")
