"""Transcripts, ledgers, exchanges and configuration files as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions.checks import is_json

#: Retention of a month of the ledger after its end.
KEEP_DAYS = 30
MOST_ENV_BYTES = 1_000_000

RECORD = (
    "session_id string, ts timestamp, client string, event string, tool_name string, target string, direction string, mode string, action string, "
    "entities map<string,int>, in_bytes bigint, out_bytes bigint, fields int, transforms array<string>, markers array<string>, custom map<string,int>, bare_numbers int, note string, latency_ms double"
)
EXCHANGE = "session_id string, seq bigint, started timestamp, ended timestamp, path string, model string, status int, auth_route string, request_bytes bigint, body string, response string, content_type string"


def read_transcripts(spark: SparkSession, path: str, since: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """``session_id, file, is_subagent, line_no, raw``: the lines of ``<project>/<session>.jsonl`` and of their subagents.

    Files are read in splits, so one file is spread over tasks. A line's number is its place in
    its split and the lines of the splits before it, which a first pass counts: one row a split.
    The id comes from the session's file or folder name. Files last changed before
    ``since`` (yyyy-MM-dd) are not opened. A file that changes while it is read is an error.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n")
    if since is not None:
        reader = reader.option("modifiedAfter", f"{since}T00:00:00")
    at = ["_path", "_split"]
    lines = reader.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = lines.join(splits, at, "left")
    counted = F.when(F.col("_before").isNull(), F.raise_error(F.lit("a transcript changed while it was read")).cast("bigint")).otherwise(F.col("_before") + F.col("_id") - F.col("_first"))
    file = F.col("_path")
    name = F.regexp_replace(file, r"^.*?([^/]+/[^/]+/subagents/[^/]+|[^/]+/[^/]+)$", "$1")
    sub = F.contains(file, F.lit("/subagents/"))
    session = F.when(sub, F.regexp_extract(file, r"([^/]+)/subagents/[^/]+$", 1)).otherwise(F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1))
    return numbered.select(session.alias("session_id"), name.alias("file"), sub.alias("is_subagent"), counted.alias("line_no"), "raw")


def write_ledger(records: DataFrame, path: str) -> None:
    """Append records to the folders of their months."""
    records.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def read_ledger(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Records of all months, those from ``since`` (yyyy-MM-dd) on; the month prunes folders. Bad lines are left out."""
    lines = spark.read.schema("value string, month string").text(path)
    good = F.col("value").startswith("{") & is_json(F.col("value"))
    rows = lines.where(good).select(F.from_json("value", RECORD).alias("r"), "month").select("r.*", "month")
    return rows if since is None else rows.where((F.col("month") >= since[:7]) & (F.col("ts") >= F.lit(since).cast("timestamp")))


def kept_months(records: DataFrame, now: str, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Records of months that ended at most ``keep_days`` ago."""
    end = F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1)
    return records.where(F.date_add(end, keep_days) > F.to_date(F.lit(now)))


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Logged requests and responses of model calls."""
    return spark.read.schema(EXCHANGE).json(path).where(F.col("path").rlike(r"(?:messages|responses|completions)$"))


NAME = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(.*)$")


def env_entries(text: str) -> Iterator[tuple[str, str, str | None, int, str | None]]:
    """``(kind, name, value, line, section)`` of a ``.env`` or INI file."""
    section, lines, i = None, text.split("\n"), 0
    while i < len(lines):
        line, number = lines[i].rstrip("\r"), i + 1
        i += 1
        bare = line.strip()
        if not bare or bare[0] in "#;":
            continue
        if bare.startswith("[") and bare.endswith("]"):
            section = bare[1:-1].strip()
            yield "section", section, None, number, section
            continue
        m = NAME.match(line)
        if not m:
            yield "unparsed", "", None, number, section
            continue
        name, value = m.group(1), m.group(2).strip()
        if value[:1] in ("'", '"'):
            quote, rest = value[0], value[1:]
            # A quoted value may go on over lines.
            while quote not in rest and i < len(lines):
                rest += "\n" + lines[i].rstrip("\r")
                i += 1
            value = rest.split(quote)[0]
        else:
            value = re.split(r"\s[#;]", value, maxsplit=1)[0].rstrip()
            if value.startswith("-----BEGIN"):
                while i < len(lines) and "-----END" not in value:
                    value += "\n" + lines[i].rstrip("\r")
                    i += 1
        yield "variable", name, value, number, section


def read_env_files(spark: SparkSession, path: str, glob: str = "*.env") -> DataFrame:
    """``path, kind, name, line, section, state``: entries of files of at most a megabyte of UTF-8; values are not kept.

    ``state``: set, empty, ref (a reference to another variable) or unparsed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).where(F.col("length") <= MOST_ENV_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    text = content.decode("utf-8")
                except UnicodeDecodeError:
                    rows.append((where, "unparsed", "", 0, None, "unparsed"))
                    continue
                for kind, name, value, line, section in env_entries(text):
                    state = "unparsed" if kind == "unparsed" else None if kind == "section" else "empty" if not value else "ref" if re.fullmatch(r"\$\{?\w+\}?", value) else "set"
                    rows.append((where, kind, name, line, section, state))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "kind", "name", "line", "section", "state"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, name string, line int, section string, state string")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    findings.select(F.to_json(F.struct(*findings.columns)).alias("value")).write.mode("append").text(path)
