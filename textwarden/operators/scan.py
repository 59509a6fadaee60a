"""Scan texts for secrets and personal data: one row a finding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig, bare_numbers
from textwarden.functions.normalization import find_all
from textwarden.operators.spans import dedupe_spans, merge_spans
from textwarden.operators.sweep import touching_none
from textwarden.sources.tables import over_cores, scratch_path

#: Longer texts are cut into pieces, at a line's end or else with an overlap.
PIECE_CHARS, OVERLAP = 100_000, 4_096
#: Digests of texts that a task remembers.
MOST_SEEN = 200_000

HITS = "key string, entity string, start int, end int, score double, label string"


#: One of these is in any text that a detector finds something in: anything but plain letters, space and the commonest
#: marks, which nearly all texts have near their start, or else runs of letters that tokens, encoded values and hardware addresses need.
HOLDS = r"""[^A-Za-z\s.,;?'"]|[A-Za-z]{16}|eyJ|[A-Fa-f]{4}\.[A-Fa-f]{4}\."""


def may_hold(text: Column, config: ScanConfig | None = None) -> Column:
    """A cheap test on the JVM's side: texts without these never cross to Python; patterns of the user may hold anything."""
    return text.isNotNull() if config and config.custom else text.rlike(HOLDS)


def cut_text(text: str) -> Iterator[tuple[int, str]]:
    """``(offset, piece)`` of a text."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = text.rfind("\n", at + 1, at + PIECE_CHARS)
        if end > at:
            yield at, text[at : end + 1]
            at = end + 1
        else:
            yield at, text[at : at + PIECE_CHARS]
            at += PIECE_CHARS - OVERLAP
    yield at, text[at:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, offsets, pieces = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for at, piece in cut_text(text):
                keys.append(key)
                offsets.append(at)
                pieces.append(piece)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(offsets, pa.int32()), pa.array(pieces, pa.string())], names=["key", "at", "piece"])


#: The entity of a row that says that a piece could not be read to its end.
FAILED = "_FAILED"


def _find(config: ScanConfig, find=find_all, keep_failures: bool = False):
    def of_piece(key: str, at: int, piece: str) -> list[tuple]:
        try:
            return [(key, e, at + a, at + b, score, label) for e, a, b, score, label in find(piece, config)]
        except Exception:
            if not keep_failures:
                raise
            return [(key, FAILED, at, at + len(piece), 0.0, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            rows = []
            for key, at, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # Copies of a text within a task are not scanned again: findings are joined back by digest.
                if (key, at) not in seen:
                    seen.add((key, at))
                    rows += of_piece(key, at, piece)
            if len(seen) > MOST_SEEN:
                seen.clear()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in HITS.split(", ")])

    return run


def _hits(df: DataFrame, text: str, keys: list[str], gate: Column, find_in) -> tuple[DataFrame, DataFrame]:
    """Rows with a text to scan, as ``keys, _digest``, and the hits by digest."""
    rows = over_cores(df.select(*keys, F.col(text).alias("_text")), df)
    gated = rows.where(gate).select(*keys, F.sha2("_text", 256).alias("_digest"), "_text")
    texts = gated.select("_digest", F.col("_text").alias("text"))
    short = texts.where(F.length("text") <= PIECE_CHARS).select(F.col("_digest").alias("key"), F.lit(0).alias("at"), "text")
    long_ = texts.where(F.length("text") > PIECE_CHARS).groupBy("_digest").agg(F.first("text").alias("text")).mapInArrow(_cut, "key string, at int, piece string")
    return gated.select(*keys, "_digest"), short.union(long_.repartition("key", "at")).mapInArrow(find_in, HITS)


def scan(df: DataFrame, text: str, keys: list[str], config: ScanConfig | None = None) -> DataFrame:
    """``keys, entity, start, end, score, label, value_start, value_end`` of all resolved findings.

    Texts are scanned where they are read, copies within a task once, and only
    findings are shuffled: they are resolved by digest and joined back. Long texts
    are cut into pieces that are dealt over tasks. Null texts have no findings.
    """
    config = config or ScanConfig()
    gated, hits = _hits(df, text, keys, may_hold(F.col("_text"), config), _find(config))
    resolved = merge_spans(dedupe_spans(hits, ["key"]), ["key"]).withColumnRenamed("key", "_key")
    return gated.join(resolved, F.col("_digest") == F.col("_key")).drop("_digest", "_key")


def scan_checked(df: DataFrame, text: str, keys: list[str], config: ScanConfig | None = None, find=find_all) -> tuple[DataFrame, DataFrame]:
    """The findings as ``scan`` gives them, and ``keys, n_failed, partial`` of every row.

    A piece that the detector ``find(piece, config)`` fails on does not fail the scan: what the other pieces of
    its text hold is reported, and the row is partial. Texts are read once for both results.
    """
    config = config or ScanConfig()
    # Another detector may find something in any text.
    gate = may_hold(F.col("_text"), config) if find is find_all else F.col("_text").isNotNull()
    gated, hits = _hits(df, text, keys, gate, _find(config, find, keep_failures=True))
    path = scratch_path(df.sparkSession, "scan")
    hits.write.parquet(path)
    kept = df.sparkSession.read.schema(hits.schema).parquet(path)
    resolved = merge_spans(dedupe_spans(kept.where(F.col("entity") != FAILED), ["key"]), ["key"]).withColumnRenamed("key", "_key")
    failed = kept.where(F.col("entity") == FAILED).select("key", "start").distinct().groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n_failed"))
    status = df.select(*keys, F.sha2(F.col(text), 256).alias("_digest")).join(failed, F.col("_digest") == F.col("_key"), "left")
    status = status.select(*keys, F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.col("n_failed").isNotNull().alias("partial"))
    return gated.join(resolved, F.col("_digest") == F.col("_key")).drop("_digest", "_key"), status


def count_by_entity(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by, "entity").agg(F.count("*").alias("n"))


def unclaimed_numbers(df: DataFrame, text: str, keys: list[str], findings: DataFrame) -> DataFrame:
    """Bare numbers that no finding overlaps, counted by key."""

    def run(batches):
        for batch in batches:
            rows = [(i, a, b) for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()) for a, b in bare_numbers(t or "")]
            taken = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(j).take(taken) for j in range(len(keys))] + [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=[*keys, "n_start", "n_end"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] + ["n_start int", "n_end int"])
    numbers = df.where(F.col(text).rlike("[0-9]{9}")).select(*keys, text).mapInArrow(run, schema)
    return touching_none(numbers, findings, keys, "n_start", "n_end", "start", "end").groupBy(*keys).agg(F.count("*").alias("bare_numbers"))
