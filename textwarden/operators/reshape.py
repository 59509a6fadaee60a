"""Make texts of a table shorter before a model reads them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions import reshaping


def line_rstrip(text: Column) -> Column:
    """Spaces and tabs at the ends of lines taken off."""
    return F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")


def shrink(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys, text, applied``: texts after JSON, HTML and whitespace steps that made them shorter.

    Texts that no step could change stay on the JVM's side.
    """
    may_change = (F.length(text) >= reshaping.LEAST_CHARS) & (F.col(text).rlike(r"^\s*[\[{]|[ \t](?:\n|\z)") | F.lower(F.substring(F.ltrim(text), 1, 9)).rlike("^(?:<!doctype|<html|<[?]xml)"))
    gate = F.coalesce(may_change, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [reshaping.shrink(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + [pa.array([t for t, _ in done], pa.string()), pa.array([a for _, a in done], pa.list_(pa.string()))], names=[*keys, text, "applied"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] + [f"{text} string", "applied array<string>"])
    changed = df.where(gate).select(*keys, text).mapInArrow(run, schema)
    return changed.unionByName(df.where(~gate).select(*keys, text, F.expr("cast(array() as array<string>)").alias("applied")))


def html_text(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """``keys, text``: pages as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else reshaping.html_to_text(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + [pa.array(texts, pa.string())], names=[*keys, "text"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] + ["text string"])
    return df.select(*keys, html).mapInArrow(run, schema)
