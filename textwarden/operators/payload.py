"""JSON payloads as rows of leaves, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MOST_DEPTH, MOST_LEAVES, MOST_CHARS = 64, 50_000, 1_000_000


def leaves(value: Any, path: tuple = (), depth: int = 0) -> Iterator[tuple[tuple, bool, str]]:
    """``(path, is_key, text)`` of keys, strings and numbers, in order; a depth beyond the limit raises."""
    if depth > MOST_DEPTH:
        raise RecursionError
    if isinstance(value, dict):
        for k, v in value.items():
            yield (*path, k), True, k
            yield from leaves(v, (*path, k), depth + 1)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, (*path, str(i)), depth + 1)
    elif isinstance(value, str):
        yield path, False, value
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield path, False, str(int(value)) if float(value).is_integer() else repr(value)


def walk_payload(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """``keys, leaf_no, path, is_key, text, partial``: the leaves of each payload.

    A payload that is not JSON, too deep, or has more leaves or characters than
    the limits gives what came before, and ``partial`` on all its rows; if there is
    nothing, one row without a leaf.
    """

    def one(text: str | None) -> tuple[list[tuple[tuple, bool, str]], bool]:
        found, chars = [], 0
        if text is None:
            return found, False
        try:
            for leaf in leaves(json.loads(text)):
                chars += len(leaf[2])
                if len(found) >= MOST_LEAVES or chars > MOST_CHARS:
                    return found, True
                found.append(leaf)
        except (ValueError, RecursionError):
            return found, True
        return found, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                found, partial = one(text)
                for no, (path, is_key, value) in enumerate(found or ([((), None, None)] if partial else [])):
                    at.append(i)
                    rows.append((no, list(path), is_key, value, partial))
            taken = pa.array(at, pa.int64())
            kinds = (pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in range(len(keys))] + [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[*keys, "leaf_no", "path", "is_key", "text", "partial"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] + ["leaf_no int", "path array<string>", "is_key boolean", "text string", "partial boolean"])
    return df.select(*keys, payload).mapInArrow(run, schema)


def replaced(value: Any, changes: dict[tuple, str], path: tuple = ()) -> Any:
    """A value with some leaves (by path) as other text; two keys that become one are an error."""
    if isinstance(value, dict):
        out: dict = {}
        for k, v in value.items():
            key = changes.get(("#", *path, k), k)
            if key in out:
                raise ValueError(f"two keys become {key!r}")
            out[key] = replaced(v, changes, (*path, k))
        return out
    if isinstance(value, list):
        return [replaced(v, changes, (*path, str(i))) for i, v in enumerate(value)]
    return changes.get(path, value)


def replace_leaves(df: DataFrame, payload: str, changes: DataFrame, keys: list[str], errors: str | None = None) -> DataFrame:
    """``df`` with payloads in which the leaves of ``changes`` (``keys, path, text``) are other text, as compact JSON.

    A path that starts with ``#`` renames a key. Payloads without changes stay as they are. One
    that has changes but is not JSON, or in which two keys would become one, is withheld (null), never
    passed on unchanged; the column ``errors`` says why, if asked for.
    """
    columns = df.columns
    pairs = changes.groupBy(*keys).agg(F.collect_list(F.struct("path", "text")).alias("_changes"))

    def one(text: str | None, given: list[dict] | None) -> tuple[str | None, str | None]:
        if text is None or not given:
            return text, None
        try:
            return json.dumps(replaced(json.loads(text), {tuple(c["path"]): c["text"] for c in given}), ensure_ascii=False, separators=(",", ":")), None
        except (ValueError, RecursionError) as why:
            return None, str(why)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(t, c) for t, c in zip(batch.column(payload).to_pylist(), batch.column("_changes").to_pylist(), strict=True)]
            values = [pa.array([t for t, _ in done], pa.string()) if c == payload else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*values, pa.array([e for _, e in done], pa.string())], names=[*columns, "_error"])

    schema = StructType([*df.schema.fields, StructField("_error", StringType())])
    out = df.join(pairs, keys, "left").select(*columns, "_changes").mapInArrow(run, schema)
    return out.drop("_error") if errors is None else out.withColumnRenamed("_error", errors)
