"""Events inspected in their own rows: findings, direction, mode and action, without a shuffle or state.

The same functions work on a table and on a stream. Texts alone cross to Python; hits come
back as an array beside the row, and overlaps, counts and decisions are expressions over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig
from textwarden.functions.normalization import find_all
from textwarden.operators import policy
from textwarden.operators.scan import PIECE_CHARS, cut_text, may_hold
from textwarden.operators.spans import merge_in_row

HIT = "struct<entity:string,start:int,end:int,score:double,label:string>"
_HIT = pa.struct([("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("label", pa.string())])


def hits_in_row(text: Column, config: ScanConfig | None = None) -> Column:
    """All hits of the detectors in a text, as an array; null where no detector can find anything.

    A long text is read in the same pieces as elsewhere, by one task: an event is not split.
    """
    config = config or ScanConfig()

    def found(text: str) -> list[dict]:
        pieces = cut_text(text) if len(text) > PIECE_CHARS else [(0, text)]
        return [{"entity": e, "start": at + a, "end": at + b, "score": score, "label": label} for at, piece in pieces for e, a, b, score, label in find_all(piece, config)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else found(t) for t in batch.to_pylist()], pa.list_(_HIT))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"array<{HIT}>")(F.when(may_hold(text, config), text))


def counts_by_entity(findings: Column) -> Column:
    """Map of type to count, types in their order."""
    names = F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["entity"])))
    return F.map_from_entries(F.transform(names, lambda name: F.struct(name.alias("key"), F.size(F.filter(findings, lambda f: f["entity"] == name)).alias("value"))))


def inspect(events: DataFrame, text: str, tools: DataFrame | None = None, modes: dict[str, str] | None = None, config: ScanConfig | None = None) -> DataFrame:
    """``events`` (with ``event, tool_name, can_rewrite`` and a text) with ``findings, entities, direction, mode, action, in_bytes``.

    ``findings`` are resolved as ``scan`` resolves them. Without a finding the action is to
    allow. Null texts have no findings. Other columns stay; the text does too.
    """
    spark = events.sparkSession
    tools = spark.createDataFrame(list(policy.TOOLS), "tool string, direction string") if tools is None else tools
    none = F.expr("cast(array() as array<struct<entity:string,start:int,end:int,score:double,label:string,value_start:int,value_end:int>>)")
    hit = events.withColumn("_hits", hits_in_row(F.col(text), config))
    found = hit.withColumn("findings", F.when(F.size("_hits") > 0, merge_in_row(F.col("_hits"))).otherwise(none)).drop("_hits")
    directed = policy.direction_of(found.withColumn("entities", counts_by_entity(F.col("findings"))), F.broadcast(tools))
    directed = directed.withColumn("mode", policy.mode_of(F.col("direction"), F.col("tool_name"), F.col("event"), modes or {}))
    decided = F.when(F.size("findings") > 0, policy.action_of(F.col("direction"), F.col("mode"), F.col("can_rewrite"))).otherwise("allow")
    return directed.withColumns({"action": decided, "in_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")}).select(
        *events.columns, "findings", "entities", "direction", "mode", "action", "in_bytes"
    )
