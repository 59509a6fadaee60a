"""Spans that arrive as rows: duplicates, overlaps, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.detectors import PRIORITY
from textwarden.functions.scans import let, scan
from textwarden.operators.sweep import inside_one


def priority(entity: Column) -> Column:
    """Place of a type among those that overlap; unknown types come last."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(PRIORITY) for x in (name, i)])
    return F.coalesce(F.element_at(ranks, entity), F.lit(len(PRIORITY)))


def dedupe_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of equal ``(entity, start, end)`` the one with the highest score, the label first by name."""
    best = F.min_by(F.struct("score", "label"), F.struct(-F.col("score"), "label"))
    return spans.groupBy(*keys, "entity", "start", "end").agg(best.alias("best")).select(*keys, "entity", "start", "end", "best.score", "best.label")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with ``island``: spans that overlap, directly or through others, have the same; touching is not overlapping."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    return spans.withColumn("_new", starts.cast("int")).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans as one: the extent of all, the identity of the winner.

    The winner has the best priority, then length, type, start, end, score; its
    own span stays as ``value_start, value_end``.
    """
    order = F.struct(priority(F.col("entity")), F.col("start") - F.col("end"), "entity", "start", "end", -F.col("score"), "label")
    winner = F.min_by(F.struct("entity", "score", "label", "start", "end"), order)
    merged = islands(spans, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), winner.alias("w"))
    return merged.select(*keys, "w.entity", "start", "end", "w.score", "w.label", F.col("w.start").alias("value_start"), F.col("w.end").alias("value_end"))


def merge_in_row(hits: Column) -> Column:
    """``merge_spans`` over an array of hits of one text, inside its row: no shuffle, and linear after the sort.

    Hits are structs with ``entity, start, end, score, label``; the result has ``value_start, value_end`` as well, in order of start.
    """
    keyed = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h.alias("hit")))

    def merged(ordered: Column) -> Column:
        reach = scan(F.transform(ordered, lambda x: x["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        new = F.filter(F.zip_with(F.transform(ordered, lambda x, i: F.struct(i.alias("at"), x["start"].alias("start"))), reach, lambda x, r: F.when(x["start"] >= r, x["at"])), lambda at: at.isNotNull())
        return let(new, lambda begins: F.transform(begins, lambda at, k: island(F.slice(ordered, at + 1, F.coalesce(F.get(begins, k + 1), F.size(ordered)) - at))))

    def island(members: Column) -> Column:
        order = lambda h: F.struct(priority(h["entity"]).alias("priority"), (h["start"] - h["end"]).alias("minus_length"), h["entity"].alias("entity"), h["start"].alias("start"), h["end"].alias("end"), (-h["score"]).alias("minus_score"), h["label"].alias("label"), h["score"].alias("score"))
        winner = F.array_min(F.transform(members, lambda x: order(x["hit"])))
        extent = F.struct(F.array_min(F.transform(members, lambda x: x["start"])).alias("start"), F.array_max(F.transform(members, lambda x: x["end"])).alias("end"), winner.alias("w"))
        return let(extent, lambda e: F.struct(e["w"]["entity"].alias("entity"), e["start"].alias("start"), e["end"].alias("end"), e["w"]["score"].alias("score"), e["w"]["label"].alias("label"), e["w"]["start"].alias("value_start"), e["w"]["end"].alias("value_end")))

    return let(F.array_sort(keyed), merged)


def not_contained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that do not lie in an earlier one (by start, the longer first) of their keys."""
    by = Window.partitionBy(*keys).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(by)).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def outside(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that lie in none of ``others`` (a card number inside an account number, say)."""
    return inside_one(spans, others, keys, "start", "end", "start", "end", inside=False)
