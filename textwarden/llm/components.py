"""Connected components of an edge table, with stars around the smallest node of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch


#: Edges that one task brings to components by itself; larger tables take rounds of star steps first.
MOST_EDGES = 1_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges that are not the smallest of their component, and that smallest node."""
    names, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = index[: len(u)], index[len(u) :], np.arange(len(names))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up
    led = label != np.arange(len(names))
    return names[led], names[label[led]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by edges to the smallest node they connect to."""
    none = np.zeros(0, np.int64)
    u, v, held, size = none, none, [], 0
    for batch in batches:
        batch = batch.drop_null()
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size > MOST_EDGES + len(u):
            u, v = _roots(*(np.concatenate(c) for c in zip((u, v), *held, strict=True)))
            held, size = [], 0
    u, v = _roots(*(np.concatenate(c) for c in zip((u, v), *held, strict=True)))
    for i in range(0, len(u), 50_000):
        yield pa.RecordBatch.from_pydict({"u": pa.array(u[i : i + 50_000], pa.int64()), "v": pa.array(v[i : i + 50_000], pa.int64())})


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of ``edges`` (its first two columns, longs).

    ``component`` is the smallest node that can be reached. Partitions are first
    reduced to forests of their own, fewer of them while that helps; then large-star and small-star steps take
    turns until nothing changes, a logarithmic number of rounds, or no more than
    MOST_EDGES edges are left, which one task finishes. Nulls and self-loops are
    left out; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    stars = scratch.keep(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).mapInArrow(_forest, "u long, v long").distinct())
    signature = contracted = None
    while True:
        found = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(found) == signature or not found[0]:
            break
        signature = tuple(found)
        if found[0] <= MOST_EDGES:
            stars = scratch.keep(stars.coalesce(1).mapInArrow(_forest, "u long, v long"))
            break
        if contracted is None or 2 * found[0] <= contracted:
            # As long as that takes half of them away: forests of fewer and fuller partitions.
            signature, contracted = None, found[0]
            stars = scratch.keep(stars.coalesce(-(-found[0] // MOST_EDGES)).mapInArrow(_forest, "u long, v long").distinct())
            continue
        # Large star: every larger neighbour of a node goes to the smallest node around it.
        both = stars.select("u", "v").union(stars.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        stars = scratch.keep(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
