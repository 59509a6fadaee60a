"""Embedding columns as they come, reduced to what vector operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(embedding: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & good, F.lit(False))


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles), one row an id.

    Rows without an id or with a vector that is null, empty or not finite are
    left out; of rows with one id the least vector counts.
    """
    return embeddings.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))


def lengths(vectors: DataFrame) -> list[int]:
    """The lengths of ``embedding`` that occur, in order."""
    return sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect())
