"""Best-fit packing of documents into training sequences, with conflicts.

A sequence (bin) holds ``capacity`` words. A document longer than that fills
sequences of its own with whole stretches, and its rest is packed as a piece
like any other. Two pieces of one duplicate cluster never share a bin, and a
bin takes at most ``per_source`` pieces of one source.

Pieces are dealt by a hash of their documents over shards, so a hot source or
a group of copies is spread over all of them; rows that are repeated whole are numbered in
the tasks that read them and dealt by that number too. A shard is packed in order of
falling size, those of a source and of a cluster one after the other: bins are kept by the words they have left, each with a bitmap of
the sources that are full in it and one of the clusters it holds, and the search
goes from the tightest bin that a piece fits in to ever wider ones, until one
has no conflict; only then is a new bin opened.

A piece carries its own stretch of the text, so sequences are the pieces of a bin
in the order of ``place``. The stretches of a text, one behind the other, give it
back but for white space at its end.

Defined cases: a null or blank text has no words and is not packed; repeated
rows and ids are rows of their own, and are copies of each other; without a
cluster column, equal texts are a cluster; null sources are one source; an
empty table gives no bins; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch
from textwarden.llm.wordhash import pieces as row_pieces
from textwarden.llm.wordhash import text_bytes, words

#: Words in a sequence, pieces of one source in it at most, words of a shard on average.
CAPACITY, PER_SOURCE, SHARD_WORDS = 2048, 8, 500_000
#: Pieces of a shard on average, where pieces are very short.
SHARD_PIECES = 20_000
#: Rows that a task remembers, to number repeated ones.
MOST_SEEN = 200_000

PACKED = "bin_id long, place int, doc_id long, start_word long, n_words int, source string, cluster string, text string"
PIECES = "doc_id long, source string, cluster string, order long, dealt long, copy long, start_word long, n_words int, text string"


def _cut(capacity: int):
    """Documents (``doc_id, source, cluster, text, order``) cut into stretches of ``capacity`` words and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            # Repeated rows are numbered within a task, so that they go to different shards.
            copies = []
            for dealt in batch.column("dealt").to_pylist():
                copies.append(seen.get(dealt, 0))
                seen[dealt] = copies[-1] + 1
            if len(seen) > MOST_SEEN:
                seen.clear()
            copy = pa.array(copies, pa.int64())
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_pieces(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends = words(part, at)
                first = np.searchsorted(starts, at)
                n_words = np.diff(first)
                n = -(-n_words // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start_word = nth * capacity
                taken = np.minimum(capacity, n_words[row] - start_word)
                last = start_word + taken == n_words[row]
                # White space goes with the word after it.
                begin = np.where(nth == 0, at[row], ends[first[row] + start_word - 1])
                end = np.where((nth == 0) & last, at[row + 1], ends[first[row] + start_word + taken - 1])
                texts = [part[x:y].tobytes().decode() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                index = pa.array(lo + row)
                values = [batch.column(c).take(index) for c in ("doc_id", "source", "cluster", "order", "dealt")] + [copy.take(index), pa.array(start_word, pa.int64()), pa.array(taken, pa.int32()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in PIECES.split(", ")])

    return run


class Bins:
    """Bins of one shard by the words they have left.

    While pieces of one source, or of one cluster, come one after the other, bins that can take no
    more of them are set aside, so each is met once a run and not once a piece.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.occupied = 0  # bit r: some bin that is not set aside has r words left
        self.left: list[int] = []
        self.full_sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []  # bitmaps
        self.counts: list[dict[int, int]] = []
        self.source = self.cluster = -1
        self.full: list[int] = []  # set aside while the source stays the same
        self.holding: list[int] = []  # set aside while the cluster stays the same

    def _put(self, b: int) -> None:
        r = self.left[b]
        if r:
            # Of bins with the same room the first opened is tried first.
            heapq.heappush(self.by_left[r], b)
            self.occupied |= 1 << r

    def _sort_in(self, b: int, source: int, cluster: int) -> bool:
        """Set a bin aside if it conflicts; whether it did."""
        if self.full_sources[b] & source:
            self.full.append(b)
        elif self.clusters[b] & cluster:
            self.holding.append(b)
        else:
            return False
        return True

    def _run(self, source: int, cluster: int) -> None:
        if (source, cluster) == (self.source, self.cluster):
            return
        back, self.holding = self.holding, []
        if source != self.source:
            back, self.full = back + self.full, []
        for b in back:
            self._put(b)
        self.source, self.cluster = source, cluster

    def add(self, size: int, source: int, cluster: int) -> int:
        """The bin that the piece goes to: the tightest without a conflict, or a new one. ``source`` and ``cluster`` are bits."""
        self._run(source, cluster)
        chosen = -1
        rest = self.occupied >> size
        while rest and chosen < 0:
            low = rest & -rest
            r = low.bit_length() - 1 + size
            rest ^= low
            level = self.by_left[r]
            while level and chosen < 0:
                b = heapq.heappop(level)
                if not self._sort_in(b, source, cluster):
                    chosen = b
            if not level:
                self.occupied &= ~(1 << r)
        if chosen < 0:
            chosen = len(self.left)
            self.left.append(self.capacity)
            self.full_sources.append(0)
            self.clusters.append(0)
            self.counts.append({})
        self.left[chosen] -= size
        self.clusters[chosen] |= cluster
        n = self.counts[chosen][source] = self.counts[chosen].get(source, 0) + 1
        if n >= self.per_source:
            self.full_sources[chosen] |= source
        if not self._sort_in(chosen, source, cluster):
            self._put(chosen)
        return chosen


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs more than once, none (0) for the others."""
    codes, _ = pd.factorize(values, use_na_sentinel=False)
    often = np.bincount(codes, minlength=1) > 1
    place = np.cumsum(often) - 1
    return [1 << int(place[c]) if often[c] else 0 for c in codes]


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Bins of the pieces of one shard, in the order of packing (falling size, then ``order``); bins are numbered from 0."""
    pieces = pieces.sort_values(["n_words", "order", "start_word"], ascending=[False, True, True], kind="stable")
    bins = Bins(capacity, per_source)
    rows = zip(pieces["n_words"].tolist(), _bits(pieces["source"]), _bits(pieces["cluster"]), strict=True)
    return pieces.assign(bin_id=np.array([bins.add(*row) for row in rows], np.int64))


def _order() -> Column:
    """Among pieces of one size, those of a source stand together, and in it those of a cluster, by hashes."""
    part = lambda bits, at, *columns: F.shiftleft(F.xxhash64(*columns).bitwiseAND((1 << bits) - 1), at)
    return part(15, 48, "source").bitwiseOR(part(24, 24, "cluster")).bitwiseOR(part(24, 0, "doc_id"))


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    cluster: str | None = None,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row a piece: ``bin_id, place, doc_id, start_word, n_words, source, cluster, text``."""
    scratch = Scratch(documents.sparkSession, "packing")
    copies = F.md5("text") if cluster is None else F.coalesce(F.col(cluster).cast("string"), F.md5("text"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), copies.alias("cluster"), "text")
    pieces = scratch.keep(rows.withColumns({"order": _order(), "dealt": F.xxhash64("doc_id", "cluster")}).mapInArrow(_cut(capacity), PIECES))
    total, n_pieces = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // shard_words), -(-n_pieces // SHARD_PIECES))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(frame, capacity, per_source)
        out["place"] = out.groupby("bin_id").cumcount().astype(np.int32)
        out["bin_id"] += int(key[0]) << 32
        return out[["bin_id", "place", "doc_id", "start_word", "n_words", "source", "cluster", "text"]]

    dealt = F.when(F.col("copy") == 0, F.col("dealt")).otherwise(F.xxhash64("dealt", "copy"))
    return pieces.withColumn("shard", F.pmod(dealt, F.lit(shards))).groupBy("shard").applyInPandas(run, PACKED)
