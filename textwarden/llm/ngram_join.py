"""Similarity join of documents on word n-gram sets, by grouped prefixes.

If two sets have a Jaccard similarity of at least t, their prefixes of
``n - ceil(t * n) + 1`` members share a member, whatever one order of all
members the prefixes are taken in. The order here puts the members that many
documents hold last, the most frequent at the very end, and goes by hash where
that leaves a choice. Documents with the
same prefix and size are one group, so copies cost one row. Pairs of groups that
share prefix members are counted and filtered: what two prefixes share, and what
at most lies behind them, must reach the overlap that their sizes ask for. A
frequent member comes into a prefix only where nearly all of a set is frequent,
as in large groups of near copies; there groups are chained in order of size
instead of paired. What is left makes blocks, within which the members of the
groups are expanded and verified on their whole sets.

A block of many documents is cut into parts, and each pair of parts is verified
as a task of its own. Verification works towards components: it stops when the
documents not yet compared with all others are in one component, so a group of
thousands of near copies costs few comparisons and loses no link between
components.

Defined cases: a null or blank text has the empty set, which is linked with
nothing; a text of fewer words than ``n`` has its whole word sequence as the one
member; copies and repeated rows are in one component; rows without a doc_id
take part like all others and take the smallest doc_id that they reach, or null;
rows of one doc_id with different texts count as one node; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.components import connected_components
from textwarden.llm.scratch import Scratch
from textwarden.llm.verify import verified_components
from textwarden.llm.wordhash import mix, ngram_sets

#: The most members that the order puts last as frequent ones, which bounds what is broadcast (18 MB).
MOST_FREQUENT = 2_000_000
#: Documents that hold a member before it counts as frequent, at least; a power of two.
LEAST_FREQUENT = 16
#: Bytes of members that a task holds before it hands them on.
FLUSH_BYTES = 10_000_000

U64 = np.uint64


def prefix_length(size: int, percent: int) -> int:
    return size + (-size * percent) // 100 + 1


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of ``values`` by bucket."""
    bucket = (mix(values) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for index in np.split(order, cuts):
        if len(index):
            yield int(bucket[index[0]]), index


def _counting(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = [(b, values[i].tobytes(), np.minimum(counts[i], 255).astype(np.uint8).tobytes()) for b, i in _by_bucket(values, buckets)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "members", "counts"])

        for batch in batches:
            for s in ngram_sets(batch.column(0), n):
                if len(s):
                    held.append(s)
                    size += s.nbytes
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    members = np.concatenate([np.frombuffer(x, U64) for x in table.column("members").to_pylist()])
    # A task counts to 255; the order needs no more than about how frequent a member is.
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
    values, where = np.unique(members, return_inverse=True)
    total = np.bincount(where, weights=counts).astype(np.int64)
    keep = total >= LEAST_FREQUENT
    return pa.table({"member": pa.array(values[keep].astype(np.int64)), "n_docs": pa.array(total[keep])})


def frequent_members(documents: DataFrame, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The members that most documents hold, at most MOST_FREQUENT, counted over all documents, and the logarithms of their counts."""
    buckets = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = documents.select("text").mapInArrow(_counting(n, buckets), "bucket int, members binary, counts binary")
    counted = scratch.keep(packed.groupBy("bucket").applyInArrow(_count_bucket, "member long, n_docs long"))
    levels = counted.groupBy(F.floor(F.log2("n_docs")).alias("level")).count().collect()
    least, total = 63, 0
    for level, count in sorted(((r["level"], r["count"]) for r in levels), reverse=True):
        total += count
        if total > MOST_FREQUENT:
            break
        least = level
    chosen = counted.where(F.floor(F.log2("n_docs")) >= least).select("member", F.floor(F.log2("n_docs")).cast("byte").alias("level")).toArrow()
    members, level = chosen.column(0).to_numpy().astype(U64), chosen.column(1).to_numpy()
    order = np.argsort(members)
    return members[order], level[order]


FEATURES = "doc_id long, row_key long, n int, fp1 long, fp2 long, gid long, bucket int, members binary, gids binary, sizes binary, lates binary"


def _features(n: int, percent: int, buckets: int, frequent):
    """A row for each document, and packed rows of (member, group, size, frequent members of its prefix) by bucket.

    Frequent members are in buckets of their own, from ``buckets`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, level = frequent.value
        members, gids, sizes, lates, seen, held = [], [], [], [], set(), 0
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("gid", pa.int64()), ("bucket", pa.int32()), ("members", pa.binary()), ("gids", pa.binary()), ("sizes", pa.binary()), ("lates", pa.binary())])

        def flush() -> pa.RecordBatch:
            lengths = [len(x) for x in members]
            m, g = np.concatenate(members), np.repeat(np.array(gids, np.int64), lengths)
            n_all, n_late = np.repeat(np.array(sizes, np.uint32), lengths), np.repeat(np.array(lates, np.uint32), lengths)
            is_late = _in_sorted(m, late)
            rows = []
            for shift, index in ((0, np.flatnonzero(~is_late)), (buckets, np.flatnonzero(is_late))):
                for b, i in _by_bucket(m[index], buckets):
                    rows.append((b + shift, *(x[index[i]].tobytes() for x in (m, g, n_all, n_late))))
            for x in (members, gids, sizes, lates, seen):
                x.clear()
            empty = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(empty, t) for t in schema.types[:6]] + [pa.array([r[j] for r in rows], schema.types[6 + j]) for j in range(5)], schema=schema)

        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for s in ngram_sets(batch.column(2), n):
                    if not len(s):
                        rows.append((0, 0, 0, 0))
                        continue
                    is_late = _in_sorted(s, late)
                    last = s[is_late]
                    last = last[np.argsort(level[np.searchsorted(late, last)], kind="stable")]
                    prefix = np.concatenate([s[~is_late], last])[: prefix_length(len(s), percent)]
                    gid = int((mix(mix(prefix).sum(keepdims=True) + U64(len(s)))[0]).astype(np.int64))
                    rows.append((len(s), int(mix(s).sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ U64(0x5851F42D4C957F2D))).astype(np.int64)), gid))
                    if gid not in seen:
                        seen.add(gid)
                        members.append(prefix)
                        gids.append(gid)
                        sizes.append(len(s))
                        lates.append(max(0, len(prefix) - np.count_nonzero(~is_late)))
                        held += 24 * len(prefix)
            empty = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array([r[j] for r in rows], schema.types[2 + j]) for j in range(4)] + [pa.array(empty, t) for t in schema.types[6:]], schema=schema)
            if held > FLUSH_BYTES:
                yield flush()
                held = 0
        if members:
            yield flush()

    return run


def _pairs(percent: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Pairs of groups that share a member: how many, and how many in all they need to share in their prefixes.

        Of a frequent member only pairs that follow each other by size, which need nothing more.
        """
        members, gids, sizes, lates = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("members", U64), ("gids", np.int64), ("sizes", np.uint32), ("lates", np.uint32)))
        order = np.lexsort((gids, sizes, members))
        members, gids, sizes, lates = members[order], gids[order], sizes[order].astype(np.int64), lates[order].astype(np.int64)
        chained = key[0].as_py() >= buckets
        found = []
        for step in range(1, len(members)):
            same = members[step:] == members[:-step]
            if not same.any():
                break
            at = np.flatnonzero(same & (gids[step:] != gids[:-step]) & (100 * sizes[:-step] >= percent * sizes[step:]))
            small, large = sizes[at], sizes[at + step]
            behind = np.maximum(-(-percent * small // 100), -(-percent * large // 100)) - 1
            need = -(-percent * (small + large) // (100 + percent)) - behind - np.minimum(lates[at], lates[at + step])
            a, b = gids[at], gids[at + step]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.zeros(len(at), np.int64) if chained else need], axis=1))
            if chained:
                break
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        pairs, shared = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0))
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "shared": pa.array(shared.astype(np.int64)), "need": pa.array(pairs[:, 2])})

    return run


def ngram_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, row_key`` (a hash of the text).

    Two documents are linked if 100 times the shared n-grams are at least
    ``percent`` times all n-grams of both; ``component_id`` is the smallest
    doc_id that links reach.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "ngram-join")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    frequent = spark.sparkContext.broadcast(frequent_members(documents, n, scratch))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    features = scratch.keep(documents.mapInArrow(_features(n, percent, buckets, frequent), FEATURES))
    packed = features.where("bucket is not null").select("bucket", "members", "gids", "sizes", "lates")
    counted = packed.groupBy("bucket").applyInArrow(_pairs(percent, buckets), "a long, b long, shared long, need long")
    pairs = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")
    blocks = connected_components(pairs, scratch)

    rows = features.where("bucket is null").select("doc_id", "row_key", "n", "fp1", "fp2", "gid")
    # Sets that only rows without an id have get a node of their own.
    nameless = F.shiftright(F.xxhash64("n", "fp1", "fp2"), 2) + F.lit(1 << 62)
    classes = scratch.keep(rows.where("n > 0").groupBy("n", "fp1", "fp2", "gid").agg(F.min("doc_id").alias("class_id"), F.min("row_key").alias("row_key")).withColumn("key", F.coalesce("class_id", nameless)))
    in_block = classes.join(blocks, F.col("gid") == F.col("node"), "left").withColumn("block", F.coalesce("component", "gid"))
    candidates = in_block.select("block", "key", F.col("fp1").alias("print"), F.col("n").alias("weight"))
    named = documents.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")
    others = documents.where("doc_id is null").groupBy("row_key").agg(F.first("text").alias("text")).join(classes.where("class_id is null").select("row_key", "key"), "row_key").select("key", "text")
    reached = verified_components(candidates, named.union(others), n, percent, scratch)
    of_class = classes.join(reached, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    # Components that hold such a node are named by the least doc_id among their sets.
    bridged = of_class.where("class_id is null").select("component").distinct()
    names = of_class.join(bridged, "component").groupBy("component").agg(F.min("class_id").alias("named")).withColumn("renamed", F.lit(True))
    of_class = of_class.join(names, "component", "left").withColumn("component_id", F.when(F.col("renamed"), F.col("named")).otherwise(F.col("component")))
    of_class = of_class.groupBy("n", "fp1", "fp2").agg(F.min("component_id").alias("component_id"))
    return rows.join(of_class, ["n", "fp1", "fp2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key")


def without_near_copies(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component: of the least doc_id, then of the least text by hash.

    Here every pair of id and text is a node of its own, those without an id come
    last, and rows of equal id and text are one. Rows without words are near
    copies of nothing and stay.
    """
    key = F.xxhash64("doc_id", "text")
    found = ngram_components(documents.select(key.alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("__key"), "n_shingles", "component_id").distinct()
    rows = documents.select(key.alias("__key"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), key.alias("key")).alias("at")).join(found.hint("merge"), "__key")
    firsts = rows.where("n_shingles > 0").groupBy("component_id").agg(F.min("at").alias("at")).select("at.key")
    chosen = firsts.union(rows.where("n_shingles = 0").select("at.key")).select(F.col("key").alias("__key")).distinct()
    kept = documents.withColumn("__key", key).join(chosen.hint("merge"), "__key", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return kept.withColumn("__nth", nth).where("__nth = 1").select(*documents.columns)
