"""Exact substring dedup: maximal repeats of at least MIN_BYTES bytes, from enhanced suffix arrays.

A corpus can't be sorted by suffix in one place, so the windows of MIN_BYTES
bytes are dealt over tasks by their content: each goes with the least hash among
the GRAM-byte grams it holds, its anchor. All windows around an anchor make one
stretch of text; equal windows have equal anchors in equal places, whatever
documents they are in. Stretches whose anchor no other has are dropped, equal
stretches are counted once, and the texts of what is left meet in tasks by anchor.

A task sorts the suffixes of its stretches that may start a maximal repeat: those
whose first MIN_BYTES bytes occur again, with differing bytes before them. With
the lengths of common prefixes of neighbours, a stack scan gives the intervals
of suffixes with a common prefix; an interval is a maximal repeat if its left
extensions differ, and all its suffixes are its occurrences. The start of a
stretch counts as a difference, so a repeat around several anchors comes in
pieces that cover it together.

Anchors that very many different stretches have (a common passage in many contexts)
don't meet in one task: their windows are compared by 128-bit fingerprints,
dealt anew by fingerprint, which gives the same bytes.

Defined cases: a null text is empty; texts shorter than MIN_BYTES have no
repeats; matches never cross documents; repeated rows are copies of each other;
an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch
from textwarden.llm.wordhash import BYTE, mix, pieces, text_bytes

U64 = np.uint64
MIN_BYTES, GRAM = 400, 64
#: Grams in a window.
GRAMS = MIN_BYTES - GRAM + 1
#: Different stretches of an anchor that still meet in one task; bytes of texts of a task on average.
MOST_RUNS, UNIT_BYTES = 2000, 4_000_000
#: Bytes that a task holds before it hands them on.
FLUSH_BYTES = 24_000_000
ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]

OCCURRENCES = "doc_id long, row_key long, start int, windows int, gram long, run long, bucket int, grams binary, runs binary, copies binary"


def gram_hashes(data: np.ndarray, length: int = GRAM, seed: int = 0) -> np.ndarray:
    """Hashes of all stretches of ``length`` bytes, by doubling: two halves, or two that overlap, make one."""
    h = BYTE[data] + U64(seed)
    size, step = 1, 0
    while size < length:
        shift = min(size, length - size)
        m = len(h) - shift
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = h[:m] * ODD[step] + h[shift : shift + m]
        h ^= h >> U64(31)
        size += shift
        step += 1
    return mix(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def stretches_of(data: np.ndarray, offsets: np.ndarray):
    """``row, start, windows, gram, text`` of the stretches around all anchors of a piece.

    Starts are within their rows; ``gram`` and ``text`` are hashes of the anchor and of the stretch.
    """
    lengths = np.diff(offsets)
    long_ = lengths >= MIN_BYTES
    if not long_.any():
        return None
    h = gram_hashes(data)
    least = window_minima(h, GRAMS)
    change = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(change, offsets[:-1][long_], 1)
    np.add.at(change, offsets[1:][long_] - MIN_BYTES + 1, -1)
    # Windows over two rows choose no anchor.
    least[np.cumsum(change[:-1]) <= 0] = 0
    edge = np.zeros(GRAMS - 1, np.uint64)
    anchor = np.flatnonzero(~window_minima(~np.concatenate([edge, least, edge]), GRAMS) == h)
    row = np.searchsorted(offsets, anchor, "right") - 1
    lo = np.maximum(offsets[row], anchor - (GRAMS - 1))
    hi = np.minimum(offsets[row + 1], anchor + MIN_BYTES)
    # A window with the same anchor twice goes with the first.
    order = np.lexsort((anchor, h[anchor], row))
    same = (h[anchor[order]][1:] == h[anchor[order]][:-1]) & (row[order][1:] == row[order][:-1])
    later, before = order[1:][same], order[:-1][same]
    lo[later] = np.maximum(lo[later], anchor[before] + 1)
    whole = hi - lo >= MIN_BYTES
    anchor, row, lo, hi = anchor[whole], row[whole], lo[whole], hi[whole]
    if not len(anchor):
        return None
    # A text of n grams is known by every GRAM-th of them and the last.
    last = hi - lo - GRAM
    n = last // GRAM + 2
    begin = np.cumsum(n) - n
    nth = np.arange(int(n.sum())) - np.repeat(begin, n)
    place = np.repeat(lo, n) + np.minimum(nth * GRAM, np.repeat(last, n))
    text = np.add.reduceat(mix(h[place] + nth.astype(np.uint64) * ODD[0]), begin)
    text = mix(text + (anchor - lo).astype(np.uint64) * ODD[1] + last.astype(np.uint64))
    return row, lo - offsets[row], hi - lo - MIN_BYTES + 1, h[anchor].astype(np.int64), text.astype(np.int64)


def _occurrences(buckets: int):
    names = [c.split()[0] for c in OCCURRENCES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), axis=0, return_counts=True)
            held.clear()
            bucket = (mix(pairs[:, 0].astype(np.uint64)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = [(int(bucket[i[0]]), pairs[i, 0].tobytes(), pairs[i, 1].tobytes(), np.minimum(counts[i], 2).astype(np.uint8).tobytes()) for i in np.split(order, cuts)]
            empty = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(empty, t) for t in kinds[:6]] + [pa.array([r[j] for r in rows], kinds[6 + j]) for j in range(4)], names=names)

        for batch in batches:
            ids, keys = batch.column(0).cast(pa.int64()), batch.column(1)
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in pieces(offsets):
                with np.errstate(over="ignore"):
                    found = stretches_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if found is None:
                    continue
                row, start, windows, gram, text = found
                at, empty = pa.array(lo + row), [None] * len(row)
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at)] + [pa.array(x).cast(t) for x, t in zip((start, windows, gram, text), kinds[2:6], strict=True)] + [pa.array(empty, t) for t in kinds[6:]], names=names)
                held.append(np.stack([gram, text], axis=1))
                size += 17 * len(gram)
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _met_again(table: pa.Table) -> pa.Table:
    """Stretches of one bucket that occur again or whose anchor others have: ``gram, run, copies, n_runs``."""
    pairs = np.stack([np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("grams", "runs")], axis=1)
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("copies").to_pylist()])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, counts = pairs[order], counts[order].astype(np.int64)
    new_gram = np.append(True, pairs[1:, 0] != pairs[:-1, 0])
    new = new_gram | np.append(True, pairs[1:, 1] != pairs[:-1, 1])
    copies = np.add.reduceat(counts, np.flatnonzero(new))
    pairs, new_gram = pairs[new], new_gram[new]
    n_runs = np.diff(np.append(np.flatnonzero(new_gram), len(pairs)))
    n_runs = np.repeat(n_runs, n_runs)
    keep = (copies > 1) | (n_runs > 1)
    return pa.table({"gram": pa.array(pairs[keep, 0]), "run": pa.array(pairs[keep, 1]), "copies": pa.array(np.minimum(copies[keep], 2).astype(np.int32)), "n_runs": pa.array(n_runs[keep].astype(np.int32))})


def lcp_intervals(suffixes: list[bytes], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """``(length, first, last)`` of the maximal repeats among sorted suffixes, by a scan with a stack.

    ``left`` tells the bytes before them apart. Deeper intervals come before those that hold them.
    """
    diverse = object()
    stack: list[list] = []  # [length, first, left extension]
    for i in range(1, len(suffixes) + 1):
        common = _common(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else 0
        first, extension = i - 1, left[i - 1]
        while stack and stack[-1][0] > common:
            length, lower, known = stack.pop()
            if known is not extension and known != extension:
                known = diverse
            if known is diverse and length >= least:
                yield length, lower, i - 1
            first, extension = lower, known
        if stack and stack[-1][0] == common:
            if stack[-1][2] is not extension and stack[-1][2] != extension:
                stack[-1][2] = diverse
        elif common >= least:
            stack.append([common, first, extension])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def maximal_repeats(texts: list[bytes], least: int = MIN_BYTES, groups: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """``(length, occurrences)`` of the maximal repeats within and between texts; an occurrence is (text, start).

    Of an occurrence the longest repeat comes first. Only texts of one group are
    compared, if groups are given.
    """
    groups = [0] * len(texts) if groups is None else groups
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    windows = np.maximum(lengths - least + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(text):
        return
    with np.errstate(over="ignore"):
        prints = mix(gram_hashes(data, least)[offsets[text] + start] + np.array(groups, np.int64).astype(np.uint64)[text] * ODD[2])
    order = np.argsort(prints, kind="stable")
    prints, text, start = prints[order], text[order], start[order]
    # What stands before: a byte, or the start of a text, which differs from all else.
    left = np.where(start > 0, data[offsets[text] + start - 1].astype(np.int64), 256 + text)
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    size = np.diff(np.append(first, len(prints)))
    differs = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    chosen = np.repeat((size > 1) & differs, size)
    text, start, left = text[chosen].tolist(), start[chosen].tolist(), left[chosen].tolist()
    suffixes = [texts[t][s:] for t, s in zip(text, start, strict=True)]
    by_group: dict[int, list[int]] = {}
    for i, t in enumerate(text):
        by_group.setdefault(groups[t], []).append(i)
    for members in by_group.values():
        members.sort(key=suffixes.__getitem__)
        for length, a, b in lcp_intervals([suffixes[i] for i in members], [left[i] for i in members], least):
            yield length, [(text[i], start[i]) for i in members[a : b + 1]]


def _once(table: pa.Table) -> pa.Table:
    """Each stretch once: repeated rows of documents give the same texts again."""
    first: dict[tuple[int, int], int] = {}
    for i, key in enumerate(zip(table.column("gram").to_pylist(), table.column("run").to_pylist(), strict=True)):
        first.setdefault(key, i)
    return table if len(first) == table.num_rows else table.take(pa.array(list(first.values())))


def _repeats(table: pa.Table) -> pa.Table:
    """Bytes of documents that maximal repeats among the stretches of a task cover."""
    table = _once(table)
    rows: dict[int, list[int]] = {}
    for i, gram in enumerate(table.column("gram").to_pylist()):
        rows.setdefault(gram, []).append(i)
    grams = table.column("gram").to_pylist()
    texts, start, copies = table.column("text").to_pylist(), table.column("start").to_pylist(), table.column("copies").to_pylist()
    at, spans = [], []

    def look(chosen: list[int]) -> None:
        seen = set()
        for length, occurrences in maximal_repeats([texts[i] for i in chosen], groups=[grams[i] for i in chosen]):
            for t, s in occurrences:
                if copies[chosen[t]] == 1 and (t, s) not in seen:
                    seen.add((t, s))
                    at.append(chosen[t])
                    spans.append((start[chosen[t]] + s, start[chosen[t]] + s + length))

    # Anchors are worked on together, about a unit at a time; their stretches may overlap and are not compared.
    chosen, size = [], 0
    for indexes in rows.values():
        chosen += indexes
        size += sum(len(texts[i]) for i in indexes)
        if size >= UNIT_BYTES:
            look(chosen)
            chosen, size = [], 0
    if chosen:
        look(chosen)
    taken = pa.array(at, pa.int64())
    return pa.table({"doc_id": table.column("doc_id").take(taken), "row_key": table.column("row_key").take(taken), "from": pa.array([a for a, _ in spans], pa.int32()), "to": pa.array([b for _, b in spans], pa.int32())})


SPANS = "doc_id long, row_key long, from int, to int"
PRINTS = "blob long, bucket int, prints binary, seconds binary, known binary"


def _window_prints(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each window of the stretches, with the anchor: stretches of others may hold the same place."""
    one, two = [], []
    with np.errstate(over="ignore"):
        for text, gram in zip(table.column("text").to_pylist(), table.column("gram").to_pylist(), strict=True):
            data, anchor = np.frombuffer(text, np.uint8), np.array([gram], np.int64).astype(np.uint64)
            one.append(mix(gram_hashes(data, MIN_BYTES) + anchor))
            two.append(mix(gram_hashes(data, MIN_BYTES, 77) ^ anchor))
    return np.concatenate(one), np.concatenate(two)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs, and where each different pair begins in it."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    return order, np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))


def _blob_prints(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Fingerprints of all windows of a blob of stretches, each different one once, by bucket."""
        table = _once(table)
        one, two = _window_prints(table)
        copies = np.repeat(table.column("copies").to_numpy(), table.column("windows").to_numpy())
        order, first = _distinct(one, two)
        known = np.add.reduceat(copies[order], first) > 1
        one, two = one[order[first]], two[order[first]]
        bucket = (one % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
        kinds = {"blob": pa.int64(), "bucket": pa.int32(), "prints": pa.binary(), "seconds": pa.binary(), "known": pa.binary()}
        values = [[key[0].as_py()] * len(groups), [int(bucket[i[0]]) for i in groups], *[[x[i].tobytes() for i in groups] for x in (one, two, known)]]
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds.values(), strict=True)], names=list(kinds))

    return run


def _repeated_prints(table: pa.Table) -> pa.Table:
    """For each blob the fingerprints of its windows that occur again anywhere."""
    parts = table.to_pylist()
    one, two, known = (np.concatenate([np.frombuffer(p[c], t) for p in parts]) for c, t in (("prints", U64), ("seconds", U64), ("known", bool)))
    blob = np.repeat([p["blob"] for p in parts], [len(p["known"]) for p in parts])
    order, first = _distinct(one, two)
    one, two, known, blob = (x[order] for x in (one, two, known, blob))
    size = np.diff(np.append(first, len(one)))
    again = np.repeat((size > 1) | np.logical_or.reduceat(known, first), size)
    one, two, blob = one[again], two[again], blob[again]
    by = np.argsort(blob, kind="stable")
    groups = [g for g in np.split(by, np.flatnonzero(np.diff(blob[by])) + 1) if len(g)]
    return pa.table({"blob": pa.array([int(blob[g[0]]) for g in groups], pa.int64()), "prints": pa.array([one[g].tobytes() for g in groups], pa.binary()), "seconds": pa.array([two[g].tobytes() for g in groups], pa.binary())})


def _blob_spans(runs: pa.Table, found: pa.Table) -> pa.Table:
    """Stretches of documents that the repeated windows of a blob cover.

    Windows are known by their fingerprints alone: a group's rows come in another
    order each time it is read.
    """
    at, spans = [], []
    runs = _once(runs)
    if runs.num_rows and found.num_rows:
        one, two = _window_prints(runs)
        n = len(one)
        known = [np.concatenate([np.frombuffer(x, U64) for x in found.column(c).to_pylist()]) for c in ("prints", "seconds")]
        order, first = _distinct(np.concatenate([one, known[0]]), np.concatenate([two, known[1]]))
        again = np.empty(len(order), dtype=bool)
        again[order] = np.repeat(np.logical_or.reduceat(order >= n, first), np.diff(np.append(first, len(order))))
        cut = np.concatenate([[0], np.cumsum(runs.column("windows").to_numpy())])
        for i, start in enumerate(runs.column("start").to_pylist()):
            mine = np.flatnonzero(np.diff(np.concatenate([[0], again[cut[i] : cut[i + 1]].astype(np.int8), [0]])))
            for a, b in mine.reshape(-1, 2).tolist():
                at.append(i)
                spans.append((start + a, start + b - 1 + MIN_BYTES))
    taken = pa.array(at, pa.int64())
    return pa.table({"doc_id": runs.column("doc_id").take(taken), "row_key": runs.column("row_key").take(taken), "from": pa.array([a for a, _ in spans], pa.int32()), "to": pa.array([b for _, b in spans], pa.int32())})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            merged: list[list[int]] = []
            for s in sorted((s["from"], s["to"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            kept, at = hashlib.sha256(), 0
            for a, b in merged:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            n_bytes.append(len(text))
            n_removed.append(sum(b - a for a, b in merged))
            n_spans.append(len(merged))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Stretches of bytes that repeats cover: ``doc_id, row_key, from, to``; ``documents`` has ``doc_id, row_key, text``."""
    spark = documents.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(documents.mapInArrow(_occurrences(buckets), OCCURRENCES))
    occurrences = found.where("bucket is null").select("doc_id", "row_key", "start", "windows", "gram", "run")
    packed = found.where("bucket is not null").select("bucket", "grams", "runs", "copies")
    again = packed.groupBy("bucket").applyInArrow(_met_again, "gram long, run long, copies int, n_runs int")
    candidates = scratch.keep(occurrences.join(again, ["gram", "run"]))
    end = F.col("start") + F.col("windows") + (MIN_BYTES - 1)
    whole = candidates.where("copies > 1").select("doc_id", "row_key", F.col("start").alias("from"), end.alias("to"))

    shown = scratch.keep(
        candidates.where("n_runs > 1").groupBy("gram", "run").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "start", "windows")).alias("at"), F.first("copies").alias("copies"), F.first("n_runs").alias("n_runs")).select("gram", "run", "copies", "n_runs", "at.doc_id", "at.row_key", "at.start", "at.windows")
    )
    n_shown = shown.agg(F.count("*"), F.sum(F.col("windows") + MIN_BYTES)).first()
    units = max(1, int(n_shown[1] or 0) // UNIT_BYTES)
    d = documents.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "text")
    # Stretches and spans grow with the input: they are merged, never broadcast, at every size.
    fetched = d.join(shown.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key")))
    slice_ = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("windows") + (MIN_BYTES - 1))
    texts = scratch.keep(fetched.select("gram", "run", "copies", "n_runs", "doc_id", "row_key", "start", "windows", slice_.alias("text")))
    unit = F.expr(f"pmod(xxhash64(gram), {units})")
    met = texts.where(F.col("n_runs") <= MOST_RUNS).withColumn("unit", unit).groupBy("unit").applyInArrow(_repeats, SPANS)
    many = texts.where(F.col("n_runs") > MOST_RUNS).withColumn("blob", F.expr(f"pmod(xxhash64(gram, run), {units})"))
    prints = many.groupBy("blob").applyInArrow(_blob_prints(buckets), PRINTS)
    repeated = prints.groupBy("bucket").applyInArrow(_repeated_prints, "blob long, prints binary, seconds binary")
    dealt = many.groupBy("blob").cogroup(repeated.groupBy("blob")).applyInArrow(_blob_spans, SPANS)
    return whole.unionByName(met).unionByName(dealt).distinct()


def without_repeats(documents: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    scratch = Scratch(documents.sparkSession, "repeats")
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    spans = repeated_spans(keyed, scratch).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "spans")
    joined = keyed.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
