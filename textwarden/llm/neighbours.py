"""Near-duplicate vectors by NN-descent over tight balls.

First vectors are gathered in balls: all members are within half the threshold
angle of one centre, so they are linked with each other and need no pairs; a
group of copies, however large, becomes one row. Then a graph of nearest
neighbours is built over the balls: lists start from buckets of random
hyperplanes and are refined by joins of neighbours of neighbours; lists whose
last entry could still matter are enlarged. A sample of balls is compared with
all others, and rounds go on, with growing lists in the end, until the recall of links,
over pairs and averaged over balls, is RECALL; a run that stays below it fails. The sample
grows until enough of it have links; where links are too rare for that, points are
planted at the edge of the threshold, searched for with the others and left out of the result.
Nearness counts between the edges of balls: what is left of the angle of their
centres without both radii.

A list holds a bounded number of entries. Balls with more neighbours than that, in
dense but loose groups, are compared with all balls of their component of the
graph, in blocks, which counts their links without listing the pairs.

By the triangle inequality most pairs of balls are linked wholly or not at all,
and the members of the rest are compared in blocks. All links are decided in
double precision.

Defined cases: vectors that are null, empty, zero or not finite link with
nothing, and vectors of different lengths do not link; of rows with one id the
least vector counts, and each row is returned; rows without an id are returned
with nulls; an empty table gives an empty result; labels and other columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.components import connected_components
from textwarden.llm.scratch import Scratch
from textwarden.llm.vectors import lengths, usable_vectors

THRESHOLD = 0.95
#: Neighbours of a list that is full of near ones: it grows no further, and its ball is compared in blocks.
MOST_LIST = 80
#: Neighbours of a list at first; buckets' rows on average and at most; tables of buckets at first and for each further round.
NEIGHBOURS, BUCKET_ROWS, MOST_ROWS, TABLES, MORE_TABLES = 10, 1000, 4096, 8, 4
#: Rounds at least, and before lists are doubled in each; rounds without gain after which the run fails; balls in the audit; recall of links to reach.
LEAST_ROUNDS, MOST_ROUNDS, MOST_STALLED, AUDITED, RECALL = 2, 6, 3, 256, 0.98
#: Balls with a link that the audit needs; balls that it compares with all others at most, and probes that it plants where these have too few links.
LEAST_LINKED, MOST_AUDITED, PROBES = 50, 4096, 200
#: Angles that a task works out at a time, of all between two blocks, which bounds its memory.
MOST_ANGLES = 1 << 21
#: Angles are compared with this slack, far above the error of double arithmetic at these angles.
SLACK = 1e-6


def _vectors(column) -> np.ndarray:
    """The rows of a binary column of one length, without nulls, as they lie in its buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[first:last].copy().view(np.float64).reshape(len(column), -1)


def _slices(n: int, width: int) -> list[slice]:
    """Slices of ``n`` rows that meet ``width`` others each."""
    step = max(1, MOST_ANGLES // max(1, width))
    return [slice(at, at + step) for at in range(0, n, step)]


def _nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The angles between the edges of balls, negated; the last component of a row is its radius."""
    return x[:, -1:] + y[None, :, -1] - np.arccos(np.clip(x[:, :-1] @ y[:, :-1].T, -1, 1))


def _bucketed(points: DataFrame, tables: range, n: int, scratch: Scratch, rest: int = 0) -> DataFrame:
    """Each point once a table: ``bucket, salt, id, vector``; crowded buckets are split by a hash of the ids.

    The last ``rest`` components are not part of the direction.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS))))

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column("vector"))
            x = x[:, : x.shape[1] - rest]
            for t in tables:
                planes = np.random.default_rng(1000 + t).normal(size=(x.shape[1], bits))
                key = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key + (t << 40), pa.int64()), batch.column("id"), batch.column("vector")], names=["bucket", "id", "vector"])

    placed = points.select("id", "vector").mapInArrow(run, "bucket long, id long, vector binary")
    crowds = placed.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / MOST_ROWS).alias("salts"))
    return placed.join(crowds, "bucket").withColumn("salt", F.expr("pmod(xxhash64(id, bucket), salts)")).drop("salts")


def _leaders(limit: float):
    def run(table: pa.Table) -> pa.Table:
        """For each point of a bucket the first one, by id, that leads it: no point leads and is led."""
        ids, x = table.column("id").to_numpy(), _vectors(table.column("vector"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        centre = np.full(len(ids), -1)
        near = np.empty((len(ids), len(ids)), dtype=bool)
        for part in _slices(len(ids), len(ids)):
            near[part] = x[part] @ x.T >= limit
        for i in range(len(ids)):
            if centre[i] < 0:
                centre[near[i] & (centre < 0)] = i
                centre[i] = i
        return pa.table({"id": pa.array(ids), "centre": pa.array(ids[centre])})

    return run


def balls(points: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``id, centre`` of all points; members are within half the threshold angle of their centre."""
    limit = math.cos(math.acos(THRESHOLD) / 2 - SLACK)
    led = scratch.keep(_bucketed(points, range(100, 101), n, scratch).groupBy("bucket", "salt").applyInArrow(_leaders(limit), "id long, centre long"))
    for step in (1, 2):
        crowded = led.groupBy("centre").count().where("count > 1").select(F.col("centre").alias("id"))
        centres = points.join(crowded, "id")
        moved = _bucketed(centres, range(100 + step, 101 + step), crowded.count(), scratch).groupBy("bucket", "salt").applyInArrow(_leaders(limit), "id long, centre long").where("id != centre")
        target = moved.select(F.col("id").alias("centre"), F.col("centre").alias("to")).join(points.select(F.col("id").alias("to"), F.col("vector").alias("to_vector")), "to")
        asked = led.join(points, "id").join(target, "centre", "left")
        led = scratch.keep(asked.mapInArrow(_move(limit), "id long, centre long"))
    return led


def _move(limit: float):
    def run(batches):
        """Members go to the centre that theirs went to, where they are near enough to it."""
        for batch in batches:
            x, centre = _vectors(batch.column("vector")), batch.column("centre").to_numpy(zero_copy_only=False).copy()
            at = np.flatnonzero(np.asarray(batch.column("to").is_valid()))
            if len(at):
                y = _vectors(batch.column("to_vector").take(pa.array(at)))
                near = (x[at] * y).sum(axis=1) >= limit
                centre[at[near]] = batch.column("to").to_numpy(zero_copy_only=False)[at[near]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(centre, pa.int64())], names=["id", "centre"])

    return run


LISTS = "id long, capacity int, dense boolean, others binary, cosines binary"


def _lists(ids: np.ndarray, capacity: np.ndarray, owner: np.ndarray, other: np.ndarray, cosine: np.ndarray, dense: np.ndarray | None = None) -> pa.Table:
    """The best entries of each list as rows; ``owner`` indexes ``ids``, entries may repeat."""
    order = np.lexsort((other, -cosine, owner))
    owner, other, cosine = owner[order], other[order], cosine[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1]))[: len(owner)]
    owner, other, cosine = owner[new], other[new], cosine[new]
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    keep = np.arange(len(owner)) - first[owner] < capacity[owner]
    owner, other, cosine = owner[keep], other[keep], cosine[keep]
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    return pa.table({"id": pa.array(ids, pa.int64()), "capacity": pa.array(capacity, pa.int32()), "dense": pa.array(np.zeros(len(ids), dtype=bool) if dense is None else dense), "others": pa.array(cut(other.astype(np.int64)), pa.binary()), "cosines": pa.array(cut(cosine.astype(np.float64)), pa.binary())})


def _start(table: pa.Table) -> pa.Table:
    """Nearest neighbours within a bucket."""
    ids, x = table.column("id").to_numpy(), _vectors(table.column("vector"))
    k = min(NEIGHBOURS, len(ids) - 1)
    best, value = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))
    for part in _slices(len(ids), len(ids)) if k > 0 else []:
        c = -_nearness(x[part], x)
        c[np.arange(len(c)), np.arange(part.start, part.start + len(c))] = 9
        best[part] = np.argpartition(c, k - 1, axis=1)[:, :k]
        value[part] = -np.take_along_axis(c, best[part], axis=1)
    return _lists(ids, np.full(len(ids), NEIGHBOURS), np.repeat(np.arange(len(ids)), k), ids[best.ravel()], value.ravel())


def _merge(limits: float):
    def run(table: pa.Table) -> pa.Table:
        """One list an id from all its rows; a full list whose last entry could still matter is let grow."""
        ids, owner_of = np.unique(table.column("id").to_numpy(), return_inverse=True)
        capacity = np.zeros(len(ids), np.int64)
        np.maximum.at(capacity, owner_of, table.column("capacity").to_numpy())
        others = [np.frombuffer(x, np.int64) for x in table.column("others").to_pylist()]
        cosine = np.concatenate([np.frombuffer(x, np.float64) for x in table.column("cosines").to_pylist()])
        owner = np.repeat(owner_of, [len(x) for x in others])
        other = np.concatenate(others)
        # Saturated: as many different entries above the limit as the list holds.
        pairs = np.unique(np.stack([owner[cosine >= limits], other[cosine >= limits]], axis=1), axis=0)
        near = np.bincount(pairs[:, 0], minlength=len(ids))
        while (full := (near >= capacity) & (capacity < MOST_LIST)).any():
            capacity[full] *= 2
        return _lists(ids, capacity, owner, other, cosine, near >= capacity)

    return run


def _local_join(table: pa.Table) -> pa.Table:
    """Members of each neighbourhood as neighbours of each other."""
    centre, ids, x = table.column("centre").to_numpy(), table.column("id").to_numpy(), _vectors(table.column("vector"))
    capacity = table.column("capacity").to_numpy()
    order = np.argsort(centre, kind="stable")
    cuts = np.flatnonzero(np.diff(centre[order])) + 1
    owners, others, cosines = [], [], []
    for index in np.split(order, cuts):
        if len(index) < 2:
            continue
        c = _nearness(x[index], x[index])
        c[ids[index][:, None] == ids[index][None, :]] = -9
        k = min(int(capacity[index].max()), len(index) - 1)
        best = np.argpartition(-c, k - 1, axis=1)[:, :k]
        a = np.repeat(np.arange(len(index)), k)
        value = c[a, best.ravel()]
        good = value > -9
        owners.append(ids[index][a][good])
        others.append(ids[index][best.ravel()][good])
        cosines.append(value[good])
    if not owners:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())], names=[c.split()[0] for c in LISTS.split(", ")])
    owner, other, cosine = np.concatenate(owners), np.concatenate(others), np.concatenate(cosines)
    found, where = np.unique(owner, return_inverse=True)
    most = dict(zip(ids.tolist(), capacity.tolist(), strict=True))
    return _lists(found, np.array([most[i] for i in found.tolist()]), where, other, cosine)


def _entries(lists: DataFrame) -> DataFrame:
    """``id, other, cosine`` of all list entries."""

    def run(batches):
        for batch in batches:
            others = [np.frombuffer(x, np.int64) for x in batch.column("others").to_pylist()]
            owner = np.repeat(batch.column("id").to_numpy(), [len(x) for x in others])
            cosine = b"".join(batch.column("cosines").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(others) if others else np.zeros(0, np.int64)), pa.array(np.frombuffer(cosine, np.float64))], names=["id", "other", "cosine"])

    return lists.select("id", "others", "cosines").mapInArrow(run, "id long, other long, cosine double")


def nearest(points: DataFrame, n: int, limit: float, scratch: Scratch, report: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``id, other, cosine`` of at least ``limit`` found by NN-descent; balls whose list holds not all of theirs
    (``id``), with the component of the graph that they are in (``id, group``).

    Pairs of the latter are complete within their component; the audit has shown that to be enough.
    """
    audit, probes, n_linked = _audit(points, n, limit, scratch)
    real = points
    if probes is not None:
        points = scratch.keep(points.select("id", "vector").union(probes.select("id", "vector")))
    units = max(1, n // 1000)
    unit = F.expr(f"pmod(xxhash64(id), {units})")
    merged = lambda rows: scratch.keep(rows.withColumn("unit", unit).groupBy("unit").applyInArrow(_merge(limit), LISTS))
    start = lambda tables: _bucketed(points, tables, n, scratch, 1).groupBy("bucket", "salt").applyInArrow(_start, LISTS)
    lists = merged(start(range(TABLES)))
    recall, best, stalled = 0.0, -1.0, 0
    for round_ in itertools.count():
        if round_ >= MOST_ROUNDS:
            # Rounds alone were not enough: lists grow as long as that brings more links.
            stalled = stalled + 1 if recall <= best else 0
            if stalled == MOST_STALLED:
                raise RuntimeError(f"near-duplicate vectors: recall {recall:.3f} of {RECALL} after {round_} rounds")
            lists = scratch.keep(lists.withColumn("capacity", F.least(F.col("capacity") * 2, F.greatest(F.lit(4 * MOST_LIST), F.col("capacity")))))
        best = max(best, recall)
        entries = _entries(lists).join(lists.select("id", "capacity"), "id")
        # Reverse lists of hubs are thinned by a hash to about what a list holds; lists are not.
        degree = entries.groupBy("other").agg(F.count("*").alias("n")).withColumnRenamed("other", "centre")
        own = lists.select(F.col("id").alias("centre"), F.col("capacity").alias("room"))
        back = entries.select(F.col("other").alias("centre"), "id").join(degree, "centre").join(own, "centre").where("pmod(xxhash64(id, centre), n) < room").select("centre", "id")
        around = entries.select(F.col("id").alias("centre"), F.col("other").alias("id")).union(back).distinct()
        with_vectors = around.join(points.select("id", "vector"), "id").join(lists.select("id", "capacity"), "id")
        joined = with_vectors.withColumn("unit", F.expr(f"pmod(xxhash64(centre), {units})")).groupBy("unit").applyInArrow(_local_join, LISTS)
        fresh = start(range(TABLES + MORE_TABLES * (round_ - 1), TABLES + MORE_TABLES * round_)) if round_ >= LEAST_ROUNDS else None
        lists = merged(lists.union(joined) if fresh is None else lists.union(joined).union(fresh))
        found = _entries(lists).where(F.col("cosine") >= limit).select("id", "other")
        both = found.union(found.select(F.col("other"), F.col("id"))).distinct()
        dense = lists.where("dense").select("id")
        groups = connected_components(found, scratch).select(F.col("node").alias("id"), F.col("component").alias("group")) if not dense.isEmpty() else None
        hits = both.withColumn("hit", F.lit(1))
        if groups is not None:
            # What is in one component with a dense ball will be compared with it.
            side = lambda name: groups.join(dense.withColumn("dense", F.lit(True)), "id", "left").select(F.col("id").alias(name), F.col("group").alias(f"{name}_group"), F.col("dense").alias(f"{name}_dense"))
            hits = hits.union(audit.join(side("id"), "id").join(side("other"), "other").where("id_group = other_group and (id_dense or other_dense)").select("id", "other", F.lit(1))).distinct()
        # Each ball with links counts alike, and so do all pairs: neither a dense group nor small ones are hidden.
        of_ball = audit.join(hits, ["id", "other"], "left").groupBy("id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
        by_ball, n_true, n_found = of_ball.agg(F.avg(F.col("n_found") / F.col("n_true")), F.sum("n_true"), F.sum("n_found")).first()
        # Without a true link all balls were drawn, and there is nothing to find.
        recall = min(by_ball, n_found / n_true) if n_true else 1.0
        if round_ + 1 >= LEAST_ROUNDS and recall >= RECALL:
            break
    if report is not None:
        report |= {"recall": recall, "linked_balls": n_linked, "probes": 0 if probes is None else PROBES, "true_pairs": n_true or 0, "rounds": round_ + 1}
    none = points.sparkSession.createDataFrame([], "id long, group long")
    pairs = _entries(lists).where(F.col("cosine") >= limit)
    if probes is not None:
        planted = F.broadcast(probes.select("id"))
        pairs = pairs.join(planted, "id", "left_anti").join(planted.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "cosine")
        dense = dense.join(real.select("id"), "id", "left_semi")
    return pairs, dense, none if groups is None else groups


def _audit(points: DataFrame, n: int, limit: float, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, int]:
    """True links ``id, other`` to measure the recall on, planted points or None, and how many drawn balls have a link.

    Balls are drawn by a hash of their ids and compared with all others, more of them while too few have
    a link. Where links are rarer than that, each of PROBES balls gets a point of its own at nearly the largest
    angle that still links: these pairs have no help from neighbours and are the hardest to find.
    """
    drawn = AUDITED
    while True:
        sample = points.orderBy(F.xxhash64("id"), "id").limit(drawn).toArrow()
        sent = points.sparkSession.sparkContext.broadcast((sample.column("id").to_numpy(), _vectors(sample.column("vector"))))
        audit = scratch.keep(points.mapInArrow(_true_links(sent, limit), "id long, other long"))
        n_linked = audit.select("id").distinct().count()
        if n_linked >= LEAST_LINKED or drawn >= n:
            return audit, None, n_linked
        if drawn >= MOST_AUDITED:
            break
        drawn = min(4 * drawn, MOST_AUDITED)
    least, most = points.agg(F.min("id"), F.max("id")).first()
    rng = np.random.default_rng(17)
    rows, pairs = [], []
    for i, (ball, vector) in enumerate(zip(sample.column("id").to_pylist()[:PROBES], sample.column("vector").to_pylist()[:PROBES], strict=True)):
        x = np.frombuffer(vector, np.float64)
        away = rng.normal(size=len(x) - 1)
        away -= (away @ x[:-1]) * x[:-1]
        length = np.sqrt(away @ away)
        if not length:
            continue
        angle = 0.99 * -limit + x[-1]
        planted = np.append(np.cos(angle) * x[:-1] + np.sin(angle) * away / length, 0.0)
        name = most + 1 + i if most < 2**62 else least - 1 - i
        rows.append((name, planted.tobytes()))
        pairs.append((name, ball))
    spark = points.sparkSession
    probes = spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "vector": pa.array([r[1] for r in rows], pa.binary())}))
    known = spark.createDataFrame(pa.table({"id": pa.array([p[0] for p in pairs], pa.int64()), "other": pa.array([p[1] for p in pairs], pa.int64())}))
    return scratch.keep(audit.union(known)), scratch.keep(probes), n_linked


def _true_links(sent, limit: float):
    def run(batches):
        ids, x = sent.value
        for batch in batches:
            y, others = _vectors(batch.column("vector")), batch.column("id").to_numpy()
            for part in _slices(len(y), len(x)):
                b, a = np.nonzero(_nearness(y[part], x) >= limit)
                pairs = ids[a], others[part][b]
                other = pairs[0] != pairs[1]
                yield pa.RecordBatch.from_arrays([pa.array(p[other], pa.int64()) for p in pairs], names=["id", "other"])

    return run


DENSE = "one long, two long, kind string, more long"


def _among(reach: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of dense balls against a block of all of their component.

        Rows of kind ``more`` count linked vectors of other balls, those of kind ``link``
        connect what links connect, and those of kind ``some`` are pairs whose members are to be compared.
        """
        a, b = (t.column("id").to_numpy() for t in (left, right))
        out: list[tuple[np.ndarray, np.ndarray, str, np.ndarray]] = []
        if len(a) and len(b):
            x, y = (_vectors(t.column("vector")) for t in (left, right))
            size_a, size_b = (t.column("size").to_numpy() for t in (left, right))
            dense_b = np.asarray(right.column("dense"))
            whole, some = (np.empty((len(a), len(b)), dtype=bool) for _ in range(2))
            count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for part in _slices(len(a), len(b)):
                edge = -_nearness(x[part], y)
                spread = x[part, -1:] + y[None, :, -1]
                other = a[part, None] != b[None, :]
                whole[part] = other & (edge + 2 * spread < reach - SLACK)
                some[part] = other & ~whole[part] & (edge <= reach + SLACK) & (~dense_b[None, :] | (a[part, None] < b[None, :]))
                count_a[part] = whole[part] @ size_b
                count_b += size_a[part] @ whole[part]
            out.append((a, a, "more", count_a))
            # Links of dense balls with each other are counted from both sides.
            plain = ~dense_b
            out.append((b[plain], b[plain], "more", count_b[plain]))
            i, j = np.nonzero(some)
            out.append((a[i], b[j], "some", np.zeros(len(i), np.int64)))
            open_ = whole.any(axis=1)
            while open_.any():
                rows = np.zeros(len(a), dtype=bool)
                rows[np.argmax(open_)] = True
                while True:
                    columns = whole[rows].any(axis=0)
                    wider = whole[:, columns].any(axis=1)
                    if (wider == rows).all():
                        break
                    rows = wider
                first = b[np.argmax(columns)]
                linked = np.concatenate([a[rows], b[columns]])
                out.append((np.full(len(linked), first), linked, "link", np.zeros(len(linked), np.int64)))
                open_ &= ~rows
        kinds = pa.chunked_array([pa.repeat(pa.scalar(o[2], pa.string()), len(o[0])) for o in out], pa.string())
        join = lambda k: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64)
        return pa.table({"one": pa.array(join(0), pa.int64()), "two": pa.array(join(1), pa.int64()), "kind": kinds, "more": pa.array(join(3), pa.int64())})

    return run


def among_dense(points: DataFrame, dense: DataFrame, groups: DataFrame, reach: float, scratch: Scratch) -> DataFrame:
    """What links dense balls (``id``) with all balls of their group: rows as ``_among`` gives them; ``points`` has the size of each ball."""
    marked = dense.withColumn("dense", F.lit(True))
    members = groups.join(marked, "id", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    counts = members.groupBy("group").agg(F.count("*").alias("n"), F.count_if("dense").alias("n_dense")).where("n_dense > 0")
    parts = lambda n: F.ceil(F.col(n) / MOST_ROWS)
    placed = scratch.keep(members.join(counts, "group").join(points, "id").withColumn("n_a", parts("n_dense")).withColumn("n_b", parts("n")))
    mine = lambda n, seed: F.expr(f"pmod(xxhash64(id, {seed}), {n})")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.where("dense").withColumn("a", mine("n_a", 1)).withColumn("b", every("n_b"))
    right = placed.withColumn("b", mine("n_b", 2)).withColumn("a", every("n_a"))
    side = lambda rows: rows.select("group", "a", "b", "id", "vector", "size", "dense").groupBy("group", "a", "b")
    return scratch.keep(side(left).cogroup(side(right)).applyInArrow(_among(reach), DENSE))


def _compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between members of two balls, one block of each: how many each member has."""
    a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
    links = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)]
    if len(a) and len(b):
        x, y = _vectors(left.column("vector")), _vectors(right.column("vector"))
        for part in _slices(len(a), len(b)):
            near = x[part] @ y.T >= THRESHOLD
            links[0][part] = near.sum(axis=1)
            links[1] += near.sum(axis=0)
    counts = np.concatenate(links)
    ids = np.concatenate([a, b])
    one, two = key[0].as_py(), key[1].as_py()
    keep = counts > 0
    return pa.table({"id": pa.array(ids[keep]), "links": pa.array(counts[keep].astype(np.int64)), "one": pa.array([one] * int(keep.sum()), pa.int64()), "two": pa.array([two] * int(keep.sum()), pa.int64())})


def near_duplicates(embeddings: DataFrame, report: dict | None = None) -> DataFrame:
    """One row a row: ``vec_id, n_links, component_id, kept``.

    ``report`` is filled with what the audit measured, by length of the vectors: the recall of links, the
    drawn balls that have a link, planted probes, pairs audited and rounds.
    """
    scratch = Scratch(embeddings.sparkSession, "neighbours")
    usable = scratch.keep(usable_vectors(embeddings))
    reports = report if report is not None else {}
    linked = [_linked(usable.where(F.size("embedding") == n), scratch, reports.setdefault(n, {})) for n in lengths(usable)]
    vec_id = F.col("vec_id").cast("long")
    none = F.lit(None).cast("long")
    out = embeddings.select(vec_id.alias("vec_id"))
    found = functools.reduce(DataFrame.union, linked) if linked else out.select(F.col("vec_id").alias("id"), none.alias("n_links"), none.alias("component_id")).where("false")
    out = out.join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _linked(usable: DataFrame, scratch: Scratch, report: dict) -> DataFrame:
    """``id, n_links, component_id`` of vectors of one length."""
    spark = usable.sparkSession

    def unit_length(batches):
        for batch in batches:
            x = np.array(batch.column("embedding").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            # Scaled first, so that squares neither overflow nor vanish.
            top = np.abs(x).max(axis=1, initial=0)
            good = top > 0
            x = x[good] / top[good, None]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vector"])

    points = scratch.keep(usable.mapInArrow(unit_length, "id long, vector binary"))
    n = points.count()
    led = balls(points, n, scratch)
    centres = points.select(F.col("id").alias("centre"), F.col("vector").alias("centre_vector"))

    def angles(batches):
        for batch in batches:
            c = (_vectors(batch.column("vector")) * _vectors(batch.column("centre_vector"))).sum(axis=1)
            own = batch.column("id").to_numpy() == batch.column("centre").to_numpy()
            angle = np.where(own, 0.0, np.arccos(np.clip(c, -1, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("centre"), pa.array(angle)], names=["id", "centre", "angle"])

    members = scratch.keep(led.join(points, "id").join(centres, "centre").mapInArrow(angles, "id long, centre long, angle double"))
    sizes = scratch.keep(members.groupBy("centre").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("id").alias("least")))
    reach = math.acos(THRESHOLD)
    n_balls = sizes.count()

    def with_radius(batches):
        for batch in batches:
            x = np.concatenate([_vectors(batch.column("vector")), batch.column("radius").to_numpy()[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "size", "vector"])

    centred = scratch.keep(points.join(sizes.select(F.col("centre").alias("id"), "size", "radius"), "id").mapInArrow(with_radius, "id long, size long, vector binary"))
    found, dense, groups = nearest(centred.select("id", "vector"), n_balls, -(reach + SLACK), scratch, report)
    among = among_dense(centred, dense, groups, reach, scratch)

    ordered = found.select(F.least("id", "other").alias("one"), F.greatest("id", "other").alias("two"), "cosine").groupBy("one", "two").agg(F.max("cosine").alias("cosine"))
    for name in ("one", "two"):
        ordered = ordered.join(dense.select(F.col("id").alias(name)), name, "left_anti")
    of = lambda name: sizes.select(F.col("centre").alias(name), F.col("size").alias(f"{name}_size"), F.col("radius").alias(f"{name}_radius"), F.col("least").alias(f"{name}_least"))
    spread = F.col("one_radius") + F.col("two_radius")
    decided = F.when(2 * spread - F.col("cosine") < reach - SLACK, "all").otherwise("some")
    of_dense = among.where("kind = 'some'").select("one", "two", F.lit(None).cast("double").alias("cosine"))
    pairs = scratch.keep(ordered.select("one", "two", "cosine").union(of_dense).join(of("one"), "one").join(of("two"), "two").withColumn("links", decided))
    whole, some = pairs.where("links = 'all'"), pairs.where("links = 'some'")

    blocks = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"{name}_size") / MOST_ROWS) - 1))
    mine = lambda name: F.expr(f"pmod(xxhash64(id), ceil({name}_size / {MOST_ROWS}))")
    placed = points.join(members.select("id", "centre"), "id")
    left = some.join(placed, F.col("one") == F.col("centre")).withColumn("block_1", mine("one")).withColumn("block_2", blocks("two"))
    right = some.join(placed, F.col("two") == F.col("centre")).withColumn("block_2", mine("two")).withColumn("block_1", blocks("one"))
    keys = ["one", "two", "block_1", "block_2"]
    side = lambda rows: rows.select(*[F.col(c).alias(c) for c in (*keys, "id", "vector")]).groupBy(*keys)
    compared = scratch.keep(side(left).cogroup(side(right)).applyInArrow(_compare, "id long, links long, one long, two long"))

    more = among.where("kind = 'more'").select(F.col("one").alias("centre"), "more")
    by_ball = whole.select(F.col("one").alias("centre"), F.col("two_size").alias("more")).union(whole.select(F.col("two"), F.col("one_size"))).union(more).groupBy("centre").agg(F.sum("more").alias("more"))
    by_member = compared.groupBy("id").agg(F.sum("links").alias("single"))
    linked = compared.select("one", "two").distinct().join(pairs.select("one", "two", "one_least", "two_least"), ["one", "two"])
    of_least = among.where("kind = 'link'").join(of("one"), "one").join(of("two"), "two").select("one_least", "two_least")
    edges = whole.select("one_least", "two_least").union(linked.select("one_least", "two_least")).union(of_least)
    reached = connected_components(edges, scratch)
    per_ball = sizes.join(by_ball, "centre", "left").join(reached, F.col("least") == F.col("node"), "left").select("centre", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("shared"), F.coalesce("component", "least").alias("component_id"))
    return members.select("id", "centre").join(per_ball, "centre").join(by_member, "id", "left").select("id", (F.col("shared") + F.coalesce("single", F.lit(0))).cast("long").alias("n_links"), "component_id")
