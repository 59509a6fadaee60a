"""Exact top-k search by inner product, with a pivot table that rules candidates out.

Vectors are floored to integers, ``floor(64 * x)``. For each row the distances
to the pivots are kept; by the triangle inequality the largest difference
between a query's and a row's distance to a pivot bounds their distance from
below, and with both norms their inner product from above. Candidates are
evaluated in the order of that bound, until it falls below the k-th best score:
in tiles of rows that lie at like distances to the pivots, each for all queries
at once whose bound it reaches; one by one where scores may exceed doubles.

Rows are packed in blocks by their length and nearest pivot. A query first finds
its k best in its own block, which gives a threshold; then the queries of a
block go to the cells of pivots, and in them to the blocks of rows, that their
bounds don't rule out. Each block of rows meets bounded lots of queries.

Defined cases: rows without an id, and vectors that are null, empty or not
finite take no part; of rows with one id the least vector counts; vectors meet
those of their own length; components and scores beyond 64 bits stand at the end
of their range, and all others are exact; ties go to the smaller id; with fewer
candidates than k all are returned; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch
from textwarden.llm.vectors import usable_vectors

#: Pivots, the rows that they are chosen from (in the order of a hash), rows of a block.
PIVOTS, PIVOT_SAMPLE, BLOCK_ROWS = 24, 1024, 4096
#: Candidates that are evaluated between two looks at the bound.
STEP = 256
#: Scores that are worked out at a time.
MOST_SCORES = 1 << 20
#: Blocks of rows that share a key of the join of summaries, blocks of queries that meet a block of rows in one task.
CELL_BLOCKS, LOT_BLOCKS = 4096, 64
LONG = np.iinfo(np.int64)

PACK = "block long, length int, cell int, n int, ids binary, vectors binary, distances binary, norms binary, lo array<double>, hi array<double>, norm_hi double, q_ids binary, q_vectors binary, q_distances binary, q_norms binary, q_least binary, q_lo array<double>, q_hi array<double>, q_norm_hi double, q_least_all double"


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows of the sample that lie far from each other: each is the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots; of what is shorter the missing components count as zero."""
    both = min(x.shape[1], pivots.shape[1])
    if len(x) * len(pivots) * max(both, 1) > 1 << 24 and len(x) > 1:
        return np.concatenate([pivot_distances(p, pivots) for p in np.array_split(x, 2)])
    squares = ((x[:, None, :both] - pivots[None, :, :both]) ** 2).sum(axis=2)
    return np.sqrt(squares + (x[:, both:] ** 2).sum(axis=1)[:, None] + (pivots[:, both:] ** 2).sum(axis=1)[None, :])


def slack(norm: float | np.ndarray) -> float | np.ndarray:
    """What rounding may take from a bound: far more than double arithmetic does, less than a score."""
    return 1e-9 * norm + 0.25


def scores_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact; those beyond 64 bits at the end of the range."""
    if x.dtype != np.int64:
        return (x @ q).astype(np.int64)
    scores = x @ q  # modulo 2 ** 64, which is right where the product fits
    for i in np.flatnonzero(np.abs(x.astype(float) @ q.astype(float)) > 2.0**62):
        exact = sum(a * b for a, b in zip(x[i].tolist(), q.tolist(), strict=True))
        scores[i] = max(LONG.min, min(LONG.max, exact))
    return scores


def best_in_block(q: np.ndarray, q_norm: float, q_dist: np.ndarray, q_id: int, least: float, k: int, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, norms: np.ndarray) -> list[tuple[int, int]]:
    """``(score, id)`` of up to k rows of a block that score at least ``least``, best first."""
    bound = (q_norm + norms - np.abs(dist - q_dist).max(axis=1) ** 2) / 2 + slack(q_norm + norms)
    open_ = np.flatnonzero((bound >= least) & (ids != q_id))
    open_ = open_[np.argsort(-bound[open_], kind="stable")]
    found: list[tuple[int, int]] = []
    for at in range(0, len(open_), STEP):
        part = open_[at : at + STEP]
        if bound[part[0]] < least:
            break
        scores = scores_of(x[part], q)
        near = scores >= least
        found += zip((-v for v in scores[near].tolist()), ids[part[near]].tolist(), strict=True)
        if len(found) >= k:
            found = sorted(found)[:k]
            least = max(least, -found[-1][0])
    return [(-s, i) for s, i in sorted(found)[:k]]


def best_of_tiles(q: np.ndarray, q_norms: np.ndarray, q_dist: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of up to k rows of a block for each query, by its index, best first; as ``best_in_block``, of small values."""
    least = least.copy()
    order = np.lexsort((ids, dist[:, 0]))
    tiles = np.split(order, np.arange(STEP, len(order), STEP))
    # The bound of each query for each tile, from the ends of the tile's distances.
    bounds = np.empty((len(tiles), len(q)))
    for bound, tile in zip(bounds, tiles, strict=True):
        lo, hi, norm = dist[tile].min(axis=0), dist[tile].max(axis=0), norms[tile].max()
        apart = np.maximum(np.maximum(q_dist - hi, lo - q_dist), 0).max(axis=1)
        bound[:] = (q_norms + norm - apart**2) / 2 + slack(q_norms + norm)
    found = [np.zeros((3, 0), np.int64)]

    def best() -> np.ndarray:
        query, row, score = rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort((row, -score, query))]
        first = np.searchsorted(rows[0], np.arange(len(q)))
        rows = rows[:, np.arange(rows.shape[1]) - first[rows[0]] < k]
        full = np.bincount(rows[0], minlength=len(q)) == k
        last = np.cumsum(np.bincount(rows[0], minlength=len(q)))[full] - 1
        least[full] = np.maximum(least[full], rows[2, last])
        return rows

    held = 0
    for t in np.argsort(-bounds.max(axis=1, initial=-np.inf), kind="stable"):
        open_ = np.flatnonzero(bounds[t] >= least)
        tile = tiles[t]
        for part in np.split(open_, np.arange(MOST_SCORES // STEP, len(open_), MOST_SCORES // STEP)):
            scores = q[part] @ x[tile].T
            a, b = np.nonzero((scores >= least[part, None]) & (q_ids[part, None] != ids[None, tile]))
            found.append(np.stack([part[a], ids[tile[b]], scores[a, b].astype(np.int64)]))
            held += len(a)
        if held > 2 * k * len(q):
            found, held = [best()], 0
    return tuple(best())


def _is_small(x: np.ndarray) -> bool:
    """Whether products and their sums are exact in doubles, which are faster than integers."""
    top = float(np.abs(x.astype(float)).max(initial=0))
    return top * top * x.shape[1] < 2.0**53


def _below(score: int) -> float:
    """A double that is not above the score."""
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), -np.inf))


def _pack(pivots: np.ndarray, k: int, every: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("v").to_pylist(), np.int64)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        dist, norms = pivot_distances(x.astype(float), pivots), (x.astype(float) ** 2).sum(axis=1)
        q = ids % every == 0
        values, least = x.astype(np.float64) if _is_small(x) else x, []
        if values is x:
            for i in np.flatnonzero(q):
                best = best_in_block(values[i], norms[i], dist[i], ids[i], -np.inf, k, ids, values, dist, norms)
                least.append(_below(best[-1][0]) if len(best) == k else -np.inf)
        else:
            query, _, score = best_of_tiles(values[q], norms[q], dist[q], ids[q], np.full(q.sum(), -np.inf), k, ids, values, dist, norms)
            n = np.bincount(query, minlength=q.sum())
            least = np.full(len(n), -np.inf)
            least[n == k] = score[np.cumsum(n)[n == k] - 1]
        ends = lambda d: ([None], [None]) if not len(d) else ([d.min(axis=0).tolist()], [d.max(axis=0).tolist()])
        (lo, hi), (q_lo, q_hi) = ends(dist), ends(dist[q])
        least = np.array(least, float)
        columns = [[key[0].as_py()], [x.shape[1]], [table.column("cell")[0].as_py()], [len(ids)], [ids.tobytes()], [x.tobytes()], [dist.tobytes()], [norms.tobytes()], lo, hi, [norms.max()], [ids[q].tobytes()], [x[q].tobytes()], [dist[q].tobytes()], [norms[q].tobytes()], [least.tobytes()], q_lo, q_hi, [norms[q].max(initial=0)], [least.min() if len(least) else None]]
        doubles = pa.list_(pa.float64())
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, doubles, doubles, pa.float64(), *[pa.binary()] * 5, doubles, doubles, pa.float64(), pa.float64()]
        names = [c.split()[0] for c in PACK.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _search(k: int, n_pivots: int):
    def run(lots: pa.Table, block: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        for r in block.to_pylist()[: 1 if lots.num_rows else 0]:
            ids = np.frombuffer(r["ids"], np.int64)
            x = np.frombuffer(r["vectors"], np.int64).reshape(len(ids), -1)
            small = _is_small(x)
            doubles = x.astype(np.float64)
            dist, norms = np.frombuffer(r["distances"], float).reshape(-1, n_pivots), np.frombuffer(r["norms"], float)
            for row in lots.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(q_ids), -1)
                # Both sides are small enough together if each is: the product of two is at most the larger's square.
                values, q = (doubles, q.astype(np.float64)) if small and _is_small(q) else (x, q)
                q_dist, q_norms, least = np.frombuffer(row["q_distances"], float).reshape(-1, n_pivots), np.frombuffer(row["q_norms"], float), np.frombuffer(row["q_least"], float)
                if values is x:
                    for i, q_id in enumerate(q_ids.tolist()):
                        best = best_in_block(q[i], q_norms[i], q_dist[i], q_id, least[i], k, ids, values, dist, norms)
                        out.append(np.array([(q_id, v, s) for s, v in best], np.int64).reshape(-1, 3).T)
                else:
                    query, row_id, score = best_of_tiles(q, q_norms, q_dist, q_ids, least, k, ids, values, dist, norms)
                    out.append(np.stack([q_ids[query], row_id, score]))
        return pa.table(list(np.concatenate(out, axis=1)), names=["query_id", "vec_id", "score"])

    return run


def _apart(lo: str, hi: str):
    """The largest gap, over the pivots, between the distances of some queries and of some rows."""
    gaps = F.zip_with(F.zip_with("q_lo", hi, lambda a, b: a - b), F.zip_with(lo, "q_hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda most, x: F.greatest(most, x))


def _may_score(lo: str, hi: str, norm_hi: str):
    """Whether one of the queries may reach its threshold with one of the rows."""
    norms, apart = F.col("q_norm_hi") + F.col(norm_hi), _apart(lo, hi)
    return (norms - apart * apart) / 2 + 1e-9 * norms + 0.25 >= F.col("q_least_all")


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "top-k")
    floored = F.transform("embedding", lambda x: F.floor(64 * x))
    vectors = scratch.keep(usable_vectors(embeddings).select("vec_id", floored.alias("v")))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow().column(0).to_pylist()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = np.zeros((len(sample), max(map(len, sample))))
    for i, v in enumerate(sample):
        rows[i, : len(v)] = v
    pivots = choose_pivots(rows)
    placed = vectors.mapInArrow(_cells(pivots), "vec_id long, v array<long>, cell int").withColumn("length", F.size("v"))
    counts = scratch.keep(placed.groupBy("length", "cell").count())
    block = F.xxhash64("length", "cell", F.expr(f"pmod(xxhash64(vec_id), ceil(count / {BLOCK_ROWS}))"))
    packed = scratch.keep(placed.join(counts, ["length", "cell"]).select(block.alias("block"), "cell", "vec_id", "v").groupBy("block").applyInArrow(_pack(pivots, k, every), PACK))

    # A stated set of queries against all rows, in blocks: summaries of blocks of queries meet cells, then blocks in them.
    widest = lambda name, least: F.array(*[(F.min if least else F.max)(F.col(name)[i]) for i in range(len(pivots))])
    cells = packed.groupBy("length", "cell").agg(widest("lo", True).alias("cell_lo"), widest("hi", False).alias("cell_hi"), F.max("norm_hi").alias("cell_norm"), F.ceil(F.count("*") / CELL_BLOCKS).alias("subs"))
    queries = packed.where("q_least_all is not null").select("length", F.col("block").alias("q_block"), "q_lo", "q_hi", "q_norm_hi", "q_least_all")
    open_cells = queries.join(cells, "length").where(_may_score("cell_lo", "cell_hi", "cell_norm"))
    asked = open_cells.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).drop("cell_lo", "cell_hi", "cell_norm", "subs")
    held = packed.join(cells.select("length", "cell", "subs"), ["length", "cell"]).select("length", "cell", F.expr("pmod(block, subs)").alias("sub"), "block", "lo", "hi", "norm_hi")
    pairs = asked.join(held, ["length", "cell", "sub"]).where(_may_score("lo", "hi", "norm_hi")).select("q_block", "block")
    lots = pairs.groupBy("block").agg(F.ceil(F.count("*") / LOT_BLOCKS).alias("lots"))
    q_side = packed.select(F.col("block").alias("q_block"), "q_ids", "q_vectors", "q_distances", "q_norms", "q_least")
    left = pairs.join(lots, "block").withColumn("lot", F.expr("pmod(xxhash64(q_block), lots)")).drop("lots").join(q_side.hint("merge"), "q_block")
    right = packed.select("block", "ids", "vectors", "distances", "norms").join(lots, "block").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("lots")
    found = left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInArrow(_search(k, len(pivots)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cells(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = batch.column("v").to_pylist()
            cell, length = np.zeros(len(rows), np.int32), np.array([len(v) for v in rows])
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                cell[at] = pivot_distances(np.array([rows[i] for i in at], float), pivots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell)], names=["vec_id", "v", "cell"])

    return run
