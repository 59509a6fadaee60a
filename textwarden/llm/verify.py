"""Exact Jaccard verification of texts that stand in blocks of candidates.

A block of many texts is cut into parts of bounded size. First each part is
verified with a few texts of the whole block, its pivots, which joins groups of
near copies over all parts. Only texts that are then still outside the largest
component of their block are compared with all parts, so a large group of near
copies costs work in proportion to its size, and no link between components is
lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.components import connected_components
from textwarden.llm.scratch import Scratch
from textwarden.llm.wordhash import mix, ngram_sets

#: Texts of a block, and n-grams in them, that are verified in one task; larger blocks are cut into parts.
PART_TEXTS, PART_MEMBERS = 1000, 400_000
#: Texts of a block, about, that all its parts are compared with first.
PIVOTS = 16


def fingerprint(members: np.ndarray) -> int:
    """A 64-bit sum over a set."""
    with np.errstate(over="ignore"):
        return int(mix(members).sum().astype(np.int64))


def linked_forest(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, as many as join each component; every pair of components has been ruled out.

    ``known`` numbers the components that the sets are already in.

    A set is compared with all others at once. The next to be compared is always
    from the component with the fewest sets not yet compared; when all of those
    are in one component, no link between components is left to be found.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    members = np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    owner = np.repeat(np.arange(m), sizes)[order]
    members = members[order]
    label = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    open_ = np.ones(m, dtype=bool)
    links = []
    while True:
        counts = np.bincount(label[open_], minlength=m)
        if np.count_nonzero(counts) <= 1:
            return links
        smallest = int(np.argmin(np.where(counts > 0, counts, m + 1)))
        x = int(np.flatnonzero(open_ & (label == smallest))[0])
        open_[x] = False
        lo, hi = np.searchsorted(members, sets[x], "left"), np.searchsorted(members, sets[x], "right")
        n = hi - lo
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shared = np.bincount(owner[index], minlength=m)
        near = 100 * shared >= percent * (sizes + sizes[x] - shared)
        for other in np.unique(label[near & (label != label[x])]):
            links.append((x, int(np.flatnonzero(near & (label == other))[0])))
            label[label == other] = label[x]


def _verify(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        block, lo, hi, key, print_, known = (table.column(c).to_pylist() for c in ("block", "lo", "hi", "key", "print", "known"))
        sets = list(ngram_sets(table.column("text").combine_chunks(), n))
        parts: dict[tuple[int, int, int], dict[tuple[int, int], int]] = {}
        for i, s in enumerate(sets):
            # Another text under the same key is not the one that was meant.
            if len(s) and fingerprint(s) == print_[i]:
                parts.setdefault((block[i], lo[i], hi[i]), {})[key[i], print_[i]] = i
        a, b = [], []
        for rows in parts.values():
            index = list(rows.values())
            if len(index) > 1:
                for x, y in linked_forest([sets[i] for i in index], percent, np.array([known[i] for i in index])):
                    a.append(key[index[x]])
                    b.append(key[index[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _parts(n_texts: str, members: str):
    return F.greatest(F.ceil(F.col(n_texts) / PART_TEXTS), F.ceil(F.col(members) / PART_MEMBERS)).cast("long")


def _all(n: str):
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def verified_components(candidates: DataFrame, texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """``node, component`` of the keys that links connect, over ``candidates`` (``block, key, print, weight``).

    ``texts`` (``key, text``) has a text for each key, perhaps several: that whose
    set of word n-grams has the fingerprint ``print`` counts; ``weight`` is about
    the size of the set. Links are looked for between all texts of a block.
    """
    sizes = candidates.groupBy("block").agg(F.count("*").alias("n_texts"), F.sum("weight").alias("members")).where("n_texts > 1")
    placed = scratch.keep(
        candidates.join(sizes, "block")
        .withColumn("n_parts", _parts("n_texts", "members"))
        .withColumn("part", F.expr("pmod(xxhash64(key, print), n_parts)"))
        .withColumn("pivot", F.expr(f"n_parts > 1 and pmod(xxhash64(key, print, 1), n_texts) < {PIVOTS}"))
        .select("block", "key", "print", "weight", "n_parts", "part", "pivot")
    )
    n_texts, members = placed.agg(F.count("*"), F.sum("weight")).first()
    units = max(1, n_texts // PART_TEXTS, (members or 0) // PART_MEMBERS)
    # Candidates grow with the input: they are merged, never broadcast, at every size.
    fetched = lambda rows: texts.join(rows.hint("merge"), "key")
    verify = lambda rows: rows.select("unit", "block", "lo", "hi", "key", "print", "known", "text").groupBy("unit").applyInArrow(_verify(n, percent), "a long, b long")
    unit = F.when(F.col("n_parts") == 1, F.expr(f"pmod(xxhash64(block), {units})")).otherwise(F.xxhash64("block", "lo"))
    lo = F.explode(F.when(F.col("pivot"), _all("n_parts")).otherwise(F.array("part")))
    first = fetched(placed.withColumn("known", F.col("key"))).withColumn("lo", lo).withColumn("hi", F.col("lo")).withColumn("unit", unit)
    reached = connected_components(verify(first), scratch)

    # Of blocks in several parts: what is not in the largest component so far.
    known = F.coalesce("component", "key")
    parted = scratch.keep(placed.where("n_parts > 1").join(reached.hint("merge"), F.col("key") == F.col("node"), "left").withColumn("known", known).drop("node", "component", "pivot"))
    of_block = parted.groupBy("block", "known").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    rest = parted.join(of_block, "block").where("known != main").drop("main")
    rest_parts = rest.groupBy("block").agg(F.count("*").alias("n_rest"), F.sum("weight").alias("rest_members")).select("block", _parts("n_rest", "rest_members").alias("n_rest_parts"))
    if rest_parts.isEmpty():
        return reached
    left = rest.join(rest_parts, "block").withColumn("lo", F.expr("pmod(xxhash64(key, print, 2), n_rest_parts)")).withColumn("to", _all("n_parts"))
    right = parted.join(rest_parts, "block").withColumn("hi", F.col("part")).withColumn("to", _all("n_rest_parts"))
    second = fetched(left.select("block", "key", "print", "known", "lo", F.lit(None).cast("long").alias("hi"), "to").union(right.select("block", "key", "print", "known", F.lit(None).cast("long"), "hi", "to")))
    dealt = second.withColumn("other", F.explode("to")).withColumn("lo", F.coalesce("lo", "other")).withColumn("hi", F.coalesce("hi", "other")).withColumn("unit", F.xxhash64("block", "lo", "hi"))
    return connected_components(verify(dealt).union(reached.select("node", "component")), scratch)
