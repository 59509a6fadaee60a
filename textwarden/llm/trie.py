"""Prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

Rebuilt conversations are rows of turn digests and character counts; texts stay where they
are read. They are sorted by their digests over all tasks, so that conversations with a
common prefix stand together. Two neighbours are an edge as deep as their common prefix.
In each task the edges are united in descending depth: the components that an edge of depth
d joins become the children of one branching node of depth d. A component that touches
neither end of the task's stretch is settled. What touches an end can still grow: it is
contracted to the chain of open nodes along that end, at most two a depth. The chains of
neighbouring tasks are united in the same way, some tens at a time, until one is left. A
settled component is one row with the depths it spans, and Spark unfolds it to nodes.

All counts of a node follow from sums over its component: with P(d) the characters of the
first d turns, the tokens that a subtree saves are the sum of P over the edges inside it,
less P above the node for all members but one.

Members that end at a node are equal conversations and stand together; the hash over their
ids is taken where they are read, or, for runs that cross tasks or are long, from blocks of
ids in order, streamed. One hash over one list is a sequence by its nature: its task
reads the list once and holds one block.

Defined cases: rows without a conv_id belong to no conversation; equal turns of one
conversation are ordered by role, then by the digest of the turn, so repeated rows stay and
any order of them is the same; null roles and texts are empty; an empty table has no node,
not even a root; a conversation travels as 24 bytes a turn; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch

#: Bytes of a turn's digest in a sort key.
DIGEST = 16
#: Turns that a task sorts and unites at once, and chains that are united in one task.
TURNS_A_TASK = 500_000
CHAINS_A_TASK = 64
#: Ids in a block of a run that is hashed from blocks.
RUN_BLOCK = 8192
#: First turns that conversations of a hundred share, and the conversations of a group (fixed values).
MOST_SHARED, GROUP = 6, 100
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

#: One row a settled component (kind 0), an open node of a chain (1), a block of ids (2), or an open node's successor (3).
ROWS = (
    "kind int, chain long, place long, least long, depth long, n long, leaves long, edge_chars long, kids long, ended boolean, ends string, run binary, "
    "parent_depth long, parent long, parent_ref string, prefix_chars array<long>, edge long, key binary, ref string, block long, ids string"
)
_LONGS, _TEXTS, _BYTES = ("kind", "chain", "place", "least", "depth", "n", "leaves", "edge_chars", "kids", "parent_depth", "parent", "edge", "block"), ("ends", "parent_ref", "ref", "ids"), ("run", "key")
_ORDER = [x.split()[0] for x in ROWS.split(", ")]


def turn_digest() -> Column:
    """Digest of role and text; the length of the role keeps the two apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, chars``: the digests of each rebuilt conversation in one, and the code points of each turn.

    The first h turns come from the conversation that begins the group of a hundred,
    those after them are the conversation's own, with h drawn from the id.
    """
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn").isNotNull().alias("timed"),
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            turn_digest().alias("digest"),
            F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
        ).alias("turn"),
    )
    ordered = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("sorted"))
    ordered = ordered.select("conv_id", F.transform("sorted", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))
    heads = ordered.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED - 1).alias("head"))
    drawn = ordered.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")})
    joined = drawn.join(heads, "base", "left")
    none = F.expr("cast(array() as array<struct<digest:string,chars:int>>)")
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"].cast("long")).alias("chars")
    )


class Part:
    """A component: the conversations below one node, so far."""

    __slots__ = ("chars", "depth", "edge_chars", "ended", "ends", "into", "key", "kid_leaves", "kids", "least", "n", "ref", "run")

    def __init__(self, depth: int, least: int, n: int, chars: np.ndarray | None):
        self.depth, self.least, self.n, self.chars = depth, least, n, chars
        self.kids = self.kid_leaves = self.edge_chars = 0
        # Whether members end at this depth; the hash over their ids, or the key of the run that has it.
        self.ended, self.ends, self.run = False, None, None
        self.key = self.ref = self.into = None

    @property
    def leaves(self) -> int:
        return self.kid_leaves if self.kids else 1

    def last(self) -> Part:
        part = self
        while part.into is not None:
            part = part.into
        return part


def common_prefix(a: bytes, b: bytes) -> int:
    """How many whole digests two keys share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


class Union:
    """Unites a stretch of parts along its edges in descending depth; the outer ends may stay open."""

    def __init__(self, new_ref: Callable[[], str]):
        self.new_ref = new_ref
        self.closed: list[tuple[Part, int, Part]] = []

    def _adopt(self, node: Part, part: Part) -> None:
        """``part`` is a child of ``node``."""
        node.kids += 1
        node.kid_leaves += part.leaves
        node.n += part.n
        node.least = min(node.least, part.least)
        node.edge_chars += part.edge_chars
        self.closed.append((part, node.depth, node))

    def _absorb(self, node: Part, part: Part) -> None:
        """``part`` is the same node as ``node``, seen from another side."""
        node.kids += part.kids
        node.kid_leaves += part.kid_leaves
        node.n += part.n
        node.least = min(node.least, part.least)
        node.edge_chars += part.edge_chars
        if part.ended:
            node.ended, node.ends, node.run = True, part.ends, part.run
        part.into = node

    def _into_node(self, depth: int, part: Part) -> Part:
        if part.depth == depth:
            return part
        node = Part(depth, part.least, 0, part.chars)
        self._adopt(node, part)
        return node

    def _join(self, depth: int, a: Part, b: Part) -> Part:
        node = self._into_node(depth, a)
        if b.depth == depth:
            self._absorb(node, b)
        else:
            self._adopt(node, b)
        node.edge_chars += int(node.chars[depth])
        return node

    def run(self, parts: list[Part], edges: list[int], open_ends: bool) -> tuple[list[Part], list[int]]:
        """The chain that stays open, with its edges; without open ends it is the one component of all."""
        up = list(range(len(parts)))
        # The component of a stretch stands at its first place. Those that touch an open end are chains.
        found: list[Part | None] = list(parts)
        last = len(parts) - 1
        left: tuple[list[Part], list[int]] = ([parts[0]], [])
        right: tuple[list[Part], list[int]] = ([parts[last]], [])
        right_from = last

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for e in sorted(range(last), key=lambda i: -edges[i]):
            depth, a, b = edges[e], root(e), root(e + 1)
            up[b] = a
            at_left, at_right = open_ends and a == 0, open_ends and b == right_from
            if not at_left and not at_right:
                found[a] = self._join(depth, found[a], found[b])
                continue
            if at_left and at_right:
                return left[0] + right[0][::-1], left[1] + [depth] + right[1][::-1]
            chain, edge_list = left if at_left else right
            inner = found[b] if at_left else found[a]
            if at_right:
                right_from = a
            node = chain[-1] if len(chain) > 1 and edge_list[-1] == depth and chain[-1].depth == depth else None
            if node is None:
                node = self._into_node(depth, inner)
                if node.ref is None:
                    node.ref = self.new_ref()
                chain.append(node)
                edge_list.append(depth)
            elif inner.depth == depth:
                self._absorb(node, inner)
                node.edge_chars += int(node.chars[depth])
            else:
                self._adopt(node, inner)
                node.edge_chars += int(node.chars[depth])
        return ([found[0]], []) if not open_ends else left

    def settle(self, part: Part) -> None:
        """``part`` is the whole trie."""
        self.closed.append((part, -1, None))


class Rows:
    """Output rows, handed on in batches."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {c: [] for c in _ORDER}

    def add(self, **values) -> None:
        for c, column in self.columns.items():
            column.append(values.get(c))

    def __len__(self) -> int:
        return len(self.columns["kind"])

    def batch(self) -> pa.RecordBatch:
        kinds = {c: pa.int64() for c in _LONGS} | {c: pa.string() for c in _TEXTS} | {c: pa.binary() for c in _BYTES} | {"ended": pa.bool_(), "prefix_chars": pa.list_(pa.int64()), "kind": pa.int32()}
        made = pa.RecordBatch.from_arrays([pa.array(self.columns[c], kinds[c]) for c in _ORDER], _ORDER)
        self.__init__()
        return made


def _closed_rows(rows: Rows, union: Union, open_parts: set[int]) -> Iterator[pa.RecordBatch]:
    for part, parent_depth, parent in union.closed:
        top = parent.last() if parent is not None else None
        ref = top.ref if top is not None and id(top) in open_parts else None
        # What a node saves is counted down to the turns above it: P at each depth less one.
        above = part.chars[max(parent_depth, 0) : part.depth]
        rows.add(
            kind=0, least=part.least, depth=part.depth, n=part.n, leaves=part.leaves, edge_chars=part.edge_chars, kids=part.kids, ended=part.ended, ends=part.ends, run=part.run,
            parent_depth=parent_depth, parent=None if top is None or ref else top.least, parent_ref=ref, prefix_chars=([0] if parent_depth < 0 else []) + above.tolist(),
        )
        if len(rows) >= 10_000:
            yield rows.batch()


def _chain_rows(rows: Rows, chain: int, parts: list[Part], edges: list[int]) -> None:
    for place, part in enumerate(parts):
        outer = place in (0, len(parts) - 1)
        rows.add(
            kind=1, chain=chain, place=place, least=part.least, depth=part.depth, n=part.n, leaves=part.kid_leaves, edge_chars=part.edge_chars, kids=part.kids, ended=part.ended, ends=part.ends,
            run=part.run, prefix_chars=part.chars.tolist() if outer else None, edge=edges[place - 1] if place else None, key=part.key if outer else None, ref=part.ref,
        )


class Runs:
    """Equal neighbours as one part each, with the hash over their ids."""

    def __init__(self, chain: int, rows: Rows):
        self.chain, self.rows = chain, rows
        self.parts: list[Part] = []
        self.key: bytes | None = None
        self.ids: list[int] = []
        self.n = self.block = 0

    def add(self, key: bytes, conv_id: int, chars) -> None:
        if key != self.key:
            self._end(boundary=not self.parts or len(self.parts) == 1)
            total = np.zeros(len(key) // DIGEST + 1, np.int64)
            np.cumsum(chars, out=total[1:])
            part = Part(len(key) // DIGEST, conv_id, 0, total)
            part.key, part.ended = key, True
            self.parts.append(part)
            self.key, self.ids, self.n, self.block = key, [], 0, 0
        self.ids.append(conv_id)
        self.n += 1
        if len(self.ids) == RUN_BLOCK:
            self._block()

    def _name(self) -> bytes:
        return hashlib.sha256(self.key).digest()

    def _block(self) -> None:
        self.rows.add(kind=2, chain=self.chain, block=self.block, run=self._name(), ids=",".join(map(str, self.ids)))
        self.ids, self.block = [], self.block + 1

    def _end(self, boundary: bool) -> None:
        if not self.parts:
            return
        part = self.parts[-1]
        part.n = self.n
        part.edge_chars = (self.n - 1) * int(part.chars[-1])
        if boundary or self.block:
            if self.ids:
                self._block()
            part.run = self._name()
        else:
            part.ends = hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest()

    def finish(self) -> list[Part]:
        self._end(boundary=True)
        return self.parts


def _refs(name: str) -> Callable[[], str]:
    count = iter(range(2**62))
    return lambda: f"{name}:{next(count)}"


def _unite_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted conversations of one task: settled components, the open chain, and blocks of ids."""
    rows, runs, chain = Rows(), None, -1
    for batch in batches:
        for chain, key, conv_id, chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if runs is None:
                runs = Runs(chain, rows)
            runs.add(key, conv_id, chars)
        if len(rows) >= 100:
            yield rows.batch()
    if runs is None:
        return
    parts = runs.finish()
    edges = [common_prefix(a.key, b.key) for a, b in zip(parts, parts[1:], strict=False)]
    yield from _united(rows, parts, edges, chain, _refs(f"0.{chain}"), final=False)


def _united(rows: Rows, parts: list[Part], edges: list[int], chain: int, new_ref: Callable[[], str], final: bool) -> Iterator[pa.RecordBatch]:
    came = [p for p in parts if p.ref is not None]
    union = Union(new_ref)
    kept, kept_edges = union.run(parts, edges, open_ends=not final)
    if final:
        union.settle(kept[0])
        kept, kept_edges = [], []
    open_parts = {id(p) for p in kept}
    # Nodes that came open and are settled now, or are one with another open node, name their successor.
    for part in came:
        top = part.last()
        if id(top) not in open_parts:
            rows.add(kind=3, ref=part.ref, parent=top.least)
        elif top is not part:
            rows.add(kind=3, ref=part.ref, parent_ref=top.ref)
    yield from _closed_rows(rows, union, open_parts)
    _chain_rows(rows, chain, kept, kept_edges)
    if len(rows):
        yield rows.batch()


def _unite_chains(level: int, final: bool):
    def unite(key: tuple, table: pa.Table) -> pa.Table:
        """The chains of one group, in their order."""
        chain, rows = key[0].as_py(), Rows()
        parts: list[Part] = []
        edges: list[int] = []
        before = None
        for x in table.sort_by([("chain", "ascending"), ("place", "ascending")]).to_pylist():
            part = Part(x["depth"], x["least"], x["n"], None)
            part.kid_leaves, part.edge_chars, part.kids, part.ended, part.ends, part.run, part.ref = x["leaves"], x["edge_chars"], x["kids"], x["ended"], x["ends"], x["run"], x["ref"]
            if x["prefix_chars"] is not None:
                part.chars, part.key = np.array(x["prefix_chars"], np.int64), x["key"]
            if parts:
                edges.append(common_prefix(before, part.key) if x["edge"] is None else x["edge"])
            if part.key is not None:
                before = part.key
            parts.append(part)
        _lend_chars(parts, edges)
        batches = list(_united(rows, parts, edges, chain, _refs(f"{level}.{chain}"), final))
        return pa.Table.from_batches(batches, batches[0].schema) if batches else Rows().batch().to_table()

    return unite


def _lend_chars(parts: list[Part], edges: list[int]) -> None:
    """Open nodes inside a chain share the prefix of the end of their chain that they hang from."""
    for order in (range(1, len(parts)), range(len(parts) - 2, -1, -1)):
        step = order.step
        for i in order:
            part, near, edge = parts[i], parts[i - step], edges[min(i, i - step)]
            if part.chars is None and near.chars is not None and edge >= part.depth and len(near.chars) > part.depth:
                part.chars = near.chars


def nodes(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations; the columns are those of the query."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    whole = scratch.keep(rebuilt(conversations))
    n_turns = whole.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    tasks = max(1, -(-n_turns // TURNS_A_TASK))
    ranged = whole.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    united = scratch.keep(ranged.select(F.spark_partition_id().cast("long").alias("chain"), "key", "conv_id", "chars").mapInArrow(_unite_sorted, ROWS))
    levels = [united]
    chains = united.where("kind = 1").select("chain").distinct().count()
    while chains:
        # The last chain is united once more with itself, with its ends closed.
        final = chains <= CHAINS_A_TASK
        open_rows = levels[-1].where("kind = 1").withColumn("group", F.lit(0).cast("long") if final else F.floor(F.col("chain") / CHAINS_A_TASK))
        made = open_rows.groupBy("group").applyInArrow(_unite_chains(len(levels), final), ROWS)
        levels.append(scratch.keep(made))
        chains = 0 if final else levels[-1].where("kind = 1").select("chain").distinct().count()
    # Successors of the last level are settled; those of the levels before lead to them.
    successor = None
    for level in reversed(levels):
        named = level.where("kind = 3").select("ref", "parent", "parent_ref")
        if successor is None:
            successor = named.select("ref", F.col("parent").alias("least"))
        else:
            later = successor.select(F.col("ref").alias("parent_ref"), "least")
            successor = successor.union(named.join(later, "parent_ref", "left").select("ref", F.coalesce("parent", "least")))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.union(level)
    hashed = rows.where("kind = 2").select("run", "chain", "block", "ids").repartition("run").sortWithinPartitions("run", "chain", "block").mapInArrow(_hash_runs, "run binary, run_ends string")
    closed = _joined_where_set(rows.where("kind = 0"), hashed, "run", "run_ends")
    return _unfolded(_joined_where_set(closed, successor.select(F.col("ref").alias("parent_ref"), F.col("least").alias("ref_least")), "parent_ref", "ref_least"))


def _joined_where_set(rows: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """A left join that leaves rows without the key where they are."""
    without = rows.where(F.col(key).isNull()).withColumn(value, F.lit(None).cast(other.schema[value].dataType))
    return without.unionByName(rows.where(F.col(key).isNotNull()).join(other, key, "left"))


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash over the ids of each run, block after block."""
    run, hasher = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if name != run:
                if run is not None:
                    done.append((run, hasher.hexdigest()))
                run, hasher = name, hashlib.sha256(ids.encode())
            else:
                hasher.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"run": pa.array([r for r, _ in done], pa.binary()), "run_ends": [h for _, h in done]})
    if run is not None:
        yield pa.RecordBatch.from_pydict({"run": pa.array([run], pa.binary()), "run_ends": [hasher.hexdigest()]})


def _unfolded(closed: DataFrame) -> DataFrame:
    """A component from just below its parent's depth to its own, a node a depth."""
    at = closed.select("*", F.posexplode("prefix_chars").alias("step", "above"))
    depth = F.col("parent_depth") + 1 + F.col("step")
    lowest, deepest = F.col("step") == 0, depth == F.col("depth")
    return at.select(
        F.col("least").alias("conv_id"),
        depth.alias("depth"),
        F.when(~lowest, F.col("least")).otherwise(F.coalesce("parent", "ref_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(deepest, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("edge_chars") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"),
        F.when(deepest & F.col("ended"), F.coalesce("ends", "run_ends")).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
