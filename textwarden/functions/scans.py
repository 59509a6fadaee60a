"""Running totals over an array inside a row, in time linear in the array.

``aggregate`` that appends to an array copies it at each step. Here elements are
merged by blocks, the blocks' totals are scanned in the same way, and each element
adds what its block holds before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]

#: Elements of a block, and levels of blocks over blocks.
BLOCK = 64
LEVELS = 2


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, in lambdas too."""
    return F.transform(F.array(value), use)[0]


def indices(size: Column) -> Column:
    """0 to size - 1."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def scan(values: Column, zero: Column, merge: Merge, levels: int = LEVELS) -> Column:
    """For each element the merge of all that stand before it, ``zero`` for the first.

    ``merge`` must be associative, with ``zero`` as its neutral element, and give
    the type of ``zero``. A null array gives an empty one, like an empty one.
    """

    def over(whole: Column) -> Column:
        if levels == 0:
            return F.transform(indices(F.size(whole)), lambda i: F.aggregate(F.slice(whole, F.lit(1), i), zero, merge))
        blocks = F.transform(indices(F.ceil(F.size(whole) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)), zero, merge))
        return let(
            scan(blocks, zero, merge, levels - 1),
            lambda before: F.transform(
                indices(F.size(whole)), lambda i: F.aggregate(F.slice(whole, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), before[F.floor(i / BLOCK).cast("int")], merge)
            ),
        )

    return let(values, over)


def running_sums(values: Column) -> Column:
    """For each element of an array of integers the sum of those before it."""
    return scan(values, F.lit(0), lambda a, b: a + b)


#: Code points of a chunk of a text that is cut at many places.
CHUNK = 2048


def chunks(text: Column) -> Column:
    """A text in chunks of CHUNK code points, for ``between``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunked: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in chunks.

    ``substring`` counts from the start of its text each time, which makes many cuts of one
    long text quadratic; here a cut reads its first and last chunk.
    """
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    within = F.coalesce(F.substring(F.get(chunked, first), start % CHUNK + 1, end - start), F.lit(""))
    head = F.substring(F.get(chunked, first), start % CHUNK + 1, F.lit(CHUNK))
    whole = F.array_join(F.slice(chunked, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.coalesce(F.substring(F.get(chunked, last), F.lit(1), end % CHUNK), F.lit(""))
    return F.when(first == last, within).otherwise(F.concat(head, whole, tail))


def replaced(text: Column, spans: Column, name: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each of its spans (an array of structs with ``start`` and ``end``, ordered by both) replaced.

    ``name`` makes the replacement from the span and the text in chunks. Of spans that overlap, all
    characters go and the first gives the name. Linear in text and spans.
    """

    def put(chunked: Column) -> Column:
        def pieces(reach: Column) -> Column:
            def piece(span: Column, i: Column) -> Column:
                before = reach[i]
                return F.when(span["start"] >= before, F.concat(between(chunked, before, span["start"]), name(span, chunked))).otherwise("")

            return F.array_join(F.transform(spans, piece), "")

        furthest = lambda a, b: F.greatest(a, b)
        ends = F.transform(spans, lambda s: s["end"])
        tail = between(chunked, F.array_max(ends), F.length(text))
        return F.concat(let(scan(ends, F.lit(0), furthest), pieces), tail)

    return F.when(F.size(spans) > 0, let(chunks(text), put)).otherwise(text)
