"""Mixing sources to target weights by a low-discrepancy schedule of slots.

Each source is a line of words: its documents in shuffled order, cut into blocks
of equally many words. Van der Corput points, mapped through the cumulative
slot counts of the sources, give a schedule in which every stretch holds each
source in about its share; the r-th slot of a source takes its r-th block, and
starts over at the end of the line. All of it is DataFrame expressions.

Defined cases: a null text has no words; null sources are one source of their
own, ordered last; documents without words take part with nothing taken;
repeated rows and repeated ids are rows of their own; an empty table gives an
empty mix; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.scratch import Scratch
from textwarden.llm.tables import word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of input, and the most a source may be repeated.
SHARE, MOST = 1.5, 2
#: Words in a block at most, slots in a small mix, slots of a source that one row is unfolded to.
BLOCK_WORDS, SLOTS, UNFOLDED = 1024, 65536, 65536


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: ``source, source_size, weight, target``.

    ``share`` of all words is dealt by weight; a source stops at ``most`` times
    its own size and what is above goes to the others by weight. In the order
    of size for each weight, the capped sources come first, so running sums
    find the level at which the rest is dealt.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "source_no")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    table = (
        totals.withColumn("source_no", F.row_number().over(ordered))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("need", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
    )
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_level = F.when(F.col("level") < F.col("need"), F.col("level"))
    return (
        table.withColumn("deal", F.first(open_level, ignorenulls=True).over(everything))
        .withColumn("target", F.when(F.col("deal").isNull() | (F.col("need") <= F.col("deal")), F.col("cap")).otherwise(F.col("deal") * F.col("weight")))
        .select("source_no", "source", "source_size", "n_docs", "weight", "all_words", "target")
    )


def schedule(sources: DataFrame, bits: int) -> DataFrame:
    """Slots of the mix: ``slot, source_no, rank, slot_start, slot_end`` on the line of the source.

    ``sources`` needs ``source_no, first_slot, n_slots, block_words, line_words``.
    The sources' slots stand one behind the other at places 0, 1, 2 and so on; the
    place whose bits are those of ``i`` reversed is the van der Corput point of
    slot ``i``, so each source has exactly its number of slots, evenly spread.
    """
    last = F.col("first_slot") + F.col("n_slots") - 1
    places = (
        sources.where("n_slots > 0")
        .withColumn("from", F.explode(F.expr(f"sequence(first_slot, first_slot + n_slots - 1, {UNFOLDED}L)")))
        .withColumn("place", F.explode(F.sequence("from", F.least(F.col("from") + (UNFOLDED - 1), last))))
    )
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("place"), bits, "0")), 2, 10).cast("long") if bits else F.col("place")
    stretch = 1 << ((bits + 1) // 2)
    dealt = places.select("source_no", "block_words", "line_words", reversed_bits.alias("slot")).withColumn("part", F.floor(F.col("slot") / stretch))
    # Ranks in two steps, so that no task orders all slots of one source.
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("source_no", "part").agg(F.count("*").alias("n")).select("source_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    inside = Window.partitionBy("source_no", "part").orderBy("slot")
    return (
        dealt.withColumn("place_in_part", F.row_number().over(inside) - 1)
        .join(parts.hint("merge"), ["source_no", "part"])
        .withColumn("rank", F.col("ranked_before") + F.col("place_in_part"))
        .withColumn("slot_start", F.col("rank") * F.col("block_words"))
        .withColumn("slot_end", F.least(F.col("slot_start") + F.col("block_words"), F.col("line_words")))
        .select("slot", "source_no", "rank", "slot_start", "slot_end")
    )


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row a document: ``doc_id, source, size, source_size, target, taken, first_slot, slots``.

    ``taken`` is the number of its words that the slots of the schedule take,
    repeats counted; ``first_slot`` the first slot that takes any (null if none
    does), ``slots`` the first of each time that the document comes up.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.keep(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = (
        source_targets(sized, weights, share, most)
        .withColumn("line_words", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size")))
        .withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(share * F.col("all_words") / SLOTS))).cast("long"))
        .withColumn("n_slots", F.ceil(F.col("line_words") / F.col("block_words")))
    )
    slots_before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = scratch.keep(targets.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(slots_before), F.lit(0))))
    totals = sources.agg(F.sum("n_slots"), F.sum("n_docs")).first()
    points, n_docs = int(totals[0] or 0), int(totals[1] or 0)
    slots = schedule(sources, max(0, points - 1).bit_length())

    # The shuffled line of each source, its running sums in two steps of about the root of all rows.
    n_parts = max(1, round(n_docs**0.5))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = (
        sized.join(sources.select(F.col("source").alias("of"), "source_no", "source_size", "target", "line_words", "block_words"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("shuffled", order)
        .withColumn("part", F.shiftright(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * n_parts, 32))
    )
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("n")).select("source_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("words_before"))
    inside = Window.partitionBy("source_no", "part").orderBy("shuffled", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = (
        placed.withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(parts.hint("merge"), ["source_no", "part"])
        .withColumn("at", F.col("words_before") + F.col("in_part"))
        .drop("part", "in_part", "words_before", "shuffled")
    )

    # Each document stands on the line once a round; a round's stretch of it may fall in several blocks.
    rounds = F.array(*[F.lit(k) for k in range(most)])
    stretches = (
        line.where("size > 0")
        .withColumn("round", F.explode(rounds))
        .withColumn("start", F.col("at") + F.col("round") * F.col("source_size"))
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("line_words")))
        .withColumn("rank", F.explode_outer(F.when(F.col("start") < F.col("end"), F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("end") - 1) / F.col("block_words"))))))
    )
    overlap = F.when(F.col("slot").isNotNull(), F.least("end", "slot_end") - F.greatest("start", "slot_start"))
    document = ["source_no", "at", "doc_id", "source", "size", "source_size", "target"]
    # Slots and stretches grow with the input: they are merged, never broadcast, at every size.
    taken = (
        stretches.join(slots.hint("merge"), ["source_no", "rank"], "left")
        .groupBy(*document, "round")
        .agg(F.coalesce(F.sum(overlap), F.lit(0)).alias("taken"), F.min("slot").alias("slot"))
        .groupBy(*document)
        .agg(F.sum("taken").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.array_sort(F.collect_list("slot")).alias("slots"))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "slots"]
    wordless = line.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long")).withColumn("slots", F.expr("cast(array() as array<bigint>)"))
    return taken.select(columns).unionByName(wordless.select(columns))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as documents, in the order of the schedule: each as often as it was taken, with its own columns.

    A document that is taken in part counts to the nearest whole number, half up;
    each of its copies stands at the slot that takes it. Rows of one doc_id are
    taken in the order of their hashes.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    plan = mix_sources(documents).groupBy("doc_id").agg(F.sum(whole).alias("__copies"), F.count("*").alias("__n_rows"), F.array_sort(F.flatten(F.collect_list("slots"))).alias("__slots"))
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source"))
    # Both sides grow with the input: they are merged, never broadcast, at every size.
    numbered = documents.withColumn("__row", F.row_number().over(same)).join(plan.withColumnRenamed("doc_id", "__of").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__of")))
    turns = F.when(F.col("__row") <= F.col("__copies"), F.sequence(F.col("__row").cast("long"), F.col("__copies"), F.col("__n_rows")))
    copies = numbered.withColumn("__turn", F.explode(turns)).withColumn("__slot", F.coalesce(F.try_element_at("__slots", F.col("__turn").cast("int")), F.element_at("__slots", -1)))
    return copies.orderBy("__slot", "doc_id", "__turn").select(*[documents[c] for c in documents.columns])
