"""Fill-in-the-middle form of documents, cut at token borders that a wavelet matrix finds.

A token is a run of A-Z and a-z, or one other character. Each byte of a batch of texts
gets one of eight classes, and a wavelet matrix over the classes answers how often a class
occurs before a place. Ranks of the classes that begin a token add up to the tokens before
a place, those of continuation bytes tell code points from bytes, and bisection over the
ranks finds where the k-th token ends, for all texts of a batch at once. Python gives three
numbers a text; texts are put together, hashed and taken apart again by Spark expressions,
without a shuffle.

Defined cases: a null text is empty; an empty text and one that holds a mark stay as they
are; a null id counts as empty in the draw; repeated rows are drawn alike, each is a row; a
very long text is cut whole, some 30 bytes of memory a byte; an empty table gives an empty
result; other columns stay, and columns named ``fim`` or ``n_tokens`` give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.wordhash import pieces, text_bytes

#: Marks of prefix, suffix and middle (fixed values); a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: In a hundred: texts that are cut, and of these the ones whose suffix comes first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20

# Classes of bytes. The first two begin no token.
IN_RUN, WITHIN_CHARACTER, RUN_START, DIGIT, SPACE, CONTROL, SIGN, BEYOND_ASCII = range(8)
_LEVELS = (2, 1, 0)


def _class_of_bytes() -> np.ndarray:
    table = np.full(256, SIGN, np.uint8)
    table[:0x20] = CONTROL
    table[0x7F] = CONTROL
    table[0x20] = SPACE
    table[0x30:0x3A] = DIGIT
    table[0x41:0x5B] = IN_RUN
    table[0x61:0x7B] = IN_RUN
    table[0x80:0xC0] = WITHIN_CHARACTER
    table[0xC0:] = BEYOND_ASCII
    return table


CLASS = _class_of_bytes()


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte; a run of letters begins anew where a text begins."""
    found = CLASS[data]
    letter = found == IN_RUN
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    starts[begin] = letter[begin]
    found[starts] = RUN_START
    return found


class BitRanks:
    """How many ones stand before a place, from one count and one word a 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int64)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of the symbols 0 to 7 in a sequence, three bit vectors in all."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, BitRanks, int]] = []
        for level in _LEVELS:
            bits = (symbols >> level) & 1
            set_bits = bits.astype(bool)
            zeros = int(len(bits) - set_bits.sum())
            self.levels.append((level, BitRanks(bits), zeros))
            symbols = np.concatenate([symbols[~set_bits], symbols[set_bits]])
        self.start = {symbol: int(self._descend(symbol, np.zeros(1, np.int64))[0]) for symbol in range(8)}

    def _descend(self, symbol: int, place: np.ndarray) -> np.ndarray:
        for level, ranks, zeros in self.levels:
            ones = ranks.ones(place)
            place = zeros + ones if symbol >> level & 1 else place - ones
        return place

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place."""
        return self._descend(symbol, place) - self.start[symbol]


class TokenBorders:
    """Token and code point counts of concatenated texts, and the places of cuts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.begin, self.end = offsets[:-1], offsets[1:]
        self.matrix = WaveletMatrix(classes(data, offsets))
        self.first = self.tokens_before(self.begin)
        self.n_tokens = self.tokens_before(self.end) - self.first

    def tokens_before(self, place: np.ndarray) -> np.ndarray:
        return place - self.matrix.rank(IN_RUN, place) - self.matrix.rank(WITHIN_CHARACTER, place)

    def code_points(self, place: np.ndarray) -> np.ndarray:
        """Code points from the start of each text to a place in it."""
        within = self.matrix.rank(WITHIN_CHARACTER, place) - self.matrix.rank(WITHIN_CHARACTER, self.begin)
        return place - self.begin - within

    def cut_after(self, k: np.ndarray) -> np.ndarray:
        """Where the first ``k`` tokens of each text end: the last place with no more than k token starts before it."""
        low, high = self.begin.copy(), self.end.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.tokens_before(middle) - self.first <= k
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


CUTS = "struct<n_tokens:bigint,prefix_chars:bigint,cut_chars:bigint>"
_CUTS = pa.struct([("n_tokens", pa.int64()), ("prefix_chars", pa.int64()), ("cut_chars", pa.int64())])


def find_cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Token count and code points before both cuts; the cuts are drawn modulo the count plus one, in either order."""
    data, offsets = text_bytes(text)
    draws = [np.asarray(x.fill_null(0)).astype(np.int64) for x in (one, other)]
    found = []
    for lo, hi in pieces(offsets):
        borders = TokenBorders(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        a, b = (x[lo:hi] % (borders.n_tokens + 1) for x in draws)
        cuts = [borders.code_points(borders.cut_after(k)) for k in (np.minimum(a, b), np.maximum(a, b))]
        found.append((borders.n_tokens, *cuts))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], fields=list(_CUTS))


def _cuts_udf():
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, one, other in batches:
            yield find_cuts(text, one, other)

    cuts.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(cuts, CUTS)


def draw(key: Column, number: int) -> Column:
    """The ``number``-th (from 0) 32-bit value drawn for a key: eight digits of the SHA-256 of ``1:`` and the key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens`` and ``fim``, a struct of form (plain, psm or spm), output, prefix_chars and middle_chars.

    Cuts, form and order of parts follow from the key alone, so a rerun gives the
    same output. ``prefix_chars`` and ``middle_chars`` count code points, null where
    the form is plain.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = documents.drop("fim", "n_tokens").withColumn("__cuts", _cuts_udf()(whole, draw(F.col(key), 0), draw(F.col(key), 1)))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (draw(F.col(key), 2) % 100 >= CUT_SHARE)
    form = F.when(plain, "plain").when(draw(F.col(key), 3) % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm")
    first, second = F.col("__cuts.prefix_chars").cast("int"), F.col("__cuts.cut_chars").cast("int")
    prefix, middle = F.substring(whole, F.lit(1), first), F.substring(whole, first + 1, second - first)
    suffix = F.substring(whole, second + 1, F.length(whole))
    output = (
        F.when(F.col("__form") == "plain", whole)
        .when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    length = lambda x: F.when(F.col("__form") != "plain", x.cast("long"))
    fim = F.struct(F.col("__form").alias("form"), output.alias("output"), length(first).alias("prefix_chars"), length(second - first).alias("middle_chars"))
    return cut.withColumn("__form", form).withColumns({"n_tokens": F.col("__cuts.n_tokens"), "fim": fim}).drop("__cuts", "__form")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of some form was made of; marks occur once each, so they alone tell the parts."""
    rest = F.substring(output, F.lit(4), F.length(output))
    # Of psm: prefix, suffix and middle; of spm: suffix, prefix and middle.
    between = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first, after = F.split_part(rest, between, F.lit(1)), F.split_part(rest, between, F.lit(2))
    second, middle = F.split_part(after, F.lit(MIDDLE), F.lit(1)), F.split_part(after, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def digest(documents: DataFrame) -> DataFrame:
    """One row a document: tokens, form, lengths, and the hashes of the output and of the text restored from it."""
    made = fill_in_middle(documents.select("doc_id", "text"))
    made = made.withColumn("__restored", restore(F.col("fim.output"), F.col("fim.form")))
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select(
        "doc_id", F.col("n_tokens").alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars", hashed("fim.output").alias("output_sha256"), hashed("__restored").alias("restored_sha256")
    )
