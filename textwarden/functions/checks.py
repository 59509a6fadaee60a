"""Checksums of identifiers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(text: Column) -> Column:
    """Only the ASCII digits of a text."""
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(text: Column, place: int) -> Column:
    """The digit at a place from 1."""
    return F.substring(text, place, 1).cast("int")


def luhn(number: Column) -> Column:
    """Whether the digits of a number pass the Luhn check; null without digits."""
    digits = digits_of(number)
    marks = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.expr("0") + F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.when(digits != "", F.aggregate(marks, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97(account: Column) -> Column:
    """The remainder modulo 97 of an account number with its first four characters moved to the end."""
    plain = F.upper(F.regexp_replace(account, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))
    characters = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(0), lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97))


def national_check(number: Column) -> Column:
    """Whether eleven digits are a national id: first not 0, the tenth and eleventh are check digits."""
    d = digits_of(number)
    odd = sum((_digit(d, i) for i in (1, 3, 5, 7, 9)), F.lit(0))
    even = sum((_digit(d, i) for i in (2, 4, 6, 8)), F.lit(0))
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == _digit(d, 10)
    eleventh = (odd + even + _digit(d, 10)) % 10 == _digit(d, 11)
    return F.when(F.length(d) == 11, (_digit(d, 1) != 0) & tenth & eleventh).otherwise(False)


def tax_check(number: Column) -> Column:
    """Whether ten digits, not all the same, end in the check digit of a tax number."""
    d = digits_of(number)
    total = F.lit(0)
    for i in range(1, 10):
        total = total + ((_digit(d, i) + (10 - i)) % 10 * (1 << (10 - i))) % 9
    same = F.regexp_replace(d, "^(.)\\1*$", "") == ""
    return F.when((F.length(d) == 10) & ~same, (10 - total % 10) % 10 == _digit(d, 10)).otherwise(False)


def is_json(text: Column) -> Column:
    """Whether a text is one whole JSON value, with nothing behind it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
