"""64-bit words of sparse bitmaps: an id is bit ``id % 64`` of page ``id div 64``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest id of a bitmap: the last bit of page 2 ** 32 - 1.
MAX_ID = 64 * (2**32 - 1) + 63


def page(id_: Column) -> Column:
    return F.shiftright(id_.cast("bigint"), 6)


def mask(id_: Column) -> Column:
    """The word with only this id's bit."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), id_.bitwiseAND(F.lit(63)).cast("int"))


def checked(id_: Column) -> Column:
    """The id; an error if it is negative or beyond MAX_ID."""
    bad = (id_ < 0) | (id_ > F.lit(MAX_ID))
    return F.when(bad, F.raise_error(F.concat(F.lit("bit index out of range: "), id_.cast("string"))).cast("bigint")).otherwise(id_.cast("bigint"))


def word_set(bits: Column, id_: Column) -> Column:
    return bits.bitwiseOR(mask(id_))


def word_clear(bits: Column, id_: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(mask(id_)))


def word_contains(bits: Column, id_: Column) -> Column:
    return F.getbit(bits, id_.bitwiseAND(F.lit(63)).cast("int")) == 1


def word_logical(left: Column, right: Column, how: Callable[[Column, Column], Column]) -> Column:
    """Two words of one page by any function of words, such as Column.bitwiseXOR."""
    return how(left, right)


def ids(page_: Column, bits: Column) -> Column:
    """Ascending ids of a word."""
    every = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.transform(every, lambda i: page_ * 64 + i.cast("bigint"))
