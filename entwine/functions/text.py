"""Column functions for digits, blanks, heads of spans, masks and prompts."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that are no head of a span.
NO_HEAD = ".,;:!?।॥"
#: Places to fill in a masked text, and the sign between two frames.
MASKS = "[#@]MASK"
MID = " [MID] "


@lru_cache(maxsize=1)
def digit_table() -> tuple[str, str]:
    """Every decimal digit that isn't ASCII, and its value, from the character database."""
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Nd" and not c.isascii()]
    return "".join(every), "".join(str(unicodedata.decimal(c)) for c in every)


def digits_to_ascii(c: Column) -> Column:
    """A text with the digits of every script as 0-9."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, *digit_table())).otherwise(c)


def stripped(c: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def head_word(words: Column, start: Column, end: Column) -> Column:
    """The last word of a span that isn't part of NO_HEAD, in lower case; its last word if all are."""
    span = F.slice(words, start + 1, F.greatest(F.least(end, F.size(words) - 1) - start + 1, F.lit(0)))
    heads = F.filter(span, lambda t: F.instr(F.lit(NO_HEAD), t) == 0)
    return F.lower(F.coalesce(F.try_element_at(heads, F.lit(-1)), F.get(words, F.least(end, F.size(words) - 1)), F.lit("")))


def mask_count(masked: Column) -> Column:
    """Places to fill; splitting keeps empty pieces at the end."""
    return F.size(F.split(masked, MASKS)) - 1


def fill_masks(masked: Column, numbers: Column) -> Column:
    """The masked text with `#n` in each place, overt or zero; a text without places as it is.

    Numbers that are missing are filled as their ordinal, as prediction does.
    """
    pieces = F.split(masked, MASKS)
    tail = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    filled = F.transform(tail, lambda p, i: F.concat(F.lit("#"), F.coalesce(F.get(numbers, i), i).cast("string"), p))
    return F.when(F.size(pieces) < 2, masked).otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(filled, "")))


def clamped(digits: Column, largest: int = 200) -> Column:
    """The number that a decoded text begins with, at most `largest`; 0 if it begins with none."""
    number = F.regexp_extract(digits_to_ascii(digits), r"^[0-9]+", 0)
    # more digits than an INT holds are over the largest anyway
    value = F.when(F.length(number) > 9, F.lit(largest)).otherwise(F.least(number.try_cast("int"), F.lit(largest)))
    return F.when(F.length(number) > 0, value).otherwise(F.lit(0))


def last_tokens(tokens: Column, n: int) -> Column:
    """Left truncation: the last n of an array."""
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
