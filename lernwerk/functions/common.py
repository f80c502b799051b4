"""Small column helpers shared by the text and body functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# White space as Python's str methods see it; the (?U) flag makes \s cover Unicode.
WS = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    Catalyst inlines an expression used inside a lambda, so it would run once per array element.
    Binding it as the variable of a one-element ``transform`` keeps it at one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def words(c: Column) -> Column:
    """White-space separated words; empty text gives an empty array."""
    return F.filter(F.split(strip(c), rf"(?U){WS}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def squeeze(c: Column) -> Column:
    return F.array_join(words(c), " ")


#: Letters that ``upper`` turns into several, with the one capital letter they have; those without one stay.
SPREADING = "".join(x for x in map(chr, range(0x80, 0x10000)) if len(x.upper()) > 1)
CAPITALS = "".join("ẞ" if x == "ß" else x.title() if len(x.title()) == 1 else x for x in SPREADING)


def upper_first(c: Column) -> Column:
    """The first letter as a capital, one for one: ``ß`` becomes ``ẞ``, not ``SS``."""
    first = F.substring(c, 1, 1)
    capital = F.when(F.length(F.upper(first)) > 1, F.translate(first, SPREADING, CAPITALS)).otherwise(F.upper(first))
    return F.concat(capital, F.substring(c, 2, 2_000_000_000))
