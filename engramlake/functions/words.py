"""Arrays of words: their ends, what stands before and behind, and where one fits first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(word: Column, words: tuple[str, ...]) -> Column:
    return word.isin(*words) if words else F.lit(False)


def after(w: Column, n: Column | int) -> Column:
    """The words behind the first ``n``."""
    return F.slice(w, F.lit(1) + n, F.greatest(F.size(w) - n, F.lit(0)))


def before(w: Column, n: Column | int) -> Column:
    """The words without the last ``n``."""
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - n, F.lit(0)))


def joined(w: Column) -> Column:
    return F.array_join(w, " ")


def ends(w: Column, *words: str) -> Column:
    return F.slice(w, F.greatest(F.size(w) - len(words) + 1, F.lit(1)), F.lit(len(words))) == F.array(*map(F.lit, words))


def begins(w: Column, *words: str) -> Column:
    return F.slice(w, F.lit(1), F.lit(len(words))) == F.array(*map(F.lit, words))


def first(w: Column, fits) -> Column:
    """The place of the first word that fits, from 0; null if there is none."""
    return F.get(F.filter(F.transform(w, lambda x, i: F.when(fits(x, i), i)), lambda i: i.isNotNull()), F.lit(0))


def word(w: Column, i: Column | int) -> Column:
    """The word at a place from 0; empty where there is none."""
    return F.coalesce(F.get(w, F.lit(i) if isinstance(i, int) else i), F.lit(""))


def between(w: Column, start: Column | int, end: Column) -> Column:
    """The words from one place up to another, which is not included."""
    return F.slice(w, F.lit(1) + start, F.greatest(end - start, F.lit(0)))


def follow(w: Column, i: Column | int, *choices: tuple[str, ...]) -> Column:
    """Whether words of these choices stand one after another from a place on."""
    found = F.lit(True)
    for k, c in enumerate(choices):
        found = found & word(w, i + k).isin(*c)
    return found
