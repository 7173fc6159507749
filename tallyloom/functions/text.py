"""Text expressions.  Blank space is always the explicit ASCII class, so that engines agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \\t\\n\\r\\f\\x0B"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row, also where lambdas within ``use`` refer to it: a lambda over an array of one names it."""
    return F.get(F.transform(F.array(value), use), 0)


def tok(x: Column) -> Column:
    """Words between blanks; none for an empty or blank text."""
    return F.array_remove(F.split(x, f"[{BLANKS}]+"), "")


def n_words(x: Column) -> Column:
    return F.size(tok(x))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def collapse(x: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(tok(x), " ")


def clean_text(x: Column) -> Column:
    """Blanks to one space, then non-ASCII runs to a space, then links dropped, then stripped."""
    x = F.regexp_replace(x, f"[{BLANKS}]+", " ")
    x = F.regexp_replace(x, "[^\\x00-\\x7F]+", " ")
    return strip(F.regexp_replace(x, f"http[^{BLANKS}]+", ""))


def clean_lines(x: Column) -> Column:
    """As clean_text, but lines stay."""
    x = F.regexp_replace(x, "[^\\x00-\\x7F\\n]+", " ")
    return strip(F.regexp_replace(x, f"http[^{BLANKS}]+", ""))


def first_words(x: Column, n: int = 400) -> Column:
    return F.array_join(F.slice(tok(x), 1, n), " ")


def fold_case(x: Column) -> Column:
    """Lower case with single spaces: the form rules are matched on."""
    return collapse(F.lower(x))


def fold_marks(x: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks to spaces, single spaces."""
    return collapse(F.regexp_replace(F.lower(x), f"[^a-z0-9{BLANKS}]", " "))


def any_of(x: Column, terms: list[str]) -> Column:
    """Whether any term is a substring: plain searches, which stop at the first hit."""
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in terms])


def starts_with_any(x: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in prefixes])


def quoted(term: str) -> str:
    """A term as a pattern that Java and RE2 read alike."""
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$/-" else c for c in term)


def count_of(x: Column, terms: list[str]) -> Column:
    """How many of the terms are substrings; a repeated term counts again."""
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(x, F.lit(t)).cast("int")
    return total


def word_chunks(x: Column, size: int = 300) -> Column:
    """Non-overlapping chunks of ``size`` words, the last may be shorter; none for a blank text."""

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))

    return bound(tok(x), cut)


def char_prefix(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
