"""Functions of token arrays (array<struct<idx, start, end, raw, norm>>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's white space.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def texts(tokens: Column, normalized: bool = True) -> Column:
    """The tokens' strings."""
    return F.transform(tokens, lambda t: t["norm" if normalized else "raw"])


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def joined(tokens: Column, normalized: bool = True) -> Column:
    """The tokens as one text, with a space where the text had a gap between two tokens."""
    return F.when(F.size(tokens) == 0, F.lit("")).otherwise(_stripped(F.array_join(_pieces(tokens, normalized), "")))


def _pieces(tokens: Column, normalized: bool) -> Column:
    """The tokens' strings, after a space where the text had a gap."""
    field = "norm" if normalized else "raw"
    previous = F.concat(F.array(F.lit(0)), F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: t["end"]))
    return F.zip_with(tokens, previous, lambda t, end: F.concat(F.when(t["start"] > end, F.lit(" ")).otherwise(F.lit("")), t[field]))


def windows(array: Column, n: int) -> Column:
    """All runs of n neighbouring elements."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return let(
        array,
        lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - (n - 1), F.lit(1))), lambda i: F.slice(a, i, n))).otherwise(F.slice(F.array(a), 1, 0)),
    )


def ngrams(tokens: Column, n: int, normalized: bool = True, join_tokens: bool = False) -> Column:
    """n-grams of the tokens, as arrays of strings, or joined by the rule of `joined`. One token is a plain string."""
    if n == 1:
        return texts(tokens, normalized)
    if not join_tokens:
        return windows(texts(tokens, normalized), n)
    # Each token's gap is looked at once; the one before an n-gram's first token is cut off.
    return F.transform(windows(_pieces(tokens, normalized), n), lambda w: _stripped(F.array_join(w, "")))


def spaced_ngrams(strings: Column, n: int) -> Column:
    """n-grams joined by single spaces, whatever the text had between the words."""
    return strings if n == 1 else F.transform(windows(strings, n), lambda w: F.array_join(w, " "))


def indices(tokens: Column, text: Column, normalized: bool = True) -> Column:
    """The places of the tokens that equal `text`."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t["norm" if normalized else "raw"] == text, i)), lambda i: i.isNotNull())


def in_context(text: Column, start: Column, end: Column, width: int = 20, mark: tuple[str, str] = ("", ""), ellipses: bool = True) -> Column:
    """A token with `width` characters of the (standardized) text on both sides."""
    left = F.greatest(start - width, F.lit(0))
    right = F.least(end + width, F.length(text))
    dots = F.lit("...")
    before = F.when(F.lit(ellipses) & (left > 0), dots).otherwise(F.lit(""))
    after = F.when(F.lit(ellipses) & (right < F.length(text)), dots).otherwise(F.lit(""))
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    return F.concat(before, cut(left, start), F.lit(mark[0]), cut(start, end), F.lit(mark[1]), cut(end, right), after)
