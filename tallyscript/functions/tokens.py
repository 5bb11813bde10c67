"""Tokenizers: patterns in Java's dialect, and tokens with offsets.

A tokenizer knows, besides its token pattern, the class of characters that can start a token; every one of these
does start one. So `[^start]*+(token)` cuts a text into contiguous pieces in one linear pass, and offsets are
running sums of the pieces' lengths. Of a user's pattern no such class is known: there a piece is the shortest gap and
the token after it. A pattern's matches must not be empty, and may hold groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}"
_SIGNS = r"\p{S}\p{P}\p{M}"
_MATH = r"\p{Sm}\p{Sc}%"
TOKEN = "struct<idx:int,start:int,end:int,raw:string,norm:string>"


def escape(chars: str) -> str:
    """Characters as they stand inside a character class."""
    return "".join(f"\\{c}" if not c.isalnum() and c.isascii() and c.isprintable() and c != " " else c for c in chars)


@dataclass(frozen=True)
class Tokenizer:
    name: str
    pattern: str
    start: str | None = None
    unicode_spaces: bool = False

    @property
    def _whole(self) -> str:
        gap = "(?s:.*?)" if self.start is None else f"[^{self.start}]*+"
        return f"{'(?U)' if self.unicode_spaces else ''}{gap}({self.pattern})"

    def tokens(self, text: Column) -> Column:
        """array<string> of the tokens."""
        return F.regexp_extract_all(text, F.lit(self._whole), F.lit(1))

    def spans(self, text: Column) -> Column:
        """array<struct<idx, start, end, raw>> with offsets in code points."""
        raw = self.tokens(text)
        pieces = F.regexp_extract_all(text, F.lit(self._whole), F.lit(0))
        ends = running_sum()(F.transform(pieces, F.length))
        return F.transform(
            F.arrays_zip(raw.alias("raw"), ends.alias("end")),
            lambda x, i: F.struct(i.alias("idx"), (x["end"] - F.length(x["raw"])).cast("int").alias("start"), x["end"].cast("int").alias("end"), x["raw"].alias("raw")),
        )

    def __repr__(self) -> str:
        return f"Tokenizer({self.name}: {self.pattern})"


def running_sum():
    """array<int> to the array of its running sums, over whole Arrow batches."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<int>")
    def sums(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        total = np.concatenate(([0], np.cumsum(flat)))
        out = total[1:] - np.repeat(total[ends[:-1]], lengths)
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))
        return pa.array([None if n else v for n, v in zip(lists.is_null().to_pylist(), made.to_pylist(), strict=True)], pa.list_(pa.int32())) if lists.null_count else made

    return sums


def whitespace_pattern(name: str = "whitespace") -> Tokenizer:
    """Runs of anything but white space."""
    return Tokenizer(name, r"\S+", r"\S", True)


def strip_punctuation_pattern(split_on_escaped: str | None = None, split_on_pattern: str | None = None, name: str = "strip_punctuation") -> Tokenizer:
    """Letters and digits, joined by signs that aren't among those to split on."""
    split = escape(split_on_escaped or "") + (split_on_pattern or "")
    inner = f"[{_SIGNS}&&[^{split}]]" if split else f"[{_SIGNS}]"
    return Tokenizer(name, f"[{_WORD}]+(?:{inner}+[{_WORD}]+)*", _WORD)


def strip_punctuation_keep_symbols_pattern(split_on_escaped: str | None = None, name: str = "keep_symbols") -> Tokenizer:
    """The same, with each mathematical or currency sign and % a token of its own."""
    base = strip_punctuation_pattern(split_on_escaped, _MATH)
    return Tokenizer(name, f"[{_MATH}]|{base.pattern}", _MATH + _WORD)


def keep_symbols_and_punctuation_pattern(punct_chars: str, keep_newlines: bool = True, name: str = "keep_punctuation") -> Tokenizer:
    """The same, with each of `punct_chars` (and the line end) a token of its own."""
    base = strip_punctuation_keep_symbols_pattern(punct_chars)
    own = escape(punct_chars) + (r"\n" if keep_newlines else "")
    return Tokenizer(name, f"[{own}]|{base.pattern}", own + _MATH + _WORD)


PATTERNS = {
    "whitespace_pattern": whitespace_pattern,
    "strip_punctuation_pattern": strip_punctuation_pattern,
    "strip_punctuation_keep_symbols_pattern": strip_punctuation_keep_symbols_pattern,
    "keep_symbols_and_punctuation_pattern": keep_symbols_and_punctuation_pattern,
}
