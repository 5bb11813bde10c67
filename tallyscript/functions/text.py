"""Text functions as builders of Column expressions.

All but `nfc` are built-in expressions, so they also work inside `transform` over an array of tokens. `nfc` sends
only texts to Python that hold a code point from U+0300 on, below which every text is composed already.
Null stays null, the empty string stays empty.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import characters as C
from .sequences import let

#: Java's classes of what the engine calls punctuation, symbols and marks.
SIGN = r"\p{M}\p{S}\p{P}"
#: Beyond Latin-1, what texts often have.
_OFTEN = "œŒ—…"
#: A code point that is no character.
_PART = "\uffff"


def lowercase(c: Column) -> Column:
    return F.lower(c)


def normalize_apostrophe_variants(c: Column) -> Column:
    return F.translate(c, C.APOSTROPHES, "'" * len(C.APOSTROPHES))


def normalize_hyphen_variants(c: Column) -> Column:
    return F.translate(c, C.HYPHENS, "-" * len(C.HYPHENS))


def normalize_slash_variants(c: Column) -> Column:
    return F.translate(c, C.SLASHES, "/" * len(C.SLASHES))


def strip_punctuation(c: Column) -> Column:
    """Without leading and trailing punctuation other than & and %."""
    return F.regexp_replace(c, r"^[\p{P}&&[^&%]]+|[\p{P}&&[^&%]]+\z", "")


def _mapped(c: Column, table: dict[str, str], preserve: str = "") -> Column:
    """Characters that become one or none by `translate`; in texts with such as become several, the common ones are
    replaced one after another, which is safe as all of them become ASCII. Only texts with a rare one go through a map,
    character by character; the map is one foldable literal, so the plan stays small.
    """
    single, to, several = C.parts(table, preserve)
    out = F.translate(c, single, to)
    common = {k: v for k, v in several.items() if ord(k) < 0x100 or k in _OFTEN}
    rare = {k: v for k, v in several.items() if k not in common}
    long = out
    for char, into in common.items():
        long = F.replace(long, F.lit(char), F.lit(into))
    made = F.when(c.rlike(f"[{''.join(common)}]"), long).otherwise(out) if common else out
    if not rare:
        return made
    into = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(into, x), F.translate(x, single, to))), "")
    return F.when(c.rlike(f"[{''.join(rare)}]"), each).otherwise(made)


def transliterate_latin_letters(c: Column, preserve: str = "") -> Column:
    """Latin letters in ASCII, but for those in `preserve`; other scripts stay."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _mapped(c, _common(C.latin_letters()), preserve)).otherwise(c)


def transliterate_symbols(c: Column) -> Column:
    """Marks, symbols and punctuation in ASCII where that is of these categories too (so currency signs stay)."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _mapped(c, C.signs())).otherwise(c)


def _common(table: dict[str, str]) -> dict[str, str]:
    """Spark's translate works by UTF-16 unit, so only the basic plane is mapped."""
    return {k: v for k, v in table.items() if ord(k) < 0x10000}


def remove_symbols(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SIGN}]", "")


def nfc_needed(c: Column) -> Column:
    return c.rlike(r"[^\x{0}-\x{2FF}]")


def _composed():
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return compose


def nfc(c: Column) -> Column:
    """Unicode's canonical composition."""
    return F.when(nfc_needed(c), _composed()(F.when(nfc_needed(c), c))).otherwise(c)


def nfc_array(c: Column) -> Column:
    """The same for each element of an array, of which only those arrays that need it are sent to Python."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<string>")
    def compose(lists: pa.Array) -> pa.Array:
        rows = [None if r is None else [None if t is None else unicodedata.normalize("NFC", t) for t in r] for r in lists.to_pylist()]
        return pa.array(rows, pa.list_(pa.string()))

    needed = F.exists(c, nfc_needed)
    return F.when(needed, compose(F.when(needed, c))).otherwise(c)


#: Steps that replace characters by one.
VARIANTS: dict[Callable[..., Column], tuple[str, str]] = {
    normalize_apostrophe_variants: (C.APOSTROPHES, "'"),
    normalize_hyphen_variants: (C.HYPHENS, "-"),
    normalize_slash_variants: (C.SLASHES, "/"),
}


@dataclass(frozen=True)
class Step:
    """One function of a pipeline with its arguments; `builtin` tells that it may stand inside a lambda."""

    name: str
    build: Callable[..., Column]
    kwargs: dict = field(default_factory=dict)
    builtin: bool = True
    on_array: Callable[..., Column] | None = None
    token_only: bool = False
    length_preserving: bool = False

    def __call__(self, c: Column) -> Column:
        return self.build(c, **self.kwargs)


#: Text functions by name: (builder, builtin, form for arrays, token_only, length_preserving).
FUNCTIONS: dict[str, tuple] = {
    "lowercase": (lowercase, True, None, False, True),
    "nfc": (nfc, False, nfc_array, False, False),
    "normalize_apostrophe_variants": (normalize_apostrophe_variants, True, None, False, True),
    "normalize_hyphen_variants": (normalize_hyphen_variants, True, None, False, True),
    "normalize_slash_variants": (normalize_slash_variants, True, None, False, True),
    "strip_punctuation": (strip_punctuation, True, None, True, False),
    "transliterate_latin_letters": (transliterate_latin_letters, True, None, False, False),
    "transliterate_symbols": (transliterate_symbols, True, None, False, False),
    "remove_symbols": (remove_symbols, True, None, False, False),
}


def python_step(name: str, fn: Callable[..., str], kwargs: dict | None = None) -> Step:
    """A user's function of a string as a step: it runs over Arrow batches."""
    from pyspark.sql.pandas.functions import arrow_udf

    given = dict(kwargs or {})

    def build(c: Column, **_: object) -> Column:
        @arrow_udf("string")
        def call(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else fn(t, **given) for t in texts.to_pylist()], pa.string())

        return call(c)

    def on_array(c: Column, **_: object) -> Column:
        @arrow_udf("array<string>")
        def call(lists: pa.Array) -> pa.Array:
            return pa.array([None if r is None else [None if t is None else fn(t, **given) for t in r] for r in lists.to_pylist()], pa.list_(pa.string()))

        return call(c)

    return Step(name, build, given, False, on_array)


@dataclass(frozen=True)
class Normalizer:
    """Steps applied from left to right."""

    name: str
    steps: tuple[Step, ...]

    def __call__(self, c: Column) -> Column:
        """Neighbouring steps that replace characters by others, none of which the next of them replaces, are one pass."""
        chars = to = ""
        for s in self.steps:
            own, into = VARIANTS.get(s.build, ("", ""))
            if chars and (not own or set(own) & {*chars, *to}):
                c, chars, to = F.translate(c, chars, to), "", ""
            if own:
                chars, to = chars + own, to + into * len(own)
            else:
                c = s.build(c, **s.kwargs)
        return F.translate(c, chars, to) if chars else c

    def over(self, tokens: Column) -> Column:
        """The steps on each element of an array.

        Built-in steps that look at one character at a time run over all elements as one text, parted by a character
        that no step changes: so they are compiled, and nothing is evaluated element by element. Only an array that
        holds that character, or a step that looks at an element's ends, takes the elements one by one.
        """
        run: list[Step] = []

        def flush(c: Column) -> Column:
            if not run:
                return c
            chain = list(run)
            run.clear()

            def one(x: Column) -> Column:
                for s in chain:  # a step mentions its text several times
                    x = let(x, s)
                return x

            if any(s.token_only for s in chain):
                return F.transform(c, one)

            def whole(c: Column) -> Column:
                parted = let(F.array_join(c, _PART), lambda text: F.split(one(text), _PART, -1))
                return F.when(F.size(c) == 0, c).when(F.array_join(c, "").contains(_PART), F.transform(c, one)).otherwise(parted)

            return let(c, whole)

        for s in self.steps:
            if s.builtin:
                run.append(s)
            else:
                tokens = s.on_array(flush(tokens), **s.kwargs)
        return flush(tokens)

    def __repr__(self) -> str:
        return f"Normalizer({self.name}: {' -> '.join(s.name for s in self.steps)})"
