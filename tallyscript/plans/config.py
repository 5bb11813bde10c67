"""Pipelines by configuration: named standardizers, tokenizers and normalizers, with an overlay per language."""

from __future__ import annotations

import copy
import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column

from ..functions import text as T
from ..functions import tokens as K
from ..functions.sequences import let
from ..functions.text import Normalizer, Step
from ..functions.tokens import Tokenizer

DEFAULT = "default"
BASE: dict = {
    "standardizers": {
        "default": {"nfc": None, "normalize_apostrophe_variants": None, "normalize_hyphen_variants": None, "normalize_slash_variants": None},
    },
    "tokenizers": {
        "default": {"strip_punctuation_keep_symbols_pattern": {"split_on_escaped": "-/"}},
        "with_punctuation": {"keep_symbols_and_punctuation_pattern": {"punct_chars": ".,!?:;\"-/()“”«»", "keep_newlines": True}},
        "key_term": {"strip_punctuation_keep_symbols_pattern": {"split_on_escaped": "-/'"}},
        "legacy": {"whitespace_pattern": None},
    },
    "normalizers": {
        "default": {"lowercase": None, "transliterate_latin_letters": None, "transliterate_symbols": None},
        "legacy": {"nfc": None},
        "legacy_uncased": {"lowercase": None},
        "legacy_uncased_no_punct": {"lowercase": None, "remove_symbols": None},
    },
}
LANGUAGES: dict[str, dict] = {
    "en": {},
    "da": {"normalizers": {"default": {"transliterate_latin_letters": {"preserve": "æøå"}}}},
    "de": {"normalizers": {"default": {"transliterate_latin_letters": {"preserve": "äöüß"}}}},
    "fr": {
        "tokenizers": {"default": {"strip_punctuation_keep_symbols_pattern": {"split_on_escaped": "-/'"}}},
        "normalizers": {"default": {"transliterate_latin_letters": {"preserve": "àâäçéèêëîïôöùûüÿœæ"}}},
    },
}


def merged(base: dict, over: dict | None) -> dict:
    """A deep copy of `base` with `over` laid over it, key by key."""
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load_config(config: str | dict | None = None, language: str | None = None) -> dict:
    """A configuration: a mapping, a YAML file, the name of a packaged one ("base"), or the default; then the language's overlay."""
    if config is None or config == "base":
        tree = copy.deepcopy(BASE)
    elif isinstance(config, dict):
        tree = copy.deepcopy(config)
    else:
        import yaml

        path = Path(config)
        if not path.is_file():
            raise FileNotFoundError(f"no configuration {config!r}: neither a file nor a packaged name (base)")
        tree = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if language is not None:
        if language not in LANGUAGES:
            raise ValueError(f"Language {language!r} is not supported; supported: {', '.join(sorted(LANGUAGES))}")
        tree = merged(tree, LANGUAGES[language])
    return tree


def _imported(path: str) -> Callable:
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"unknown function {path!r}: neither built in nor a dotted path")
    return getattr(importlib.import_module(module), name)


def _checked(fn: Callable, name: str, kwargs: dict, leading: int) -> None:
    """The first `leading` parameters are the engine's; of the rest, the required must be there and none else."""
    params = list(inspect.signature(fn).parameters.values())
    for p in params[:leading]:
        if p.name in kwargs:
            raise ValueError(f"{name}: parameter {p.name!r} is given by the engine, not by the configuration")
    own = {p.name: p for p in params[leading:] if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    missing = [k for k, p in own.items() if p.default is p.empty and k not in kwargs]
    if missing:
        raise ValueError(f"{name}: missing parameter(s) {missing}")
    if not any(p.kind is p.VAR_KEYWORD for p in params) and (unknown := sorted(set(kwargs) - set(own))):
        raise ValueError(f"{name}: unexpected parameter(s) {unknown}")


def step(name: str, kwargs: dict | None = None) -> Step:
    """A text function by its name, or a user's function of a string by its dotted path."""
    kwargs = dict(kwargs or {})
    if name in T.FUNCTIONS:
        build, builtin, on_array, token_only, keeps = T.FUNCTIONS[name]
        _checked(build, name, kwargs, 1)
        return Step(name, build, kwargs, builtin, on_array, token_only, keeps)
    fn = _imported(name)
    _checked(fn, name, kwargs, 1)
    return T.python_step(name, fn, kwargs)


def tokenizer(name: str, spec: dict) -> Tokenizer:
    if len(spec) != 1:
        raise ValueError(f"tokenizer {name!r} must name exactly one function, not {len(spec)}")
    ((fn_name, kwargs),) = spec.items()
    kwargs = dict(kwargs or {})
    fn = K.PATTERNS.get(fn_name) or _imported(fn_name)
    _checked(fn, fn_name, kwargs, 0)
    if fn_name in K.PATTERNS:
        return fn(**kwargs, name=name)
    made = fn(**kwargs)
    return made if isinstance(made, Tokenizer) else Tokenizer(name, str(made))


@dataclass
class Pipelines:
    """Named functions; `register` adds or replaces one at any time before a plan is built with it."""

    standardizers: dict[str, Normalizer] = field(default_factory=dict)
    tokenizers: dict[str, Tokenizer] = field(default_factory=dict)
    normalizers: dict[str, Normalizer] = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict) -> Pipelines:
        chain = lambda name, spec: Normalizer(name, tuple(step(k, v) for k, v in (spec or {}).items()))
        return cls(
            {k: chain(k, v) for k, v in (config.get("standardizers") or {}).items()},
            {k: tokenizer(k, v) for k, v in (config.get("tokenizers") or {}).items()},
            {k: chain(k, v) for k, v in (config.get("normalizers") or {}).items()},
        )

    def register(self, kind: str, name: str, what: Normalizer | Tokenizer | Callable) -> None:
        """kind: standardizers, tokenizers or normalizers. A plain function of a string becomes one step, and a pattern a
        tokenizer."""
        own = getattr(self, kind)
        if kind == "tokenizers" and not isinstance(what, Tokenizer):
            what = Tokenizer(name, str(what() if callable(what) else what))
        if kind != "tokenizers" and not isinstance(what, Normalizer):
            what = Normalizer(name, (T.python_step(name, what),))
        own[name] = what

    def pick(self, kind: str, name: str):
        own = getattr(self, kind)
        if name not in own:
            raise ValueError(f"'{name}' not found in {kind}; there are: {', '.join(own)}")
        return own[name]


@dataclass(frozen=True)
class PipelineKey:
    standardizer: str = DEFAULT
    tokenizer: str = DEFAULT
    normalizer: str = DEFAULT


def tokens(pipelines: Pipelines, key: PipelineKey, text: Column) -> Column:
    """array<TOKEN> of a raw text under a pipeline; a null text has no tokens."""
    from pyspark.sql import functions as F

    standard = pipelines.pick("standardizers", key.standardizer)(text)
    spans = pipelines.pick("tokenizers", key.tokenizer).spans(standard)
    normalizer = pipelines.pick("normalizers", key.normalizer)

    def whole(spans: Column) -> Column:
        norm = normalizer.over(F.transform(spans, lambda t: t["raw"]))
        return F.zip_with(spans, norm, lambda t, n: F.struct(t["idx"].alias("idx"), t["start"].alias("start"), t["end"].alias("end"), t["raw"].alias("raw"), n.alias("norm")))

    # Python has no place inside a lambda, which is what computes the spans once.
    return let(spans, whole) if all(s.builtin for s in normalizer.steps) else whole(spans)


def strings(pipelines: Pipelines, key: PipelineKey, text: Column, normalized: bool = True) -> Column:
    """array<string> of the tokens alone, without offsets: no Python on the way unless the texts need it."""
    standard = pipelines.pick("standardizers", key.standardizer)(text)
    raw = pipelines.pick("tokenizers", key.tokenizer).tokens(standard)
    return pipelines.pick("normalizers", key.normalizer).over(raw) if normalized else raw
