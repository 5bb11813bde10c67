"""Every operator as a query over the test tables, with SQL that gives the same rows where SQL can.

The tables hold no transcripts, so pairs are made of them: neighbouring turns of a conversation, and names of
parts with neighbouring keys. Neighbours are found by a join on the next number, so no window over a whole table
or a long conversation is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import characters as C
from ..functions import sequences as Q
from ..functions import text as X
from ..functions import tokens as K
from ..operators import align as A
from ..operators import terms as M
from ..reporting import html
from ..sources import writers
from . import config, oracle
from .config import PipelineKey, Pipelines
from .evaluation import EvalSet
from .registry import METRICS, catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PIPELINES = Pipelines.of(config.load_config())
_DEFAULT, _KEY_TERM = PipelineKey(), PipelineKey(tokenizer="key_term")


def _query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: How many pairs of turns or documents, and of parts' names, one task has at most, about.
TURNS, NAMES = 2000, 20000


def _tasks(spark: SparkSession, table: DataFrame, rows: int) -> int:
    """How many tasks the rows of a table are spread over: as many as the session's shuffles have, and more for large
    tables, so that neither a task's time nor its memory grows with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, ref, hyp): each turn and the next one of its conversation, spread over all tasks; turns without a text
    are in no pair. Turns are numbered from 0 to 999,999."""
    table = _read(spark, sf_dir, "conversations")
    t = table.where("text is not null")
    a = t.select("conv_id", "turn", F.col("text").alias("ref"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000000 + F.col("turn")).alias("ex_id"), "ref", "hyp").repartition(_tasks(spark, table, TURNS), "ex_id")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ex_id, ref, hyp): each part's name and that of the part with the next key, spread over all tasks."""
    table = _read(spark, sf_dir, "part")
    t = table.where("p_name is not null")
    a = t.select(F.col("p_partkey").alias("ex_id"), F.col("p_name").alias("ref"))
    return a.join(t.select((F.col("p_partkey") - 1).alias("ex_id"), F.col("p_name").alias("hyp")), "ex_id").repartition(_tasks(spark, table, NAMES), "ex_id")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vocab, term): `names` are all parts' names, `nouns` their second words."""
    t = _read(spark, sf_dir, "part").select("p_name")
    names = t.select(F.lit("names").alias("vocab"), F.col("p_name").alias("term"))
    return names.unionByName(t.select(F.lit("nouns").alias("vocab"), F.element_at(F.split("p_name", " "), 2).alias("term"))).distinct()


def conversations(spark: SparkSession, sf_dir: str) -> EvalSet:
    return EvalSet(conversation_pairs(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> EvalSet:
    return EvalSet(part_pairs(spark, sf_dir)).add_key_term_table(vocabulary(spark, sf_dir), ["names", "nouns"])


def parts_with_own_terms(spark: SparkSession, sf_dir: str) -> EvalSet:
    """Each example's own terms are the second word of its reference, in medical_terms."""
    pairs = part_pairs(spark, sf_dir).withColumn("key_terms", F.create_map(F.lit("medical_terms"), F.array(F.element_at(F.split("ref", " "), 2))))
    return EvalSet(pairs, names=frozenset(["medical_terms"]))


# --- SQL of the pieces ---------------------------------------------------------------------------------------------
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_PAIRS = "select a.conv_id * 1000000 + a.turn as ex_id, a.text as ref, b.text as hyp from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn"
_PARTS = "select a.p_partkey as ex_id, a.p_name as ref, b.p_name as hyp from part a join part b on a.p_partkey + 1 = b.p_partkey"


def _sql_translate(c: str, table: dict[str, str], preserve: str = "") -> str:
    single, to, several = C.parts({k: v for k, v in table.items() if ord(k) < 0x180}, preserve)
    out = f"translate({c}, {_quoted(single)}, {_quoted(to)})"
    for k, v in several.items():
        out = f"replace({out}, {_quoted(k)}, {_quoted(v)})"
    return out


def _sql_standard(c: str) -> str:
    chars = C.APOSTROPHES + C.HYPHENS + C.SLASHES
    return f"translate(nfc_normalize({c}), {_quoted(chars)}, {_quoted(chr(39) * len(C.APOSTROPHES) + '-' * len(C.HYPHENS) + '/' * len(C.SLASHES))})"


def _sql_normal(c: str, preserve: str = "") -> str:
    return _sql_translate(_sql_translate(f"lower({c})", C.latin_letters(), preserve), C.signs())


#: Signs inside words, for RE2, which has no subtraction: all of ASCII's but those that tokens split on, and whole classes.
_JOIN = r"\p{M}\p{Sk}\p{So}\p{Pc}\p{Ps}\p{Pe}\p{Pi}\p{Pf}!\"#&*,.:;?@\\¡§¶·¿…"
_WORD = r"[\p{L}\p{N}]+"


def _sql_words(join: str, first: str = "") -> str:
    return f"{first}{_WORD}(?:[{join}]+{_WORD})*".replace("'", "''")


_SQL_TOKENS = {
    "default": _sql_words(_JOIN + "'", r"[\p{Sm}\p{Sc}%]|"),
    "key_term": _sql_words(_JOIN, r"[\p{Sm}\p{Sc}%]|"),
    "with_punctuation": _sql_words(r"\p{M}\p{Sk}\p{So}\p{Pc}\[\]{}#&*@\\¡§¶·¿…'", r'[.,!?:;"\-/()“”«»\n]|[\p{Sm}\p{Sc}%]|'),
    "strip_punctuation": _sql_words(r"\p{S}\p{P}\p{M}"),
    "whitespace": r"[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+",
}


def _sql_tokens(c: str, which: str = "default") -> str:
    return f"regexp_extract_all({c}, '{_SQL_TOKENS[which]}')"


def _sql_normal_tokens(c: str, which: str = "default") -> str:
    return f"list_transform({_sql_tokens(_sql_standard(c), which)}, lambda t: {_sql_normal('t')})"


#: Token edit distance of the lists r and h.
_DISTANCE = """list_reduce(r, lambda prev, x: list_reduce(range(1, len(h) + 1),
  lambda cur, j: list_append(cur, least(prev[j] + (case when h[j] = x then 0 else 1 end), prev[j + 1] + 1, cur[-1] + 1)),
  [prev[1] + 1]), range(0, len(h) + 1))[-1]"""
_RATE = "case when ref_length = 0 then cast(num_edits as double) else num_edits / ref_length end"


def _sql_wer(pairs: str, tokens: Callable[[str], str]) -> str:
    inner = f"select ex_id, cast({_DISTANCE} as bigint) as num_edits, cast(len(r) as bigint) as ref_length from (select ex_id, {tokens('ref')} as r, {tokens('hyp')} as h from ({pairs}))"
    return f"select *, {_RATE} as value from ({inner})"


def _sql_total(rows: str) -> str:
    return f"select *, {_RATE} as value from (select cast(coalesce(sum(num_edits), 0) as bigint) as num_edits, cast(coalesce(sum(ref_length), 0) as bigint) as ref_length from ({rows}))"


# --- text functions ------------------------------------------------------------------------------------------------
def _text(name: str, fn: Callable[[Column], Column], sql: str | None) -> None:
    @_query(name, f"select doc_id, {sql} as out from documents" if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, "documents").select("doc_id", fn(F.col("text")).alias("out"))


_variants = lambda chars, to: f"translate(text, {_quoted(chars)}, {_quoted(to * len(chars))})"
_text("text_lowercase", X.lowercase, "lower(text)")
_text("text_nfc", X.nfc, "nfc_normalize(text)")
_text("text_apostrophes", X.normalize_apostrophe_variants, _variants(C.APOSTROPHES, "'"))
_text("text_hyphens", X.normalize_hyphen_variants, _variants(C.HYPHENS, "-"))
_text("text_slashes", X.normalize_slash_variants, _variants(C.SLASHES, "/"))
_EDGE = r"[\p{Pc}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}!\"#''*,./:;?@\\¡§¶·¿…]"
_text("text_strip_punctuation", X.strip_punctuation, f"regexp_replace(text, '^{_EDGE}+|{_EDGE}+$', '', 'g')")
_text("text_translit_latin", X.transliterate_latin_letters, _sql_translate("text", C.latin_letters()))
for _lang, _keep in (("da", "æøå"), ("de", "äöüß"), ("fr", "àâäçéèêëîïôöùûüÿœæ")):
    _text(f"text_translit_latin_{_lang}", lambda c, keep=_keep: X.transliterate_latin_letters(c, keep), _sql_translate("text", C.latin_letters(), _keep))
_text("text_translit_symbols", X.transliterate_symbols, _sql_translate("text", C.signs()))
_text("text_remove_symbols", X.remove_symbols, r"regexp_replace(text, '[\p{M}\p{S}\p{P}]', '', 'g')")
_text("standardize_default", _PIPELINES.standardizers["default"], _sql_standard("text"))
_text("normalize_default", _PIPELINES.normalizers["default"], _sql_normal("text"))
_text("normalize_legacy", _PIPELINES.normalizers["legacy"], "nfc_normalize(text)")
_text("normalize_legacy_uncased", _PIPELINES.normalizers["legacy_uncased"], "lower(text)")
_text("normalize_legacy_uncased_no_punct", _PIPELINES.normalizers["legacy_uncased_no_punct"], r"regexp_replace(lower(text), '[\p{M}\p{S}\p{P}]', '', 'g')")


# --- tokenizers and sequences --------------------------------------------------------------------------------------
def _tokens(name: str, which: str, tokenizer: K.Tokenizer, table: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    @_query(name, f"select {key}, array_to_string(t, chr(10)) as tokens, cast(len(t) as bigint) as n_tokens from (select {key}, {_sql_tokens(text, which)} as t from {table})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, table).select(key, tokenizer.tokens(F.col(text)).alias("t")).select(key, F.array_join("t", "\n").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


_tokens("tok_whitespace", "whitespace", _PIPELINES.tokenizers["legacy"])
_tokens("tok_default", "default", _PIPELINES.tokenizers["default"])
_tokens("tok_key_term", "key_term", _PIPELINES.tokenizers["key_term"])
_tokens("tok_with_punctuation", "with_punctuation", _PIPELINES.tokenizers["with_punctuation"])
_tokens("tok_strip_punctuation", "strip_punctuation", K.strip_punctuation_pattern())
_tokens("tok_whitespace_pages", "whitespace", _PIPELINES.tokenizers["legacy"], "pages", "page_id", "html")


#: A user's pattern with a group and gaps.
_USER = r"(\w)\w*'?s?"


def user_pattern() -> str:
    return _USER


@_query(
    "tok_user_pattern",
    f"""select doc_id, array_to_string(t, chr(10)) as tokens, array_to_string(list_transform(range(1, len(t) + 1), lambda i: cast({oracle.END.format(i='i')} - length(t[i]) as bigint)), ',') as starts
 from {oracle.spans('text', r"[0-9A-Za-z_]+(?:''s|s|'')?", lambda x: x, 'doc_id', 'documents').replace("''", "''")}""",
)
def tok_user_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own tokenizer by a dotted path, with offsets."""
    own = config.tokenizer("own", {f"{__name__}.user_pattern": None})
    d = _read(spark, sf_dir, "documents").select("doc_id", own.spans(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join(F.col("t.raw"), "\n").alias("tokens"), F.array_join(F.col("t.start").cast("array<string>"), ",").alias("starts"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), spread over all tasks."""
    table = _read(spark, sf_dir, "documents")
    return table.select("doc_id", "text").repartition(_tasks(spark, table, TURNS), "doc_id")


def _document_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t): the normalized tokens' strings, for what needs no offsets."""
    return _documents(spark, sf_dir).select("doc_id", config.strings(_PIPELINES, _DEFAULT, F.col("text")).alias("t"))


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("doc_id", config.tokens(_PIPELINES, _DEFAULT, F.col("text")).alias("toks"), _PIPELINES.standardizers["default"](F.col("text")).alias("standard"))


@_query("token_offsets", f"select doc_id, cast(len(t) as bigint) as n_tokens, cast(len(t) as bigint) as n_exact from (select doc_id, {_sql_tokens(_sql_standard('text'))} as t from documents)")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offsets give back their tokens."""
    d = _document_tokens(spark, sf_dir)
    good = F.count_if(F.substring("standard", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")) == F.col("t.raw"))
    rows = d.select("doc_id", "standard", F.explode_outer("toks").alias("t"))
    return rows.groupBy("doc_id").agg(F.count("t.raw").alias("n_tokens"), good.alias("n_exact"))


_NORMAL = f"select doc_id, {_sql_normal_tokens('text')} as t from documents"


@_query("token_normalization", f"select doc_id, array_to_string(t, ' ') as norms from ({_NORMAL})")
def token_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_tokens(spark, sf_dir).select("doc_id", F.array_join(Q.texts(F.col("toks")), " ").alias("norms"))


@_query("ngrams_2", f"select doc_id, cast(greatest(len(t) - 1, 0) as bigint) as n_grams, coalesce(t[1] || ' ' || t[2], '') as first_gram, coalesce(t[-2] || ' ' || t[-1], '') as last_gram from ({_NORMAL})")
def ngrams_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _document_strings(spark, sf_dir).select("doc_id", Q.windows(F.col("t"), 2).alias("g"))
    text = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    return g.select("doc_id", F.size("g").cast("long").alias("n_grams"), text(F.get("g", F.lit(0))).alias("first_gram"), text(F.get("g", F.size("g") - 1)).alias("last_gram"))


@_query("ngrams_3_spaced", f"select doc_id, array_to_string(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), chr(10)) as grams from ({_NORMAL})")
def ngrams_3_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_tokens(spark, sf_dir).select("doc_id", F.array_join(Q.spaced_ngrams(Q.texts(F.col("toks")), 3), "\n").alias("grams"))


_SPANS = oracle.spans(_sql_standard("text"), _SQL_TOKENS["default"], _sql_normal, "doc_id", "documents")


@_query("ngrams_2_joined", f"select doc_id, array_to_string(list_transform(range(1, len(t)), lambda i: n[i] || case when length(p[i + 1]) > length(t[i + 1]) then ' ' else '' end || n[i + 1]), chr(10)) as grams from {_SPANS}")
def ngrams_2_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_tokens(spark, sf_dir).select("doc_id", F.array_join(Q.ngrams(F.col("toks"), 2, join_tokens=True), "\n").alias("grams"))


@_query("token_indices", f"select doc_id, array_to_string(list_filter(list_transform(range(1, len(t) + 1), lambda i: case when t[i] = t[1] then i - 1 end), lambda i: i is not null), ',') as places from ({_NORMAL}) where len(t) > 0")
def token_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's first token occurs."""
    d = _document_tokens(spark, sf_dir).where(F.size("toks") > 0)
    return d.select("doc_id", F.array_join(Q.indices(F.col("toks"), F.get("toks", F.lit(0))["norm"]).cast("array<string>"), ",").alias("places"))


@_query("joined_text", f"select doc_id, {oracle.joined()} as joined, {oracle.joined('t')} as joined_raw from {_SPANS}")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_tokens(spark, sf_dir).select("doc_id", Q.joined(F.col("toks")).alias("joined"), Q.joined(F.col("toks"), False).alias("joined_raw"))


@_query("flat_tokens", f"select norm, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(t) as norm from ({_NORMAL})) group by norm")
def flat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens as one list, counted."""
    per = _document_tokens(spark, sf_dir).select("doc_id", F.explode(Q.texts(F.col("toks"))).alias("norm")).groupBy("norm", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("norm").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


_KWIC = f"select doc_id, k, s, {oracle.END.format(i='k + 1')} as e, length(t[k + 1]) as w from (select *, len(t) // 2 as k from {_SPANS} where len(t) > 0)"


@_query(
    "kwic",
    f"""select doc_id, cast(k as int) as idx, case when e - w > 20 then '...' else '' end || substr(s, cast(greatest(e - w - 20, 0) + 1 as bigint), cast(least(e - w, 20) as bigint)) || '['
 || substr(s, cast(e - w + 1 as bigint), w) || ']' || substr(s, cast(e + 1 as bigint), 20) || case when e + 20 < length(s) then '...' else '' end as context from ({_KWIC})""",
)
def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's middle token in its context."""
    d = _document_tokens(spark, sf_dir).withColumn("t", F.get("toks", F.floor(F.size("toks") / 2).cast("int"))).where("t is not null")
    return d.select("doc_id", F.col("t.idx").alias("idx"), Q.in_context(F.col("standard"), F.col("t.start"), F.col("t.end"), 20, ("[", "]")).alias("context"))


@_query("token_slices", f"select doc_id, array_to_string(t[2:4], ' ') as inner_tokens, array_to_string(t[1:2] || t[-2:], ' ') as ends from ({_NORMAL})")
def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices and concatenations of token lists."""
    d = _document_strings(spark, sf_dir)
    last = F.slice("t", F.greatest(F.size("t") - 1, F.lit(1)), F.lit(2))
    return d.select("doc_id", F.array_join(F.slice("t", 2, 3), " ").alias("inner_tokens"), F.array_join(F.concat(F.slice("t", 1, 2), last), " ").alias("ends"))


# --- error rates -----------------------------------------------------------------------------------------------------
def _metric(name: str, data: Callable[[SparkSession, str], EvalSet], metric: str, sql_rows: str | None = None, sql_total: str | None = None, *, rows: bool = True, total: bool = True, **params) -> None:
    if rows:

        @_query(f"{name}_example", sql_rows)
        def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
            return data(spark, sf_dir).metrics.get(metric, **params).examples()

    if total:

        @_query(f"{name}_dataset", sql_total)
        def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
            return data(spark, sf_dir).metrics.get(metric, **params).aggregated()


def _rate(name: str, data, pairs: str, metric: str, tokens: Callable[[str], str], **params) -> None:
    rows = _sql_wer(pairs, tokens)
    _metric(name, data, metric, rows, _sql_total(rows), **params)


_rate("wer_parts", parts, _PARTS, "wer", _sql_normal_tokens)
_rate("wer", conversations, _PAIRS, "wer", _sql_normal_tokens)
_rate("wer_raw", parts, _PARTS, "wer", lambda c: _sql_tokens(_sql_standard(c)), normalized=False)
_rate("cer_parts", parts, _PARTS, "cer", lambda c: f"string_split(array_to_string({_sql_normal_tokens(c)}, ' '), '')")
_LEGACY = {"": lambda t: f"nfc_normalize({t})", "_uncased": lambda t: f"lower({t})", "_uncased_no_punct": lambda t: rf"regexp_replace(lower({t}), '[\p{{M}}\p{{S}}\p{{P}}]', '', 'g')"}
for _suffix, _fn in _LEGACY.items():
    _words = lambda c, fn=_fn: f"list_transform({_sql_tokens(_sql_standard(c), 'whitespace')}, lambda t: {fn('t')})"
    _rate(f"legacy_wer{_suffix}", conversations, _PAIRS, f"legacy_wer{_suffix}", _words)
    _rate(f"legacy_cer{_suffix}", parts, _PARTS, f"legacy_cer{_suffix}", lambda c, w=_words: f"string_split(array_to_string({w(c)}, ' '), '')")
_SIDE = lambda c: oracle.spans(_sql_standard(c), _SQL_TOKENS["default"], _sql_normal, "ex_id", f"({_PAIRS})")
_CER = f"""select *, {_RATE} as value from (select a.ex_id, cast({oracle.levenshtein('a.x', 'b.x')} as bigint) as num_edits, cast(length(a.x) as bigint) as ref_length
 from (select ex_id, {oracle.joined()} as x from {_SIDE('ref')}) a join (select ex_id, {oracle.joined()} as x from {_SIDE('hyp')}) b on a.ex_id = b.ex_id)"""
_metric("cer", conversations, "cer", _CER, _sql_total(_CER))

_SUMMARY = f"""select ex_id, cast(len({_sql_tokens('r')}) as bigint) as num_ref_words, cast(length(r) as bigint) as num_ref_chars, cast(len({_sql_tokens('h')}) as bigint) as num_hyp_words, cast(length(h) as bigint) as num_hyp_chars
from (select ex_id, {_sql_standard('ref')} as r, {_sql_standard('hyp')} as h from ({_PAIRS}))"""
_sums = lambda *names: ", ".join(f"cast(coalesce(sum({n}), 0) as bigint) as {n}" for n in names)
_metric("summary", conversations, "summary", _SUMMARY, f"select count(*) as num_examples, {_sums('num_ref_words', 'num_ref_chars', 'num_hyp_words', 'num_hyp_chars')} from ({_SUMMARY})")


@_query("wer_size", f"select count(*) as n_pairs, cast(sum(len(r) * len(h)) as bigint) as cells from (select {_sql_normal_tokens('ref')} as r, {_sql_normal_tokens('hyp')} as h from ({_PAIRS}))")
def wer_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells the distance tables of all pairs have, by tokens."""
    both = conversations(spark, sf_dir).token_strings(_DEFAULT)
    return both.agg(F.count("*").alias("n_pairs"), F.sum(F.size("ref").cast("long") * F.size("hyp")).alias("cells"))


@_query("cer_size", f"select count(*) as n_pairs, cast(sum(length(a.x) * length(b.x)) as bigint) as cells from (select ex_id, {oracle.joined()} as x from {_SIDE('ref')}) a join (select ex_id, {oracle.joined()} as x from {_SIDE('hyp')}) b on a.ex_id = b.ex_id")
def cer_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by characters."""
    both = conversations(spark, sf_dir).tokenized(_DEFAULT)
    return both.agg(F.count("*").alias("n_pairs"), F.sum(F.length(Q.joined(F.col("ref"))).cast("long") * F.length(Q.joined(F.col("hyp")))).alias("cells"))


@_query("wer_by_role", f"select role, num_edits, ref_length, {_RATE} as value from (select role, cast(sum(num_edits) as bigint) as num_edits, cast(sum(ref_length) as bigint) as ref_length from ({_sql_wer(_PAIRS, _sql_normal_tokens)}) e join conversations c on e.ex_id = c.conv_id * 1000000 + c.turn group by role)")
def wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's value per group of examples."""
    groups = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("ex_id"), "role")
    return conversations(spark, sf_dir).metrics.wer().aggregated(["role"], groups)


# --- alignments ------------------------------------------------------------------------------------------------------
#: Two-word names: which word of the reference is matched, by the rule for ties. r1 r2 against h1 h2.
_TWO = f"select ex_id, r[1] as r1, r[2] as r2, h[1] as h1, h[2] as h2 from (select ex_id, string_split(ref, ' ') as r, string_split(hyp, ' ') as h from ({_PARTS}))"
_CASE = f"""select *, case when r1 = h1 and r2 = h2 then 'both' when r1 = h1 then 'first' when r2 = h2 then 'second' when r1 = h2 then 'moved' else 'none' end as c from ({_TWO})"""
_COUNTS = f"""select ex_id, cast(case c when 'both' then 2 when 'none' then 0 else 1 end as bigint) as num_matches,
cast(case c when 'both' then 0 when 'none' then 2 when 'moved' then 0 else 1 end as bigint) as num_substitutions,
cast(case c when 'moved' then 1 else 0 end as bigint) as num_insertions, cast(case c when 'moved' then 1 else 0 end as bigint) as num_deletions,
cast(case c when 'both' then 0 when 'none' then 2 when 'moved' then 2 else 1 end as bigint) as num_edits,
cast(case c when 'moved' then 3 else 2 end as bigint) as num_ops from ({_CASE})"""
_SCRIPTS = oracle.scripts(_PAIRS, _sql_normal_tokens)


def _turn_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).alignments("levenshtein")


@_query("edit_op_counts_parts", _COUNTS)
def edit_op_counts_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).metrics.levenshtein().examples().drop("alignment")


@_query("edit_op_counts", f"{_SCRIPTS} {oracle.counts()}")
def edit_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).metrics.levenshtein().examples().drop("alignment")


@_query("edit_ops", f"{_SCRIPTS} select ex_id, o as op, type, rt as ref, ht as hyp, i as ref_idx, j as hyp_idx from ops")
def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.op_rows(_turn_ops(spark, sf_dir)).select("ex_id", "op", "type", "ref", "hyp", "ref_idx", "hyp_idx")


@_query("edit_op_totals", f"select cast(sum(num_edits) as bigint) as num_edits, cast(sum(ref_length) as bigint) as ref_length from ({_sql_wer(_PAIRS, _sql_normal_tokens)})")
def edit_op_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts' edits are the distances, and each reference token is in one operation."""
    types = _turn_ops(spark, sf_dir).select(F.col("ops.type").alias("types"))
    n = lambda *kinds: F.sum(F.size(F.filter("types", lambda t: t.isin(*kinds)))).cast("long")
    return types.agg(n(A.INSERT, A.DELETE, A.SUBSTITUTE).alias("num_edits"), n(A.MATCH, A.DELETE, A.SUBSTITUTE).alias("ref_length"))


@_query("op_types", f"{_SCRIPTS} select type, case type when 'MATCH' then 0 when 'INSERT' then 1 when 'DELETE' then 2 else 3 end as type_id, count(*) as n from ops group by type")
def op_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the types, and how many operations of each there are."""
    ids = F.create_map(*(F.lit(x) for pair in A.OP_TYPES.items() for x in pair))
    return writers.op_rows(_turn_ops(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n")).select("type", ids[F.col("type")].alias("type_id"), "n")


def _index_map(side: str, column: str) -> None:
    @_query(f"{side}_index_map", f"{_SCRIPTS} select ex_id, {column} as token, max(o) as op from ops where {column} is not null group by ex_id, {column}")
    def index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _turn_ops(spark, sf_dir).select("ex_id", F.explode(A.index_mapping(F.col("ops"), side)).alias("token", "op"))


_index_map("ref", "i")
_index_map("hyp", "j")


@_query(
    "ops_from_ref_index",
    f"""{_SCRIPTS} select b.ex_id, count(o.o) as n_ops, cast(count(o.o) filter (o.type = 'INSERT') as bigint) as n_insertions from paired b join ops first on first.ex_id = b.ex_id and first.i = 0
 join ops last on last.ex_id = b.ex_id and last.i = len(b.r) // 2 join ops o on o.ex_id = b.ex_id and o.o between first.o and last.o group by b.ex_id""",
)
def ops_from_ref_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations from a reference's first token to its middle one, with the insertions between them."""
    d = conversations(spark, sf_dir)
    sizes = d.token_strings(_DEFAULT).select("ex_id", F.floor(F.size("ref") / 2).cast("int").alias("middle")).where(F.size("ref") > 0)
    part = d.alignments("levenshtein").join(sizes, "ex_id").select("ex_id", A.ops_between(F.col("ops"), F.lit(0), F.col("middle")).alias("part"))
    return part.select("ex_id", F.size("part").cast("long").alias("n_ops"), A.count(F.col("part"), A.INSERT).alias("n_insertions"))


_TURN_SPANS = oracle.spans(_sql_standard("ref"), _SQL_TOKENS["default"], _sql_normal, "ex_id", f"({_PAIRS})")


@_query("op_by_char_offset", f"select ex_id, n[1] as at_start, n[-1] as at_end from {_TURN_SPANS} where len(t) > 0 and length(p[1]) = length(t[1])")
def op_by_char_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations at the offsets where a reference's first token starts and its last one ends; texts that begin with a token."""
    d = conversations(spark, sf_dir)
    at = d.tokenized(_DEFAULT).select("ex_id", F.element_at("ref", -1)["end"].alias("stop")).where(F.get("ref", F.lit(0))["start"] == 0)
    ops = d.alignments("levenshtein").join(at, "ex_id")
    return ops.select("ex_id", A.op_at(F.col("ops"), F.lit(0))["ref"].alias("at_start"), A.op_at(F.col("ops"), F.col("stop"), True)["ref"].alias("at_end"))


@_query(
    "op_constraints",
    f"{_SCRIPTS} select count(*) as n, cast(sum(good) as bigint) as n_valid from (select b.ex_id, case when coalesce(bool_and(case type when 'INSERT' then rt is null and ht is not null when 'DELETE' then rt is not null and ht is null else rt is not null and ht is not null end), true) then 1 else 0 end as good from paired b left join ops o on b.ex_id = o.ex_id group by b.ex_id)",
)
def op_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_ops(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(A.valid(F.col("ops"))).alias("n_valid"))


@_query("alignment_slice", f"{_SCRIPTS} select b.ex_id, cast(count(o.o) filter (type = 'MATCH') as bigint) as num_matches, cast(count(o.o) filter (type <> 'MATCH') as bigint) as num_edits from paired b left join ops o on b.ex_id = o.ex_id and o.o between 2 and 11 group by b.ex_id")
def alignment_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an alignment's third to twelfth operation."""
    ops = _turn_ops(spark, sf_dir).select("ex_id", F.slice("ops", 3, 10).alias("ops"))
    return ops.select("ex_id", *(A.counts(F.col("ops"))[k].alias(k) for k in ("num_matches", "num_edits")))


_STARTS = f"""select ex_id, r, h, list_transform(range(1, len(r) + 1), lambda k: case when k = 1 then 0 else list_sum(list_transform(r[1:k - 1], lambda x: length(x) + 1)) end) as rs,
 list_transform(range(1, len(h) + 1), lambda k: case when k = 1 then 0 else list_sum(list_transform(h[1:k - 1], lambda x: length(x) + 1)) end) as hs from paired"""


@_query(
    "alignment_json",
    f"""{oracle.scripts(_PARTS, lambda c: f"string_split({c}, ' ')")} select ex_id, to_json(list(struct_pack("type" := type, ref := rt, hyp := ht, ref_idx := i, hyp_idx := j, ref_start := cast(rs[i + 1] as int),
 ref_end := cast(rs[i + 1] + length(rt) as int), hyp_start := cast(hs[j + 1] as int), hyp_end := cast(hs[j + 1] + length(ht) as int), hyp_lp := false, hyp_rp := false, ref_lp := false, ref_rp := false) order by o)) as json
 from ops join ({_STARTS}) using (ex_id) group by ex_id""",
)
def alignment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).alignments("levenshtein").select("ex_id", writers.json_ops(F.col("ops")).alias("json"))


@_query("error_align_ops")
def error_align_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compound aligner is our own, with costs that no SQL restates."""
    return conversations(spark, sf_dir).metrics.error_align().examples().drop("alignment")


# --- key terms --------------------------------------------------------------------------------------------------------
def _kt(name: str, sql: str | None, **options) -> None:
    vocab = options.pop("vocab")

    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parts(spark, sf_dir).key_term_matches(vocab, _KEY_TERM, **options)


_SIDES = f"select ex_id, 'ref' as side, ref as name from ({_PARTS}) union all select ex_id, 'hyp', hyp from ({_PARTS})"
_NOUN = "select distinct string_split(p_name, ' ')[2] as noun from part"
_FOUND = f"select ex_id, side, 'nouns' as vocab, cast(w.i - 1 as int) as s, cast(w.i as int) as e from (select ex_id, side, unnest(list_transform(string_split(name, ' '), lambda x, i: struct_pack(t := x, i := i))) as w from ({_SIDES})) join ({_NOUN}) on w.t = noun"
_kt("kt_matches", f"select ex_id, side, 'names' as vocab, cast(0 as int) as s, cast(2 as int) as e from ({_SIDES})", vocab="names")
_kt("kt_matches_subset", _FOUND, vocab="nouns", allow_subset_matches=True)


@_query("kt_matches_local", f"select ex_id, side, 'medical_terms' as vocab, cast(w.i - 1 as int) as s, cast(w.i as int) as e from (select ex_id, side, noun, unnest(list_transform(string_split(name, ' '), lambda x, i: struct_pack(t := x, i := i))) as w from (select s.ex_id, s.side, s.name, string_split(p.ref, ' ')[2] as noun from ({_SIDES}) s join ({_PARTS}) p on s.ex_id = p.ex_id)) where w.t = noun")
def kt_matches_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_with_own_terms(spark, sf_dir).key_term_matches("medical_terms", _KEY_TERM, only_local_matches=True)


@_query("kt_not_found", f"select ex_id, 'own' as vocab, string_split(hyp, ' ')[2] as term from ({_PARTS}) where not list_contains(string_split(ref, ' '), string_split(hyp, ' ')[2])")
def kt_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each example's own term is its hypothesis's second word, which the reference may not have."""
    pairs = part_pairs(spark, sf_dir).withColumn("key_terms", F.create_map(F.lit("own"), F.array(F.element_at(F.split("hyp", " "), 2))))
    return EvalSet(pairs, names=frozenset(["own"])).key_terms_not_found("own", _KEY_TERM)


@_query("kt_patterns", "select vocab, array_to_string(toks, ' ') as pattern, cast(len(toks) as int) as n from (select distinct vocab, string_split(term, ' ') as toks from (select 'names' as vocab, p_name as term from part union all select 'nouns', string_split(p_name, ' ')[2] from part))")
def kt_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir)
    both = d.terms(_KEY_TERM, "names").unionByName(d.terms(_KEY_TERM, "nouns"))
    return M.patterns(both).select("vocab", F.array_join("toks", " ").alias("pattern"), "n")


@_query("vocabs_by_example", f"select ex_id, 'names,nouns' as vocabs from ({_PARTS})")
def vocabs_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).vocabs_by_example().select("ex_id", F.array_join(F.array_sort("vocabs"), ",").alias("vocabs"))


@_query("kt_document_matches", f"select doc_id as ex_id, count(*) as n from (select doc_id, unnest({_sql_tokens('lower(text)', 'key_term')}) as t from documents) where t in (select distinct {_sql_normal('w')} from (select unnest({_sql_tokens(_sql_standard('text'), 'key_term')}) as w from benchmark)) group by doc_id")
def kt_document_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences in whole documents of every word of the benchmark's passages."""
    bench = _read(spark, sf_dir, "benchmark").select(F.explode(config.strings(_PIPELINES, _KEY_TERM, F.col("text"))).alias("w"))
    terms = M.patterns(bench.select(F.lit("words").alias("vocab"), F.array("w").alias("toks")))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ex_id"), F.lit("ref").alias("side"), _PIPELINES.tokenizers["key_term"].tokens(F.lower("text")).alias("toks"))
    return M.occurrences(docs, terms).groupBy("ex_id").agg(F.count("*").alias("n"))


_MATCHED = f"select *, c in ('both', 'first', 'moved') as m1, c in ('both', 'second') as m2, c in ('both', 'first') as n1, c in ('both', 'second', 'moved') as n2 from ({_CASE})"
_is = lambda w: f"(case when {w} in (select noun from ({_NOUN})) then 1 else 0 end)"
_b = lambda c: f"(case when {c} then 1 else 0 end)"
_KT = f"""select ex_id, cast({_is('r1')} + {_is('r2')} as bigint) as num_ref_terms, cast({_is('h1')} + {_is('h2')} as bigint) as num_hyp_terms,
cast({_is('r1')} * {_b('m1')} + {_is('r2')} * {_b('m2')} as bigint) as num_tp,
cast({_is('r1')} * {_b('not m1')} + {_is('r2')} * {_b('not m2')} as bigint) as num_fn,
cast({_is('h1')} * {_b('not n1')} + {_is('h2')} * {_b('not n2')} as bigint) as num_fp from ({_MATCHED})"""
_KT_NAMES = ("num_ref_terms", "num_hyp_terms", "num_tp", "num_fn", "num_fp")
_KT_SUM = f"select {_sums(*_KT_NAMES)} from ({_KT})"
_metric("kt_stats", parts, "_kt_stats", _KT, _KT_SUM, vocab="nouns")
_safe = lambda a, b, z="0.0": f"case when ({b}) = 0 then {z} else ({a}) / ({b}) end"
_SCORES = {
    "kter": (_safe("num_fn", "num_ref_terms", "cast(num_fn as double)"), {}),
    "ktr": (_safe("num_tp", "num_tp + num_fn"), {}),
    "ktp": (_safe("num_tp", "num_tp + num_fp"), {}),
    "ktf_b1": (_safe("2.0::double * num_tp", "2.0::double * num_tp + 1.0::double * num_fn + num_fp"), {"beta": 1.0}),
    "ktf_b2": (_safe("5.0::double * num_tp", "5.0::double * num_tp + 4.0::double * num_fn + num_fp"), {"beta": 2.0}),
}
for _name, (_expr, _params) in _SCORES.items():
    _metric(_name, parts, _name.split("_")[0], f"select *, cast({_expr} as double) as value from ({_KT})", f"select cast({_expr} as double) as value from ({_KT_SUM})", vocab="nouns", **_params)
_metric("ktr_local", parts_with_own_terms, "ktr", rows=False, vocab="medical_terms", only_local_matches=True)
_metric("rktr_t0", parts, "rktr", vocab="nouns", threshold=0.0)
_metric("rktr_t02", parts, "rktr", vocab="nouns", threshold=0.2)
_metric("ktcer", parts, "ktcer", vocab="nouns")
_metric("rkt_stats", parts, "_rkt_stats", None, f"select cast(sum(num_ref_terms) as bigint) as num_ref_terms from ({_KT})", rows=False, vocab="nouns")
_metric("legacy_kwa", parts_with_own_terms, "_legacy_kwa", total=False)
_metric("legacy_medical_word_accuracy", parts_with_own_terms, "legacy_medical_word_accuracy", None, f"select count(*) filter (list_contains(string_split(hyp, ' '), string_split(ref, ' ')[2])) / count(*) as value from ({_PARTS})", rows=False)
_metric("legacy_relaxed_medical_word_accuracy", parts_with_own_terms, "legacy_relaxed_medical_word_accuracy", rows=False)
_metric("legacy_keyword_cer", parts_with_own_terms, "legacy_keyword_cer", rows=False)
_metric("hallucination", parts, "_legacy_hlcn", total=False)
_metric("legacy_deletions", parts, "legacy_deletions", rows=False)
_metric("legacy_del_hallucinations", parts, "legacy_del_hallucinations", rows=False)


# --- key terms in conversations ---------------------------------------------------------------------------------------
def turn_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vocab, term): the first word, the first three words and the third and fourth word of each turn."""
    words = F.split("text", " ")
    t = _read(spark, sf_dir, "conversations").where("text is not null").select(F.explode(F.array(*(F.array_join(F.slice(words, a, n), " ") for a, n in ((1, 1), (1, 3), (3, 2))))).alias("term"))
    return t.select(F.lit("openings").alias("vocab"), "term").distinct()


def turns_with_terms(spark: SparkSession, sf_dir: str) -> EvalSet:
    return conversations(spark, sf_dir).add_key_term_table(turn_vocabulary(spark, sf_dir), ["openings"])


_KEY_NORMAL = lambda c: _sql_normal_tokens(c, "key_term")
_OPENINGS = f"""select distinct toks from (select {_KEY_NORMAL('term')} as toks from (select distinct array_to_string(x, ' ') as term from (
 select unnest([w[1:1], w[1:3], w[3:4]]) as x from (select string_split(text, ' ') as w from conversations where text is not null)))) where len(toks) > 0"""
_KEY_SCRIPTS = oracle.scripts(_PAIRS, _KEY_NORMAL)
#: A word between spaces may be several tokens ("well-known"), so terms of three words have up to nine.
_TURN_MATCHES, _TURN_SUBSETS = (_KEY_SCRIPTS + oracle.matches(_OPENINGS, 9, subset) for subset in (False, True))
_FOUND_TURNS = "select ex_id, side, 'openings' as vocab, cast(s as int) as s, cast(e as int) as e from found"


@_query("kt_turn_matches", f"{_TURN_MATCHES} {_FOUND_TURNS}")
def kt_turn_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of terms of several lengths, of which the longer ones hold shorter ones."""
    return turns_with_terms(spark, sf_dir).key_term_matches("openings", _KEY_TERM)


@_query("kt_turn_matches_subset", f"{_TURN_SUBSETS} {_FOUND_TURNS}")
def kt_turn_matches_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_with_terms(spark, sf_dir).key_term_matches("openings", _KEY_TERM, allow_subset_matches=True)


_TURN_KT = f"{_TURN_MATCHES}, stats as ({oracle.term_stats()})"
_metric("kt_turn_stats", turns_with_terms, "_kt_stats", f"{_TURN_KT} select * from stats", f"{_TURN_KT} select {_sums(*_KT_NAMES)} from stats", vocab="openings")
for _name in ("kter", "ktr", "ktp", "ktf_b2"):
    _expr, _params = _SCORES[_name]
    _metric(f"{_name}_turns", turns_with_terms, _name.split("_")[0], None, f"{_TURN_KT} select cast({_expr} as double) as value from (select {_sums(*_KT_NAMES)} from stats)", rows=False, vocab="openings", **_params)
for _name in ("rktr", "ktcer"):
    _metric(f"{_name}_turns", turns_with_terms, _name, rows=False, vocab="openings")


# --- framework, sources and reports ---------------------------------------------------------------------------------
@_query("metric_catalog")
def metric_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(catalog(), "name string, short_name string, long_name string, main string, other string, example_main string, example_other string")


@_query("metric_names")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with parameters, of metrics that have them."""
    made = [METRICS.metadata[n]["cls"](name=n, **({"vocab": "nouns"} if "vocab" in getattr(METRICS.metadata[n]["cls"].param_schema, "__dataclass_fields__", {}) else {})) for n in METRICS.names(True)]
    return spark.createDataFrame([(m.name, m.short_name, m.long_name) for m in made], "name string, short_name string, long_name string")


@_query("dataset_views", f"select count(*) as n_examples, cast(sum(length(ref)) as bigint) as ref_chars, cast(sum(length(hyp)) as bigint) as hyp_chars from ({_PAIRS})")
def dataset_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).pairs.agg(F.count("*").alias("n_examples"), F.sum(F.length("ref")).alias("ref_chars"), F.sum(F.length("hyp")).alias("hyp_chars"))


@_query("load_table", "select a.conv_id * 1000000 + a.turn as ex_id, a.text as ref, a.role as hyp, a.role as own_term from conversations a where a.text is not null and a.role is not null")
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any table as pairs, with a column of key terms."""
    from ..sources.readers import from_dataframe

    rows = _read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000000 + F.col("turn"))
    d = from_dataframe(rows, "text", "role", ["role"], "id", nulls="drop")
    return d.pairs.select("ex_id", "ref", "hyp", F.get(F.element_at("key_terms", F.lit("role")), F.lit(0)).alias("own_term"))


@_query("html_lines")
def html_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.rendered(parts(spark, sf_dir)).select("ex_id", F.posexplode("lines").alias("line", "x")).select("ex_id", "line", "x.ref", "x.hyp")


@_query("language_tokens_fr", f"select doc_id, array_to_string(list_transform({_sql_tokens(_sql_standard('text'), 'key_term')}, lambda t: {_sql_normal('t', 'àâäçéèêëîïôöùûüÿœæ')}), ' ') as norms from documents")
def language_tokens_fr(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Pipelines.of(config.load_config(language="fr"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(config.strings(own, _DEFAULT, F.col("text")), " ").alias("norms"))
