"""The metrics by name: word and character error rates, key-term scores, and those of older reports."""

from __future__ import annotations

import string
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences
from ..operators import align as A
from ..operators.distance import char_distance, token_distance
from .registry import METRICS, Metric, MetricCollection, MetricParams, Value, ratio

__all__ = ["METRICS", "Metric", "MetricCollection", "MetricParams", "Value"]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def _sum(name: str) -> Column:
    return _zero(F.sum(name))


@dataclass
class Normalized(MetricParams):
    normalized: bool = True


class _ErrorRate(Metric):
    param_schema = Normalized
    example_values = (Value("num_edits"), Value("ref_length"), Value("value", main=True))
    values = (Value("num_edits"), Value("ref_length"), Value("value", main=True))

    def aggregates(self) -> dict[str, Column]:
        return {"num_edits": _sum("num_edits"), "ref_length": _sum("ref_length")}

    def finish(self) -> dict[str, Column]:
        edits, length = F.col("num_edits"), F.col("ref_length")
        return {"num_edits": edits, "ref_length": length, "value": ratio(edits, length, edits.cast("double"))}


@METRICS.register("wer")
class WER(_ErrorRate):
    short_name_base, long_name_base = "WER", "Word Error Rate"
    description = "Token edits per reference token."

    def rows(self) -> DataFrame:
        both = self.dataset.token_strings(self.key, self.params.normalized)
        out = both.select("ex_id", token_distance(F.col("ref"), F.col("hyp")).alias("num_edits"), F.size("ref").cast("long").alias("ref_length"))
        return out.withColumn("value", ratio(F.col("num_edits"), F.col("ref_length"), F.col("num_edits").cast("double")))


@METRICS.register("cer")
class CER(_ErrorRate):
    short_name_base, long_name_base = "CER", "Character Error Rate"
    description = "Character edits per character of the joined reference tokens."

    def rows(self) -> DataFrame:
        both = self.dataset.tokenized(self.key)
        texts = both.select("ex_id", *(sequences.joined(F.col(c), self.params.normalized).alias(c) for c in ("ref", "hyp")))
        out = texts.select("ex_id", char_distance(F.col("ref"), F.col("hyp")).alias("num_edits"), F.length("ref").cast("long").alias("ref_length"))
        return out.withColumn("value", ratio(F.col("num_edits"), F.col("ref_length"), F.col("num_edits").cast("double")))


for _suffix, _normalizer in (("", "legacy"), ("_uncased", "legacy_uncased"), ("_uncased_no_punct", "legacy_uncased_no_punct")):
    METRICS.register_metric(WER, f"legacy_wer{_suffix}", tokenizer="legacy", normalizer=_normalizer)
    METRICS.register_metric(CER, f"legacy_cer{_suffix}", tokenizer="legacy", normalizer=_normalizer)


class _Alignment(Metric):
    param_schema = Normalized
    kind = ""
    example_values = (*(Value(f"num_{x}") for x in ("matches", "substitutions", "insertions", "deletions", "edits", "ops")), Value("alignment", main=True))

    def rows(self) -> DataFrame:
        ops = self.dataset.alignments(self.kind, self.key, self.params.normalized)
        return ops.select("ex_id", F.col("ops").alias("alignment"), *(c.alias(k) for k, c in A.counts(F.col("ops")).items()))


@METRICS.register("levenshtein")
class Levenshtein(_Alignment):
    short_name_base, long_name_base, kind = "Levenshtein", "Levenshtein Alignment", "levenshtein"
    description = "The edit script of the two token sequences."


@METRICS.register("error_align")
class ErrorAlign(_Alignment):
    short_name_base, long_name_base, kind = "Error Align", "Compound-aware Alignment", "error_align"
    description = "An alignment that may split a hypothesis token over several reference tokens."


@METRICS.register("summary")
class Summary(Metric):
    short_name_base, long_name_base = "Summary", "Dataset Summary"
    description = "Numbers of examples, words and characters."
    _names = ("num_ref_words", "num_ref_chars", "num_hyp_words", "num_hyp_chars")
    example_values = tuple(map(Value, _names))
    values = (Value("num_examples"), *map(Value, _names))

    def rows(self) -> DataFrame:
        d, key = self.dataset, self.key
        standard = d.pairs.select("ex_id", *(d.standardized(key, c).alias(c) for c in ("ref", "hyp")))
        words = d.pipelines.pick("tokenizers", key.tokenizer).tokens
        return standard.select("ex_id", *(x for c in ("ref", "hyp") for x in (F.size(words(F.col(c))).cast("long").alias(f"num_{c}_words"), F.length(c).cast("long").alias(f"num_{c}_chars"))))

    def aggregates(self) -> dict[str, Column]:
        return {"num_examples": F.count("*"), **{n: _sum(n) for n in self._names}}


# --- key terms ------------------------------------------------------------------------------------------------


@dataclass
class KeyTerms(MetricParams):
    vocab: str
    normalized: bool = True
    allow_subset_matches: bool = False
    only_local_matches: bool = False

    def validate(self, dataset) -> None:
        dataset.check_vocab(self.vocab)

    @property
    def shared(self) -> dict:
        return {"vocab": self.vocab, "normalized": self.normalized, "allow_subset_matches": self.allow_subset_matches, "only_local_matches": getattr(self, "only_local_matches", False)}


def _spans(metric: Metric, texts: DataFrame) -> DataFrame:
    """texts with a column spans: all matches of an example in one row, null if there are none."""
    p = metric.params
    found = metric.dataset.key_term_spans(p.vocab, metric.key, normalized=p.normalized, allow_subset_matches=p.allow_subset_matches, only_local_matches=p.only_local_matches)
    return texts.join(found, "ex_id", "left")


@METRICS.register("_kt_stats", tokenizer="key_term")
class KeyTermStats(Metric):
    short_name_base, long_name_base = "KT stats", "Key Term Statistics"
    description = "Key terms in references and hypotheses, and which of them are right."
    param_schema = KeyTerms
    _names = A.TERM_COUNTS
    example_values = values = tuple(map(Value, _names))

    def rows(self) -> DataFrame:
        both = _spans(self, self.dataset.token_strings(self.key, self.params.normalized))
        counted = both.select("ex_id", A.term_counts(F.col("ref"), F.col("hyp"), F.col("spans")).alias("n"))
        return counted.select("ex_id", *(F.col(f"n.{c}").alias(c) for c in self._names))

    def aggregates(self) -> dict[str, Column]:
        return {n: _sum(n) for n in self._names}


class _KeyTermScore(Metric):
    param_schema = KeyTerms
    example_values = values = (Value("value", main=True),)
    uses = ("_kt_stats",)

    def score(self) -> Column:
        raise NotImplementedError

    def rows(self) -> DataFrame:
        rows = self.dependency("_kt_stats", **KeyTerms.shared.fget(self.params)).examples()
        return rows.withColumn("value", self.score())

    def aggregates(self) -> dict[str, Column]:
        return {n: _sum(n) for n in KeyTermStats._names}

    def finish(self) -> dict[str, Column]:
        return {"value": self.score()}


@METRICS.register("kter", tokenizer="key_term")
class KTER(_KeyTermScore):
    short_name_base, long_name_base = "KTER", "Key Term Error Rate"
    description = "Missed key terms per key term of the reference."

    def score(self) -> Column:
        return ratio(F.col("num_fn"), F.col("num_ref_terms"), F.col("num_fn").cast("double"))


@METRICS.register("ktr", tokenizer="key_term")
class KTR(_KeyTermScore):
    short_name_base, long_name_base = "KTR", "Key Term Recall"
    description = "Key terms of the reference that are transcribed correctly."

    def score(self) -> Column:
        return ratio(F.col("num_tp"), F.col("num_tp") + F.col("num_fn"), 0.0)


@dataclass
class PrecisionParams(MetricParams):
    vocab: str
    normalized: bool = True
    allow_subset_matches: bool = False

    def validate(self, dataset) -> None:
        dataset.check_vocab(self.vocab)


@METRICS.register("ktp", tokenizer="key_term")
class KTP(_KeyTermScore):
    short_name_base, long_name_base = "KTP", "Key Term Precision"
    description = "Key terms of the hypothesis that were said."
    param_schema = PrecisionParams

    def score(self) -> Column:
        return ratio(F.col("num_tp"), F.col("num_tp") + F.col("num_fp"), 0.0)


@dataclass
class FScoreParams(KeyTerms):
    beta: float = 1.0

    def validate(self, dataset) -> None:
        if self.beta <= 0:
            raise ValueError("beta must be greater than 0")
        super().validate(dataset)


@METRICS.register("ktf", tokenizer="key_term")
class KTF(_KeyTermScore):
    short_name_base, long_name_base = "KTF", "Key Term F-score"
    description = "The weighted harmonic mean of key-term precision and recall."
    param_schema = FScoreParams

    def score(self) -> Column:
        b = float(self.params.beta) ** 2
        above = (1 + b) * F.col("num_tp")
        return ratio(above, above + b * F.col("num_fn") + F.col("num_fp"), 0.0)


@METRICS.register("_rkt_stats", tokenizer="key_term")
class RelaxedStats(Metric):
    short_name_base, long_name_base = "RKT stats", "Relaxed Key Term Statistics"
    description = "Character edits of each key term of the reference."
    param_schema = KeyTerms
    example_values = (Value("term_stats"), Value("num_ref_terms"))
    values = (Value("num_ref_terms"),)

    def rows(self) -> DataFrame:
        both = _spans(self, self.dataset.tokenized(self.key).select("ex_id", "ref", "hyp"))
        stats = both.select("ex_id", A.term_edits(F.col("ref"), F.col("hyp"), F.col("spans"), self.params.normalized).alias("term_stats"))
        return stats.withColumn("num_ref_terms", F.size("term_stats").cast("long"))

    def aggregates(self) -> dict[str, Column]:
        return {"num_ref_terms": _sum("num_ref_terms")}


@dataclass
class RelaxedParams(KeyTerms):
    threshold: float = 0.0

    def validate(self, dataset) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        super().validate(dataset)


@METRICS.register("rktr", tokenizer="key_term")
class RKTR(Metric):
    short_name_base, long_name_base = "RKTR", "Relaxed Key Term Recall"
    description = "Key terms of the reference whose character error rate is within the threshold."
    param_schema = RelaxedParams
    _names = ("num_tp", "num_ref_terms")
    example_values = values = (*map(Value, _names), Value("value", main=True))
    uses = ("_rkt_stats",)

    def rows(self) -> DataFrame:
        rows = self.dependency("_rkt_stats", **self.params.shared).examples()
        rate = lambda t: ratio(t["char_edits"], t["ref_chars"], t["char_edits"].cast("double"))
        good = F.size(F.filter("term_stats", lambda t: rate(t) <= self.params.threshold)).cast("long")
        return rows.select("ex_id", good.alias("num_tp"), "num_ref_terms").withColumn("value", ratio(F.col("num_tp"), F.col("num_ref_terms"), 0.0))

    def aggregates(self) -> dict[str, Column]:
        return {n: _sum(n) for n in self._names}

    def finish(self) -> dict[str, Column]:
        return {**{n: F.col(n) for n in self._names}, "value": ratio(F.col("num_tp"), F.col("num_ref_terms"), 0.0)}


@METRICS.register("ktcer", tokenizer="key_term")
class KTCER(Metric):
    short_name_base, long_name_base = "KTCER", "Key Term Character Error Rate"
    description = "Character edits per character of the reference's key terms."
    param_schema = KeyTerms
    _names = ("char_edits", "ref_chars")
    example_values = values = (*map(Value, _names), Value("value", main=True))
    uses = ("_rkt_stats",)

    def rows(self) -> DataFrame:
        rows = self.dependency("_rkt_stats", **self.params.shared).examples()
        add = lambda name: F.aggregate("term_stats", F.lit(0).cast("long"), lambda n, t: n + t[name])
        return rows.select("ex_id", *(add(n).alias(n) for n in self._names)).withColumn("value", ratio(F.col("char_edits"), F.col("ref_chars"), F.col("char_edits").cast("double")))

    def aggregates(self) -> dict[str, Column]:
        return {n: _sum(n) for n in self._names}

    def finish(self) -> dict[str, Column]:
        return {**{n: F.col(n) for n in self._names}, "value": ratio(F.col("char_edits"), F.col("ref_chars"), F.col("char_edits").cast("double"))}


# --- metrics of older reports -------------------------------------------------------------------------------------


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel addition."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        x = v & masks.get(c, 0)
        v = ((v + x) | (v - x)) & full
    return len(a) - v.bit_count()


def likeness(a: str, b: str) -> int:
    """How alike two strings are, from 0 to 100: twice their common subsequence over their lengths, rounded."""
    a, b = (" ".join("".join(c if c.isalnum() else " " for c in x).lower().strip().split(" ")) for x in (a, b))
    return round(100 * 2 * _common(a, b) / (len(a) + len(b))) if a and b else 0


_REMOVED = "".join(c for c in string.punctuation if c not in "-/")


def best_match(term: str, candidates: list[str]) -> str:
    """The first of the candidates that are most like the term; without punctuation, unless the term has some itself."""
    if not candidates:
        return ""
    best = max(candidates, key=lambda c: likeness(term, c))
    if not any(c in _REMOVED for c in term):
        best = best.translate(str.maketrans("", "", _REMOVED))
    return best.lower()


def _best_matches():
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<string>")
    def find(terms: pa.Array, words: pa.Array) -> pa.Array:
        rows = []
        for own, hyp in zip(terms.to_pylist(), words.to_pylist(), strict=True):
            out = []
            for t in own or []:
                n = len(t.split())
                out.append(best_match(t, [" ".join(hyp[i : i + k]) for k in range(1, n + 1) for i in range(len(hyp) - k + 1)]))
            rows.append(out)
        return pa.array(rows, pa.list_(pa.string()))

    return find


@dataclass
class AggregatorParams(MetricParams):
    cer_threshold: float = 0.2


@METRICS.register("_legacy_kwa", tokenizer="legacy", normalizer="legacy_uncased")
class KeywordAggregator(Metric):
    short_name_base, long_name_base = "kwa", "Keyword Aggregator"
    description = "Medical terms of the reference and how well the hypothesis has them."
    param_schema = AggregatorParams
    vocab = "medical_terms"
    _names = ("match_count", "relaxed_match_count", "total_terms", "total_length", "total_distance")
    example_values = (*map(Value, _names), Value("correct_terms"), Value("cer_keyword"))
    values = tuple(map(Value, _names))

    def rows(self) -> DataFrame:
        d, key = self.dataset, self.key
        terms = d.local_terms.where(F.col("vocab") == self.vocab)
        from . import config as C

        own = terms.select("ex_id", sequences.joined(C.tokens(d.pipelines, key, F.col("term"))).alias("term")).groupBy("ex_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
        texts = d.tokenized(key).join(own, "ex_id").select("ex_id", sequences.joined(F.col("ref")).alias("ref"), sequences.texts(F.col("hyp")).alias("words"), "terms")
        kept = texts.select("ex_id", "words", F.filter("terms", lambda t: F.contains(F.col("ref"), t)).alias("terms"))
        found = kept.select("ex_id", "terms", _best_matches()(F.col("terms"), F.col("words")).alias("best"))
        scored = F.transform(
            F.arrays_zip("terms", "best"),
            lambda x: F.struct(x["terms"].alias("term"), F.levenshtein(F.lower(x["terms"]), x["best"]).cast("long").alias("d"), F.greatest(F.length(x["terms"]), F.lit(1)).cast("long").alias("n")),
        )
        stats = found.select("ex_id", scored.alias("t"))
        size = lambda cond: F.size(F.filter("t", cond)).cast("long")
        add = lambda name: F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + t[name])
        per = stats.select(
            "ex_id", size(lambda t: t["d"] == 0).alias("match_count"), size(lambda t: t["d"] / t["n"] <= self.params.cer_threshold).alias("relaxed_match_count"),
            F.size("t").cast("long").alias("total_terms"), add("n").alias("total_length"), add("d").alias("total_distance"),
            F.transform(F.filter("t", lambda t: t["d"] == 0), lambda t: t["term"]).alias("correct_terms"),
        )
        rows = d.pairs.select("ex_id").join(per, "ex_id", "left")
        rows = rows.select("ex_id", *(_zero(F.col(n)).alias(n) for n in self._names), F.coalesce("correct_terms", F.array().cast("array<string>")).alias("correct_terms"))
        return rows.withColumn("cer_keyword", ratio(F.col("total_distance"), F.col("total_length"), 0.0))

    def aggregates(self) -> dict[str, Column]:
        return {n: _sum(n) for n in self._names}

    def correct_terms(self) -> DataFrame:
        """(ex_id, place, term): the whole set's correct terms, a row each, as there may be any number of them."""
        return self.examples().select("ex_id", F.posexplode("correct_terms").alias("place", "term"))


class _KeywordScore(Metric):
    values = (Value("value", main=True),)
    uses = ("_legacy_kwa",)
    above = below = ""

    def rows(self) -> DataFrame:
        return self.dependency("_legacy_kwa").examples()

    def aggregates(self) -> dict[str, Column]:
        return {self.above: _sum(self.above), self.below: _sum(self.below)}

    def finish(self) -> dict[str, Column]:
        return {"value": ratio(F.col(self.above), F.col(self.below), 1.0)}


@METRICS.register("legacy_medical_word_accuracy", tokenizer="legacy", normalizer="legacy_uncased")
class MedicalWordAccuracy(_KeywordScore):
    short_name_base, long_name_base = "MTR", "Medical Term Recall"
    description = "Medical terms that the hypothesis has exactly."
    above, below = "match_count", "total_terms"


@METRICS.register("legacy_relaxed_medical_word_accuracy", tokenizer="legacy", normalizer="legacy_uncased")
class RelaxedMedicalWordAccuracy(_KeywordScore):
    short_name_base, long_name_base = "RMTR", "Relaxed Medical Term Recall"
    description = "Medical terms that the hypothesis nearly has."
    above, below = "relaxed_match_count", "total_terms"


@METRICS.register("legacy_keyword_cer", tokenizer="legacy", normalizer="legacy_uncased")
class KeywordCER(_KeywordScore):
    short_name_base, long_name_base = "KCER", "Keyword Character Error Rate"
    description = "Character edits per character of the medical terms."
    above, below = "total_distance", "total_length"


@dataclass
class HallucinationParams(MetricParams):
    threshold: int = 2


@METRICS.register("_legacy_hlcn")
class Hallucinations(Metric):
    short_name_base, long_name_base = "Hallucination Insertions", "Hallucination Insertions"
    description = "Inserted tokens, and runs of more than `threshold` of them."
    param_schema = HallucinationParams
    example_values = (Value("insertions"), Value("has_contiguous_insertions"))

    def rows(self) -> DataFrame:
        ops = self.dataset.alignments("error_align", self.key, True)
        return ops.select("ex_id", A.count(F.col("ops"), A.INSERT).alias("insertions"), (A.longest_run(F.col("ops")) > self.params.threshold).alias("has_contiguous_insertions"))


class _HallucinationRate(Metric):
    values = (Value("value", main=True),)
    uses = ("_legacy_hlcn",)
    of = ""

    def rows(self) -> DataFrame:
        return self.dependency("_legacy_hlcn").examples()

    def aggregates(self) -> dict[str, Column]:
        """The mean; null for a dataset without examples."""
        return {"value": F.avg(F.col(self.of).cast("long"))}


@METRICS.register("legacy_deletions")
class Insertions(_HallucinationRate):
    """The name is that of older reports; what it averages are insertions."""

    short_name_base, long_name_base, of = "Insertions", "Insertions per Example", "insertions"
    description = "The mean number of inserted tokens."


@METRICS.register("legacy_del_hallucinations")
class ContiguousInsertions(_HallucinationRate):
    short_name_base, long_name_base, of = "Hallucinations", "Hallucination Rate", "has_contiguous_insertions"
    description = "The share of examples with a long run of insertions."
