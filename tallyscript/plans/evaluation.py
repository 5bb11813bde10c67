"""EvalSet: a table of (reference, hypothesis) pairs with its vocabularies, pipelines and metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .config import PipelineKey, Pipelines

PAIR = "ex_id long, ref string, hyp string, key_terms map<string,array<string>>"


class EvalSet:
    """Immutable: what adds examples or terms gives a new set.

    `pairs` has ex_id, ref, hyp and key_terms. Null texts: "error" makes a query over them fail, "empty" reads them
    as empty, "drop" leaves such examples out.
    """

    def __init__(self, pairs: DataFrame, vocab: DataFrame | None = None, *, config: str | dict | None = None, language: str | None = None, nulls: str = "error", pipelines: Pipelines | None = None, names: frozenset[str] = frozenset()) -> None:
        if nulls not in ("error", "empty", "drop"):
            raise ValueError("nulls must be error, empty or drop")
        spark = pairs.sparkSession
        if "key_terms" not in pairs.columns:
            pairs = pairs.withColumn("key_terms", F.lit(None).cast("map<string,array<string>>"))
        pairs = pairs.select("ex_id", "ref", "hyp", "key_terms")
        checked = {
            "error": lambda c: F.when(c.isNull(), F.raise_error(F.lit("a text is null"))).otherwise(c),
            "empty": lambda c: F.coalesce(c, F.lit("")),
            "drop": lambda c: c,
        }[nulls]
        if nulls == "drop":
            pairs = pairs.where("ref is not null and hyp is not null")
        self.spark, self.nulls = spark, nulls
        self.pairs = pairs.withColumns({"ref": checked(F.col("ref")), "hyp": checked(F.col("hyp"))})
        self.own_vocab = vocab if vocab is not None else spark.createDataFrame([], "vocab string, term string")
        self.config, self.language = config, language
        self.pipelines = pipelines or Pipelines.of(C.load_config(config, language))
        self.names = names
        self._cache: dict = {}

    def _with(self, pairs: DataFrame, vocab: DataFrame, names: frozenset[str]) -> EvalSet:
        return EvalSet(pairs, vocab, config=self.config, language=self.language, nulls=self.nulls, pipelines=self.pipelines, names=names)

    def balanced(self) -> EvalSet:
        """The same examples, spread evenly over as many tasks as the session's shuffles have: for long texts in few files."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._with(self.pairs.repartition(n, "ex_id"), self.own_vocab, self.names)

    def add(self, ref: str, hyp: str, key_terms: dict[str, Iterable[str]] | None = None, ex_id: int | None = None) -> EvalSet:
        """One more example, numbered after the others unless ex_id is given."""
        at = self.pairs.agg(F.coalesce(F.max("ex_id"), F.lit(-1))).first()[0] + 1 if ex_id is None else ex_id
        terms = {k: sorted(set(v)) for k, v in (key_terms or {}).items()}
        row = self.spark.createDataFrame([(at, ref, hyp, {k: v for k, v in terms.items() if v} or None)], PAIR)
        return self._with(self.pairs.unionByName(row), self.own_vocab, self.names | set(terms))

    def add_key_term_list(self, name: str, terms: Iterable[str]) -> EvalSet:
        if isinstance(terms, str) or not hasattr(terms, "__iter__"):
            raise TypeError("terms must be a list or another iterable of strings, not one string")
        terms = list(terms)
        if not all(isinstance(t, str) for t in terms):
            raise TypeError("every term must be a string")
        more = self.spark.createDataFrame([(name, t) for t in dict.fromkeys(terms)], "vocab string, term string")
        return self._with(self.pairs, self.own_vocab.unionByName(more), self.names | {name})

    def add_key_term_table(self, vocab: DataFrame, names: Iterable[str]) -> EvalSet:
        """vocab (vocab, term), of any size; its vocabularies' names are given, so that no job is needed to know them."""
        return self._with(self.pairs, self.own_vocab.unionByName(vocab.select("vocab", "term")), self.names | set(names))

    def add_key_term_file(self, name: str, path: str) -> EvalSet:
        from ..sources.readers import read_terms

        return self.add_key_term_table(read_terms(self.spark, path, name), [name])

    # --- vocabularies -----------------------------------------------------------------------------------------
    @property
    def local_terms(self) -> DataFrame:
        """(ex_id, vocab, term) of the examples' own terms."""
        return self.pairs.select("ex_id", F.explode("key_terms").alias("vocab", "terms")).select("ex_id", "vocab", F.explode("terms").alias("term"))

    @property
    def vocab(self) -> DataFrame:
        """(vocab, term) of all vocabularies: examples' own terms belong to everyone's."""
        return self.own_vocab.unionByName(self.local_terms.select("vocab", "term")).distinct()

    def check_vocab(self, name: str) -> None:
        if name in self.names:
            return
        if not self.pairs.where(F.map_contains_key(F.coalesce("key_terms", F.create_map().cast("map<string,array<string>>")), F.lit(name))).head(1) and not self.own_vocab.where(F.col("vocab") == name).head(1):
            raise ValueError(f"there is no vocabulary {name!r}; common ones are: {', '.join(sorted(self.names)) or 'none'}")

    def vocabs_by_example(self) -> DataFrame:
        """(ex_id, vocabs): the names of an example's own vocabularies and the common ones."""
        common = F.array(*(F.lit(n) for n in sorted(self.names))) if self.names else F.array().cast("array<string>")
        return self.pairs.select("ex_id", F.array_union(F.coalesce(F.map_keys("key_terms"), F.array().cast("array<string>")), common).alias("vocabs"))

    # --- plans ------------------------------------------------------------------------------------------------
    def shared(self, key: tuple, build) -> DataFrame:
        """The same DataFrame for the same key, so that metrics share sub-plans."""
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def key(self, standardizer: str = C.DEFAULT, tokenizer: str = C.DEFAULT, normalizer: str = C.DEFAULT) -> PipelineKey:
        for kind, name in (("standardizers", standardizer), ("tokenizers", tokenizer), ("normalizers", normalizer)):
            self.pipelines.pick(kind, name)
        return PipelineKey(standardizer, tokenizer, normalizer)

    def standardized(self, key: PipelineKey, c: Column | str) -> Column:
        return self.pipelines.pick("standardizers", key.standardizer)(F.col(c) if isinstance(c, str) else c)

    def tokenized(self, key: PipelineKey) -> DataFrame:
        """ex_id, key_terms, and both sides' tokens as array<struct<idx, start, end, raw, norm>>."""
        return self.shared(("tokens", key), lambda: self.pairs.select("ex_id", "key_terms", C.tokens(self.pipelines, key, F.col("ref")).alias("ref"), C.tokens(self.pipelines, key, F.col("hyp")).alias("hyp")))

    def token_strings(self, key: PipelineKey, normalized: bool = True) -> DataFrame:
        """ex_id and both sides' tokens as array<string>."""
        return self.shared(("strings", key, normalized), lambda: self.pairs.select("ex_id", *(C.strings(self.pipelines, key, F.col(c), normalized).alias(c) for c in ("ref", "hyp"))))

    def terms(self, key: PipelineKey, vocab: str, normalized: bool = True) -> DataFrame:
        """(vocab, term, toks) of a vocabulary under a pipeline."""
        return self.vocab.where(F.col("vocab") == vocab).select("vocab", "term", C.strings(self.pipelines, key, F.col("term"), normalized).alias("toks"))

    def key_term_matches(self, vocab: str, key: PipelineKey = PipelineKey(), *, normalized: bool = True, add_capitalized: bool = False, allow_subset_matches: bool = False, only_local_matches: bool = False, strict_local: bool = False) -> DataFrame:
        """(ex_id, side, vocab, s, e): token spans of the vocabulary's terms in references and hypotheses."""
        from ..operators import terms as M

        return M.as_rows(self.key_term_spans(vocab, key, normalized=normalized, add_capitalized=add_capitalized, allow_subset_matches=allow_subset_matches, only_local_matches=only_local_matches, strict_local=strict_local))

    def key_term_spans(self, vocab: str, key: PipelineKey = PipelineKey(), *, normalized: bool = True, add_capitalized: bool = False, allow_subset_matches: bool = False, only_local_matches: bool = False, strict_local: bool = False) -> DataFrame:
        """(ex_id, spans): the same, a row per example that has a match; spans is array<struct<vocab, side, s, e>>."""
        from ..operators import terms as M

        patterns = M.patterns(self.terms(key, vocab, normalized), add_capitalized and not normalized)
        return M.matches_by_example(
            self._sides(key, normalized), patterns, self._local(key, vocab, normalized) if only_local_matches else None,
            allow_subset_matches=allow_subset_matches, only_local_matches=only_local_matches, strict_local=strict_local,
        )

    def _sides(self, key: PipelineKey, normalized: bool) -> DataFrame:
        both = self.token_strings(key, normalized)
        return both.select("ex_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("toks")) for s in ("ref", "hyp")))).alias("x")).select("ex_id", "x.*")

    def _local(self, key: PipelineKey, vocab: str, normalized: bool) -> DataFrame:
        own = self.local_terms.where(F.col("vocab") == vocab)
        return own.select("ex_id", "vocab", "term", C.strings(self.pipelines, key, F.col("term"), normalized).alias("toks"))

    def key_terms_not_found(self, vocab: str, key: PipelineKey = PipelineKey(), *, normalized: bool = True) -> DataFrame:
        """(ex_id, vocab, term) of the examples' own terms that their reference doesn't hold."""
        from ..operators import terms as M

        found = M.occurrences(self._sides(key, normalized).where("side = 'ref'"), M.patterns(self.terms(key, vocab, normalized)))
        return M.not_found(found, self._local(key, vocab, normalized))

    def alignments(self, kind: str = "levenshtein", key: PipelineKey = PipelineKey(), normalized: bool = True) -> DataFrame:
        """(ex_id, ops): kind is levenshtein or error_align."""
        from ..operators import align as A

        make = {"levenshtein": A.edit_script, "error_align": A.compound_align}[kind]
        return self.shared(("ops", kind, key, normalized), lambda: self.tokenized(key).select("ex_id", make(F.col("ref"), F.col("hyp"), normalized).alias("ops")))

    def __len__(self) -> int:
        return self.pairs.count()

    @property
    def metrics(self):
        from .metrics import MetricCollection

        return self.shared(("metrics",), lambda: MetricCollection(self))
