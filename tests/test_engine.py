"""The evaluation engine on hand-made cases, and against a plain dynamic program."""

import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tallyscript.functions import sequences, text, tokens
from tallyscript.operators import align
from tallyscript.operators.distance import distances, token_distance
from tallyscript.plans import config
from tallyscript.plans.config import PipelineKey
from tallyscript.plans.evaluation import EvalSet
from tallyscript.plans.metrics import likeness
from tallyscript.plans.registry import METRICS, Metric, MetricParams, Value
from tallyscript.reporting import html, terminal
from tallyscript.sources import readers, writers


def pairs(spark, given, **options):
    rows = [(i, r, h) for i, (r, h) in enumerate(given)]
    return EvalSet(spark.createDataFrame(rows, "ex_id long, ref string, hyp string"), **options)


SAMPLE = [("hello world", "hello world"), ("the quick brown fox", "the quick brown dog"), ("testing one two three", "testing one two")]


@pytest.fixture(scope="module")
def sample(spark):
    return pairs(spark, SAMPLE)


def of(metric, name="value"):
    return [r[name] for r in metric.examples().orderBy("ex_id").collect()]


def test_wer_and_summary(spark, sample):
    wer = sample.metrics.wer()
    assert of(wer, "num_edits") == [0, 1, 1] and of(wer) == [0, 0.25, 0.25] and wer.value == 0.2
    assert sample.metrics.wer() is wer
    assert sample.metrics.get("summary").all_values() == {"num_examples": 3, "num_ref_words": 10, "num_ref_chars": 51, "num_hyp_words": 9, "num_hyp_chars": 45}
    assert of(pairs(spark, [("", "hello world")]).metrics.wer()) == [2.0]
    assert pairs(spark, [("hello", "goodbye"), ("world", "earth")]).metrics.wer().value == 1.0
    none = EvalSet(spark.createDataFrame([], "ex_id long, ref string, hyp string"))
    assert none.metrics.wer().all_values() == {"num_edits": 0, "ref_length": 0, "value": 0.0}
    assert none.metrics.legacy_deletions().value is None


def test_cer(spark):
    assert of(pairs(spark, [("ab, cd", "ab cx"), ("café", "cafe")]).metrics.cer()) == [0.2, 0.0]
    assert of(pairs(spark, [("café", "cafe")]).metrics.legacy_cer()) == [0.25]


@pytest.mark.parametrize(
    ("fn", "given", "expected"),
    [
        (text.lowercase, "MÜNCHEN", "münchen"), (text.nfc, "é", "é"), (text.strip_punctuation, "...hello!", "hello"), (text.strip_punctuation, "&hello%", "&hello%"),
        (text.strip_punctuation, "don't", "don't"), (text.strip_punctuation, "...", ""), (text.transliterate_latin_letters, "café æøå äöüß 日本 αβγ", "cafe aeoa aouss 日本 αβγ"),
        (text.transliterate_symbols, "€£“x”…", "€£\"x\"..."), (text.remove_symbols, "hello, $100", "hello 100"), (text.normalize_apostrophe_variants, "it’s", "it's"),
        (text.normalize_hyphen_variants, "state–of–the–art", "state-of-the-art"), (text.normalize_slash_variants, "input／output", "input/output"),
    ],
)
def test_text_functions(spark, fn, given, expected):
    assert spark.createDataFrame([(given,), (None,)], "t string").select(fn(F.col("t"))).collect() == [(expected,), (None,)]


@pytest.mark.parametrize(
    ("tokenizer", "given", "expected"),
    [
        (tokens.whitespace_pattern(), "hello, world! x", ["hello,", "world!", "x"]), (tokens.strip_punctuation_pattern(), "well-known", ["well-known"]),
        (tokens.strip_punctuation_pattern("-_"), "hello-world_test", ["hello", "world", "test"]), (tokens.strip_punctuation_keep_symbols_pattern(), "total: $99, or €89!", ["total", "$", "99", "or", "€", "89"]),
        (tokens.strip_punctuation_keep_symbols_pattern(), "a+b=c", ["a", "+", "b", "=", "c"]), (tokens.keep_symbols_and_punctuation_pattern(".,!?"), "A.I.\nx", ["A", ".", "I", ".", "\n", "x"]),
        (tokens.keep_symbols_and_punctuation_pattern(".", False), "a\nb", ["a", "b"]), (tokens.strip_punctuation_pattern(), "!!! ...", []),
    ],
)
def test_tokenizers(spark, tokenizer, given, expected):
    row = spark.createDataFrame([(given,)], "t string").select(tokenizer.tokens(F.col("t")).alias("a"), tokenizer.spans(F.col("t")).alias("s")).first()
    assert row["a"] == expected and [given[s["start"] : s["end"]] for s in row["s"]] == expected


def test_languages():
    keep = lambda lang: config.load_config(language=lang)["normalizers"]["default"]["transliterate_latin_letters"]
    assert keep("da") == {"preserve": "æøå"} and keep("en") is None
    with pytest.raises(ValueError, match="supported: da, de, en, fr"):
        config.load_config(language="xx")
    with pytest.raises(ValueError, match="unexpected"):
        config.step("lowercase", {"x": 1})
    with pytest.raises(ValueError, match="exactly one"):
        config.tokenizer("t", {"whitespace_pattern": None, "strip_punctuation_pattern": None})


def test_sequences(spark):
    key = PipelineKey()
    p = config.Pipelines.of(config.load_config())
    d = spark.createDataFrame([("The quick, brown the",)], "t string").select("t", config.tokens(p, key, F.col("t")).alias("k"))
    row = d.select(
        sequences.joined(F.col("k")).alias("j"), sequences.ngrams(F.col("k"), 2).alias("g"), sequences.ngrams(F.col("k"), 5).alias("none"), sequences.ngrams(F.col("k"), 2, False, True).alias("gj"),
        sequences.indices(F.col("k"), F.lit("the")).alias("i"), sequences.in_context(F.col("t"), F.lit(4), F.lit(9), 2, ("[", "]")).alias("c"),
    ).first()
    assert row["j"] == "the quick brown the" and row["g"] == [["the", "quick"], ["quick", "brown"], ["brown", "the"]] and row["none"] == []
    assert row["gj"] == ["The quick", "quick brown", "brown the"] and row["i"] == [0, 3] and row["c"] == "...e [quick], ..."


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_kept_columns_change_nothing(monkeypatch):
    rnd = random.Random(8)
    given = [([rnd.randrange(4) for _ in range(rnd.randrange(30))], [rnd.randrange(4) for _ in range(rnd.randrange(30))]) for _ in range(200)]
    whole = [align.script(*x) for x in given]
    monkeypatch.setattr(align, "KEPT", 3)
    assert [align.script(*x) for x in given] == whole


def test_all_distances():
    rnd = random.Random(9)
    a, b = (["".join(rnd.choice("abcé") for _ in range(rnd.randrange(n))) for _ in range(25)] for n in (9, 12))
    found = distances(a, b)
    assert all(found[i, j] == table(x, y) for i, x in enumerate(a) for j, y in enumerate(b))


def test_user_tokenizers_keep_gaps(spark):
    own = config.tokenizer("own", {f"{__name__}.word_pattern": None})
    live = config.Pipelines.of(config.load_config())
    live.register("tokenizers", "default", word_pattern)
    df = spark.createDataFrame([("  ab, cd\n\nef!",), ("",), (None,), ("..",)], "t string")
    spans = [None if r[0] is None else [(t["raw"], t["start"], t["end"]) for t in r[0]] for r in df.select(own.spans(F.col("t"))).collect()]
    assert spans == [[("ab", 2, 4), ("cd", 6, 8), ("ef", 10, 12)], [], None, []]
    assert df.select(sequences.joined(config.tokens(live, config.PipelineKey(), F.col("t")))).first()[0] == "ab cd ef"


def word_pattern():
    return r"(\w)\w*"


def test_noncharacters_in_tokens(spark):
    p = config.Pipelines.of(config.load_config())
    df = spark.createDataFrame([(["A\uffffB", "É"],), (["Ab", "«œ"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(p.normalizers["default"].over(F.col("t"))).collect()] == [["a\uffffb", "e"], ["ab", "<<oe"], [], None]


def test_compounds_of_many_parts():
    assert [x[:3] for x in align.compound_script(list("abcdefg"), ["abcdefg", "x"])] == [*((align.MATCH, i, 0) for i in range(7)), (align.INSERT, None, 1)]


def test_distance_and_script_against_dynamic_program(spark):
    rnd = random.Random(1)
    given = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]) for _ in range(120)]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(given)], "i long, r array<string>, h array<string>")
    found = {x["i"]: x["d"] for x in df.select("i", token_distance(F.col("r"), F.col("h")).alias("d")).collect()}
    assert all(found[i] == table(r, h) for i, (r, h) in enumerate(given))
    for r, h in given:
        kinds, at_ref, at_hyp = align.script(r, h)
        assert sum(k != 0 for k in kinds) == table(r, h)
        assert [r[i] for k, i in zip(kinds, at_ref) if k != 1] == r and [h[j] for k, j in zip(kinds, at_hyp) if k != 2] == h
        assert all(r[i] == h[j] for k, i, j in zip(kinds, at_ref, at_hyp) if k == 0)
        c = align.compound_script(r, h)
        assert [x[1] for x in c if x[1] is not None] == list(range(len(r)))
    assert align.script(["a", "b"], ["b", "a"])[0] == [1, 0, 2]


def test_alignment_algebra(spark):
    d = pairs(spark, [("hello world", "hello extra world")]).alignments()
    ops = F.col("ops")
    row = d.select(align.index_mapping(ops).alias("m"), align.ops_between(ops, F.lit(0), F.lit(1)).alias("b"), align.op_at(ops, F.lit(6)).alias("o"), align.valid(ops).alias("v"), writers.json_ops(ops).alias("j")).first()
    assert row["m"] == {0: 0, 1: 2} and [o["type"] for o in row["b"]] == ["MATCH", "INSERT", "MATCH"] and row["o"]["ref"] == "world" and row["v"] and '"ref":null' in row["j"]
    with pytest.raises(Exception, match="no operation for token"):
        d.select(align.ops_between(ops, F.lit(0), F.lit(99))).collect()


@pytest.mark.parametrize(
    ("ref", "hyp", "terms", "expected"),
    [
        ("the fox jumps", "the fox jumps", ["fox"], (1, 1, 1, 0, 0)), ("the fox jumps", "the dog jumps", ["fox"], (1, 0, 0, 1, 0)), ("the fox jumps", "the fox fox jumps", ["fox"], (1, 2, 1, 0, 1)),
        ("hello world", "hollow world", ["hello world", "world"], (1, 1, 0, 1, 0)), ("world", "wall", ["world", "wall"], (1, 1, 0, 1, 1)),
    ],
)
def test_key_terms(spark, ref, hyp, terms, expected):
    d = pairs(spark, [(ref, hyp)]).add_key_term_list("v", terms)
    assert tuple(d.metrics.get("_kt_stats", vocab="v").all_values().values()) == expected
    tp, fn, fp = expected[2:]
    assert d.metrics.ktf(vocab="v").value == (2 * tp / (2 * tp + fn + fp) if tp + fn + fp else 0.0)


def test_relaxed_terms(spark):
    d = pairs(spark, [("the patient has diabetes", "the patient has diabetis")]).add_key_term_list("v", ["diabetes"])
    assert [d.metrics.rktr(vocab="v", threshold=t).value for t in (0.125, 0.124, 0.0)] == [1.0, 0.0, 0.0]
    assert d.metrics.ktcer(vocab="v").value == 0.125
    for term, n in (("blood", 5), ("pressure", 8), ("blood pressure", 14)):
        joined = pairs(spark, [("patient has blood pressure", "patient has bloodpressure")]).add_key_term_list("v", [term])
        assert joined.metrics.ktcer(vocab="v").all_values() == {"char_edits": 1, "ref_chars": n, "value": 1 / n}


def test_local_terms(spark):
    d = pairs(spark, [("the quick brown fox", "x")]).add("the cat", "the cat", {"v": ["cat", "zebra"]}).add_key_term_list("v", ["brown"])
    spans = lambda **o: sorted((r["ex_id"], r["s"], r["e"]) for r in d.key_term_matches("v", **o).where("side = 'ref'").collect())
    assert spans() == spans(only_local_matches=True) == [(0, 2, 3), (1, 1, 2)]
    assert spans(only_local_matches=True, strict_local=True) == [(1, 1, 2)]
    assert [tuple(r) for r in d.key_terms_not_found("v").collect()] == [(1, "v", "zebra")]
    with pytest.raises(ValueError, match="no vocabulary 'w'"):
        d.metrics.ktr(vocab="w")


def test_legacy_and_hallucinations(spark):
    d = EvalSet(spark.createDataFrame([(0, "has diabetes now", "has diabetis now", {"medical_terms": ["diabetes"]}), (1, "ok", "ok a b c d", None)], "ex_id long, ref string, hyp string, key_terms map<string,array<string>>"))
    assert d.metrics.legacy_medical_word_accuracy().value == 0.0 and d.metrics.legacy_relaxed_medical_word_accuracy().value == 1.0
    assert d.metrics.legacy_keyword_cer().value == 0.125
    assert d.metrics.legacy_deletions().value == 2.0 and d.metrics.legacy_del_hallucinations().value == 0.5
    assert likeness("abc", "abc") == 100 and likeness("abc", "") == 0


def test_framework(spark, sample):
    @dataclass
    class Params(MetricParams):
        factor: int
        share: float = 0.5

    class Own(Metric):
        short_name_base, long_name_base, param_schema = "Own", "Own Metric", Params
        values = (Value("value", main=True), Value("_hidden"))

        def rows(self):
            return self.dataset.pairs.select("ex_id", F.length("ref").alias("n"))

        def aggregates(self):
            return {"value": F.sum("n") * self.params.factor, "_hidden": F.count("*")}

    METRICS.register("own_metric", allow_override=True, factor=2)(Own)
    m = sample.metrics.own_metric(share=1)
    assert m.value == 102 and m.short_name == "Own (factor=2, share=1)" and Own.metric_values() == {"main": "value", "other": []}
    with pytest.raises(ValueError, match="there is a metric"):
        METRICS.register_metric(Own, "own_metric")
    with pytest.raises(ValueError, match="no parameter is called"):
        sample.metrics.own_metric(x=1)
    with pytest.raises(TypeError, match="has to be of type int"):
        sample.metrics.own_metric(factor="2")
    with pytest.raises(ValueError, match="needs a value"):
        sample.metrics.ktr()
    with pytest.raises(AttributeError, match="not found"):
        sample.metrics.nothing
    with pytest.raises(ValueError, match="'x' not found"):
        sample.metrics.wer(tokenizer="x").examples()


def test_readers_and_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_text('reference,hypothesis,terms\n"a, b",a b,"[\'b\', \'c\']"\nx,y,[]\n')
    d = readers.from_csv(spark, str(tmp_path / "a.csv"), ref_col="reference", hyp_col="hypothesis", key_term_cols=["terms"])
    assert [r["key_terms"] for r in d.pairs.orderBy("ex_id").collect()] == [{"terms": ["b", "c"]}, {}]
    (tmp_path / "a.jsonl").write_text('{"ref": "the fox", "hyp": "fox", "animals": ["fox"]}\n')
    assert readers.from_jsonl(spark, str(tmp_path / "a.jsonl"), key_term_cols=["animals"]).pairs.first()["key_terms"] == {"animals": ["fox"]}
    (tmp_path / "t.txt").write_text("fox\nbrown\n")
    assert sorted(r["term"] for r in d.add_key_term_file("v", str(tmp_path / "t.txt")).own_vocab.collect()) == ["brown", "fox"]
    with pytest.raises(FileNotFoundError):
        d.add_key_term_file("v", str(tmp_path / "no.txt"))
    with pytest.raises(TypeError):
        d.add_key_term_list("v", "fox")
    assert pairs(spark, [(None, "a")], nulls="drop").metrics.wer().all_values()["num_edits"] == 0
    assert pairs(spark, [(None, "a")], nulls="empty").metrics.wer().all_values()["num_edits"] == 1
    with pytest.raises(Exception, match="a text is null"):
        pairs(spark, [(None, "a")]).metrics.wer().all_values()


def test_reports(spark, sample, tmp_path):
    d = sample.add_key_term_list("v", ["quick brown"])
    page = html.render(d)
    assert "kw-start" in page and "20.00%" in page and "Number of examples" in page
    html.write(d, tmp_path / "sub" / "r.html")
    with pytest.raises(FileExistsError):
        html.write(d, tmp_path / "sub" / "r.html")
    with pytest.raises(ValueError, match="folder"):
        html.write(d, tmp_path)
    writers.write_one_json(d.alignments(), 1, tmp_path / "a.json")
    ops = [o.asDict() for o in d.alignments().where("ex_id = 2").first()["ops"]]
    shown = terminal.alignment_text(ops, 40, "T")
    assert "   1  Ref.  " in shown and "three" in shown
    assert len(html.html_lines(ops, width=5)) == 4 and "wer" in terminal.metric_table()
    with pytest.raises(ValueError, match="fraction"):
        terminal.alignment_text(ops, 1.5)


def test_streaming(spark, tmp_path):
    from tallyscript.streaming.metrics import running_wer

    spark.createDataFrame([("a b", "a c"), ("x", "x")], "ref string, hyp string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ref string, hyp string").parquet(f"{tmp_path}/in")
    q = running_wer(stream).writeStream.outputMode("complete").format("memory").queryName("wer_now").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("wer_now").collect()] == [(1, 3, 1 / 3)]


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def slow_compound(ref, hyp):
    """Costs of the compound alignment, cell by cell."""
    n, m = len(ref), len(hyp)
    cost = [[float(j) for j in range(m + 1)]] + [[float(i)] + [0.0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = ref[i - 1], hyp[j - 1]
            best = [cost[i - 1][j - 1] + (0.0 if a == b else 0.5 + 0.5 * table(a, b) / max(len(a), len(b))), cost[i - 1][j] + 1, cost[i][j - 1] + 1]
            for k in range(2, i + 1):
                joined = "".join(ref[i - k : i])
                if (u := table(joined, b) / max(len(joined), len(b))) <= align.MOST_UNLIKE:
                    best.append(cost[i - k][j - 1] + 0.5 + u)
            cost[i][j] = min(best)
    return cost[n][m]


def cost_of(script, ref, hyp):
    """What a script costs: pieces of one hyp token are one compound."""
    total, at = 0.0, 0
    while at < len(script):
        kind, i, j, s, e, left, right = script[at]
        if right and not left:
            stop = next(k for k in range(at, len(script)) if script[k][2] == j and not script[k][6])
            joined = "".join(ref[x[1]] for x in script[at : stop + 1])
            total, at = total + 0.5 + table(joined, hyp[j]) / max(len(joined), len(hyp[j])), stop + 1
            continue
        total += 1 if kind in (align.INSERT, align.DELETE) else 0.0 if kind == align.MATCH else 0.5 + 0.5 * table(ref[i], hyp[j]) / max(len(ref[i]), len(hyp[j]))
        at += 1
    return total


def test_compounds_of_many_pairs_at_once(monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 4, 6])))
    given = []
    for _ in range(150):
        ref = [word() for _ in range(rnd.randrange(1, 8))]
        hyp = ["".join(ref[i : i + rnd.choice([1, 1, 2, 3])]) if rnd.random() < 0.7 else word() for i in range(0, len(ref), 2)]
        given.append((ref, hyp))
    given.append((["abc" * 15, "abc" * 15], ["abc" * 30]))
    compared = []
    monkeypatch.setattr(align, "distance", lambda a, b: compared.append((a, b)) or table(a, b))
    monkeypatch.setattr(align, "_SEEN", {})
    found = align.compound_scripts(given)
    # Only tokens of more than 64 characters are compared one by one.
    assert all(len(b) > 64 for _, b in compared)
    assert [align.compound_script(*x) for x in given] == found
    whole = lambda script: not any(k[5] and k[3] == k[4] or k[0] == align.DELETE for k in script)
    for (ref, hyp), script in zip(given, found, strict=True):
        assert [x[1] for x in script if x[1] is not None] == list(range(len(ref)))
        if whole(script):
            assert abs(cost_of(script, ref, hyp) - slow_compound(ref, hyp)) < 1e-9
    assert sum(map(whole, found)) > 40
    monkeypatch.setattr(align, "CELLS", 16)
    monkeypatch.setattr(align, "_SEEN", {})
    assert align.compound_scripts(given) == found


def test_pairs_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    from tallyscript.plans import catalogue

    spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("a b"), F.col("id")).alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).select((F.col("id") % 4).alias("conv_id"), F.floor(F.col("id") / 4).alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(catalogue, "NAMES", 4)
    monkeypatch.setattr(catalogue, "TURNS", 5)
    parts, turns = catalogue.part_pairs(spark, str(tmp_path)), catalogue.conversation_pairs(spark, str(tmp_path))
    assert (parts.rdd.getNumPartitions(), turns.rdd.getNumPartitions(), parts.count(), turns.count()) == (10, 8, 39, 36)


def test_matches_of_all_windows(spark, monkeypatch):
    from tallyscript.operators import terms

    rnd = random.Random(6)
    words = lambda n: [rnd.choice("aaaaabcd") for _ in range(n)]
    texts = [(i, side, words(rnd.randrange(0, 15))) for i in range(60) for side in ("ref", "hyp")]
    own = [("v", list(t)) for t in dict.fromkeys(tuple(words(rnd.choice([1, 2, 3, 5]))) for _ in range(12))]
    rows = spark.createDataFrame(texts, "ex_id long, side string, toks array<string>")
    patterns = terms.patterns(spark.createDataFrame(own, "vocab string, toks array<string>"))
    whole = {(i, side, "v", s, s + len(t)) for i, side, toks in texts for _, t in own for s in range(len(toks)) if toks[s : s + len(t)] == t}
    outer = {m for m in whole if not any(o[:2] == m[:2] and o != m and o[3] <= m[3] and m[4] <= o[4] for o in whole)}
    for bits in (0, 20):
        monkeypatch.setattr(terms, "SIEVE_BITS", max(1, bits))
        found = lambda **o: [tuple(r) for r in terms.select_matches(rows, patterns, **o).collect()]  # noqa: E731, B023
        assert sorted(found(allow_subset_matches=True)) == sorted(whole) and sorted(found()) == sorted(outer)
    by = {r["ex_id"]: r["spans"] for r in terms.matches_by_example(rows, patterns).collect()}
    assert set(by) == {m[0] for m in outer} and sum(map(len, by.values())) == len(outer)


def test_statistics_of_terms_are_those_of_their_operations(spark):
    rnd = random.Random(7)
    text = lambda: " ".join(rnd.choice(["blood", "pressure", "bloodpressure", "of", "oft", "Ünlike"]) for _ in range(rnd.randrange(1, 12)))
    d = pairs(spark, [(text(), text()) for _ in range(40)] + [("x", "y")]).add_key_term_list("v", ["blood pressure", "pressure", "of blood", "unlike"])
    key = PipelineKey(tokenizer="key_term")
    rows = {r["ex_id"]: r for r in d.metrics.get("_kt_stats", vocab="v").examples().collect()}
    spans = [tuple(r) for r in d.key_term_matches("v", key).collect()]
    script = {r["ex_id"]: r["ops"] for r in d.alignments("levenshtein", key).collect()}
    expected = {i: [0] * 5 for i in rows}
    for i, side, _, s, e in spans:
        at = [k for k, o in enumerate(script[i]) if o[f"{side}_idx"] is not None]
        bad = any(o["type"] != align.MATCH for o in script[i][at[s] : at[e - 1] + 1])
        for k, n in enumerate((side == "ref", side == "hyp", side == "ref" and not bad, side == "ref" and bad, side == "hyp" and bad)):
            expected[i][k] += n
    assert {i: list(r)[1:] for i, r in rows.items()} == expected and sum(map(sum, expected.values())) > 50
    # The operations of a term joined by the built-in expressions.
    stats = d.metrics.get("_rkt_stats", vocab="v").examples().select("ex_id", F.explode("term_stats").alias("t")).select("ex_id", "t.*")
    from tallyscript.operators.distance import char_distance

    texts = stats.select("*", *(align.joined_side(F.col("segment"), side).alias(side[0]) for side in ("ref", "hyp"))).withColumn("d", char_distance(F.col("r"), F.col("h")))
    found = texts.collect()
    assert len(found) == sum(s[1] == "ref" for s in spans) > 20
    assert all(x["ref_chars"] == len(x["r"]) and x["char_edits"] == x["d"] + x["segment"][0]["hyp_lp"] + x["segment"][-1]["hyp_rp"] for x in found)


def test_ngrams_and_standards_in_one_pass(spark):
    p = config.Pipelines.of(config.load_config())
    given = ["It’s a  well–known／old ‘case’, isn`t it", "  x", "", None, "a b"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    one = lambda c: text.normalize_slash_variants(text.normalize_hyphen_variants(text.normalize_apostrophe_variants(text.nfc(c))))
    whole = p.standardizers["default"](F.col("t"))
    assert df.select(whole).collect() == df.select(one(F.col("t"))).collect()
    # One pass over a text, not one for each kind of variants.
    assert str(whole).count("translate(") == 1
    toks = config.tokens(p, PipelineKey(), F.col("t"))
    rows = df.where("t is not null").select(*(F.transform(sequences.windows(toks, n), lambda w: sequences.joined(w)).alias(f"w{n}") for n in (2, 3)), *(sequences.ngrams(toks, n, join_tokens=True).alias(f"g{n}") for n in (2, 3)), sequences.ngrams(toks, 2).alias("n"), sequences.spaced_ngrams(sequences.texts(toks), 2).alias("s")).collect()
    for r in rows:
        assert r["w2"] == r["g2"] and r["w3"] == r["g3"] and [" ".join(g) for g in r["n"]] == r["s"]
