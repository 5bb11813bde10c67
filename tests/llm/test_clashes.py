"""Extra columns with the names of results, null keys and odd parts: nothing crashes, nothing is overwritten."""

import hashlib

import public_tokenizers
import pytest

from tallyscript.llm import bpe, chat, pii, quality, toxicity, warc
from tallyscript.llm.labelled import sampled, with_texts
from tallyscript.llm.shared import beside, shared_dir

from .test_operators import documents, labelled_texts, rows

CLASH = "doc_id long, text string, grade string, score double, rejected string, severity int, made string, ids string, decoded string, _clean string, _toxicity string, rid string"


@pytest.fixture(scope="module")
def given(spark):
    texts, labels = labelled_texts(150)
    docs = spark.createDataFrame([(i, t, "gold", 0.9, "no", 7, "m", "i", "d", "c", "t", "r") for i, t in [*texts, (None, None), (900, "Mail a@b.cd 3")]], CLASH)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_grades_beside_columns(given):
    out = rows(toxicity.severity(given[0], toxicity.fit(*given)))
    assert {r["grade_input"] for r in out} == {"gold"} and {r["severity_input"] for r in out} == {7} and {r["rejected_input"] for r in out} == {"no"}
    assert {r["made"] for r in out} == {"m"} and {r["grade"] > 0 for r in out} == {True, False}
    assert all(r["rejected"] == (r["grade"] > 0) for r in out)


def test_scores_beside_columns(given):
    out = rows(quality.score_column(given[0], quality.fit(*given)))
    assert {r["score_input"] for r in out} == {0.9} and len({r["score"] for r in out}) > 10


def test_ids_beside_columns(given):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = rows(bpe.decode_column(bpe.encode_column(given[0], path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN))
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["ids_input"] == "i" and r["decoded_input"] == "d" for r in out)


def test_redaction_beside_columns(given):
    out = {r["doc_id"]: r for r in rows(pii.redact(given[0]))}
    assert out[900]["text"] == "Mail [EMAIL] 3" and out[900]["_clean"] == "c"


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, given, tmp_path, empty):
    corpus = pytest.importorskip("corpus_pipeline")
    docs, labels = given
    docs = docs.limit(0) if empty else docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (labels.limit(0) if empty else labels).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        assert {r["grade"] for r in rows(after)} <= {"gold"}
        docs = after
    assert bool(rows(corpus.run(spark, str(tmp_path)))) != empty


def test_beside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Score int, score_input int, x int")
    assert beside(df, "score").columns == ["Score_input_input", "score_input", "x"] and beside(df, "y") is df


def test_pages_without_ids(spark):
    long = "h" * 120
    given = [(None, "u", long), (4, "u", long), (None, "u", "short"), (None, "v", "z" * 200), (None, "v", "z" * 200)]
    out = rows(warc.round_trip(spark.createDataFrame([(*x, "k") for x in given], "page_id long, url string, html string, record string")))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr) == sorted(
        [(None, digest(long), "revisit", 4), (4, digest(long), "response", None), (None, digest("short"), "response", None), *[(None, digest("z" * 200), "response", None)] * 2], key=repr
    )


def test_all_part_types(spark):
    parts = [("text", "see "), ("image", None), (None, "and"), ("video", None), ("audio", None), ("document", None), ("text", "<|video|><|unknown|>"), None]
    row = [None if p is None else (p[0], p[1], "ref", 700, 300, 2.0, 3) for p in parts]
    turns = spark.createDataFrame([(1, 0, "user", row), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = sorted(rows(chat.format_turns(turns)), key=lambda r: r["turn"])
    assert first["formatted"] == "<|turn|>user\nsee <|image|>and<|unknown|><|audio|><|document|><\\|video|><\\|unknown|><|end|>"
    assert [(a["kind"], a["position"], a["tokens"]) for a in first["attachments"]] == [("image", 0, 432), ("unknown", 1, 0), ("audio", 2, 50), ("document", 3, 1536)]
    assert first["expanded_tokens"] == 2018 and second["attachments"] == [] and second["loss_start"] == second["loss_end"]


IBANS = [
    ("BE68 5390 0754 7034 OK", (0, 19)), ("BE68 5390 0754 7034 BANK", (0, 19)), ("ES91 2100 0418 4502 0005 1332 A", (0, 29)), ("pay de89370400440532013000.", (4, 26)),
    ("DE89-3704-0044-0532-0130-00", (0, 27)), ("xBE68539007547034", None), ("BE68 5390 0754 70345", None), ("BE69 5390 0754 7034", None), ("ZZ68 5390 0754 7034", None),
]


@pytest.mark.parametrize(("text", "span"), IBANS)
def test_account_numbers(text, span):
    assert [(s, e) for k, s, e, _ in pii.spans(text) if k == "iban"] == ([span] if span else [])


def test_context_words_are_whole():
    score = {t: pii.spans(f"{t} +44 20 7946 0958")[0][3] for t in ("tell", "tel", "Tel.")}
    assert score == {"tell": 0.7, "tel": 1.0, "Tel.": 1.0}


def test_samples_are_bounded(spark):
    hot = documents(spark, [(None, "same")] * 3000 + [(None, f"t{i}") for i in range(3000)])
    assert 30 < len(rows(sampled(hot.select("doc_id", "text"), 100, 1))) < 100
    chosen = spark.createDataFrame([(5, 1)], "doc_id long, label int")
    assert [tuple(r.values()) for r in rows(with_texts(documents(spark, [(5, "b"), (5, "a"), (5, None)]), chosen))] == [(5, "a", 1)]


def test_shared_folder_needs_a_local_master(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)
