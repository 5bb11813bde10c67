"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyscript.llm import bpe, chat, jaccard, neardup, packing, permutation, pii, quality, toxicity, warc
from tallyscript.llm.shared import components, local_roots

DOCS = "doc_id long, text string, label int, n int, key string, node long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark, texts):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, 7, 1, "k", None) for i, t in texts], DOCS)


TEXTS = [(0, None), (1, ""), (2, "One two three four five six."), (3, "One two three four five six."), (3, "One two three four five six."), (None, "a b"), (4, "word " * 30_000), (5, " \n"), (6, "Mail a@b.cd or 4111 1111 1111 1111.")]


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    root = local_roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 600)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {n: root[n] for n in nodes}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_packing(spark):
    out = rows(packing.pack(documents(spark, TEXTS), RANKS))
    assert sum(r["piece"] == 0 for r in out) == len(TEXTS)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert rows(packing.pack(documents(spark, []), RANKS)) == []


def test_byte_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = rows(bpe.round_trip(documents(spark, TEXTS), path, public_tokenizers.PATTERN))
    expected = sorted((hashlib.sha256(",".join(map(str, own.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in TEXTS)
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in out) == expected
    both = bpe.decode_column(bpe.encode_column(documents(spark, TEXTS), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows(both))


def test_pii(spark):
    out = rows(pii.digests(documents(spark, TEXTS)))
    assert len(out) == len(TEXTS) and sum(r["n_email"] for r in out) == sum(r["n_card"] for r in out) == 1
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find(documents(spark, TEXTS[-1:])))}
    assert [s["kind"] for s in found[6]] == ["email", "card"]
    clean = pii.redact(documents(spark, TEXTS))
    assert clean.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"]: r["text"] for r in rows(clean)}[6] == "Mail [EMAIL] or [CARD]."
    assert {r["doc_id"]: r["text"] for r in rows(clean)}[0] is None


def test_jaccard_edges(spark):
    assert rows(jaccard.similar(documents(spark, []))) == []
    out = rows(jaccard.similar(documents(spark, TEXTS)))
    assert len(out) == len(TEXTS)
    assert all(r["n_similar"] == 2 and r["component_id"] == 2 for r in out if r["doc_id"] in (2, 3))
    kept = jaccard.distinct_documents(documents(spark, [*TEXTS, (9, "z"), (9, "z")]))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in rows(kept) if r["doc_id"] is not None) == [0, 1, 2, 4, 5, 6, 9]


VECTORS = "vec_id long, embedding array<double>, label int, key string, cluster int"


def vectors(spark, given):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "k", 1) for i, v, y in given], VECTORS)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((2000, 16))
    v[7] = v[6]
    given = [(i, x, 0) for i, x in enumerate(v)] + [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [None] * 16, 0), (2300, [float("nan")] * 16, 0)]
    out = {}
    for r in rows(permutation.search(vectors(spark, given), "vec_id % 100 = 0")):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == set(range(0, 2000, 100))
    hits = 0
    for q, found in out.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and [x[2] for x in found] == [d[x[1]] for x in found]
        hits += len({x[1] for x in found} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(out)
    few = rows(permutation.search(vectors(spark, given[:3]), "vec_id = 0"))
    assert [(r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert rows(permutation.search(vectors(spark, given[2000:]), "true")) == rows(permutation.search(vectors(spark, []), "true")) == []


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    given, at = [], 0
    for size in (1, 1, 5, 60, 2):
        base = rng.standard_normal(24)
        for _ in range(size):
            given.append((at, base + rng.standard_normal(24) * 0.22, at % 2))
            at += 1
    given += [(at + k, given[10][1], 0) for k in range(4)] + [(at + 4, None, 0), (at + 5, [0.0] * 24, 0), (at + 6, given[10][1], None), (at + 6, given[10][1], None)]
    n = len(given)
    usable = [y is not None and v is not None and np.any(v) for _, v, y in given]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and given[i][2] == given[j][2]:
                a, b = np.array(given[i][1]), np.array(given[j][1])
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    root = local_roots(*np.nonzero(link), n)
    expected = sorted((given[i][0], int(link[i].sum()), given[root[i]][0], given[i][0] == given[root[i]][0]) for i in range(n))
    out = rows(neardup.near_duplicates(vectors(spark, given)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == expected
    assert rows(neardup.near_duplicates(vectors(spark, []))) == []


def test_warc(spark):
    long = "é" * 80
    given = [(5, "u", long), (3, None, long), (9, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (7, "u", "x" * 100), (6, "a\r\nb", "x" * 100), (10, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in given], "page_id long, url string, html string, digest string, number int")
    out = {r["page_id"]: r for r in rows(warc.round_trip(pages))}
    assert len(out) == len(given)
    for i, _, h in given:
        b = (h or "").encode()
        first = min(x for x, _, y in given if y == h)
        revisit = len(b) >= 100 and first != i
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
        assert (out[i]["record_type"], out[i]["refers_to"]) == (("revisit", first) if revisit else ("response", None))
    headers, payloads = warc.ingest(warc.write(pages))
    assert payloads.count() == payloads.select("digest").distinct().count() == 5
    assert all(bytes(r["record"]).startswith(b"WARC/1.1\r\n") for r in rows(warc.reconstruct(headers, payloads)))
    assert rows(warc.round_trip(pages.limit(0))) == []


def test_chat(spark):
    given = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", None), (1, 1, "assistant", "b<|end|>"), (None, 0, None, "x"), (2, None, "user", "y" * 100_000), (2, 0, "system", "[INST] \\")]
    turns = spark.createDataFrame([(*g, "k") for g in given], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_turns(turns.withColumn("parts", chat.text_part(turns["text"])))))}
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb<|end|>\nassistant\nb<|end|>\n").hexdigest()
    assert out[1]["loss_chars"] == 16 and out[1]["loss_sha256"] == hashlib.sha256(b"b<|end|>" * 2).hexdigest()
    assert out[2]["turns_sha256"] == hashlib.sha256(f"user\n{'y' * 100_000}\nsystem\n[INST] \\\n".encode()).hexdigest()
    assert out[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()
    assert rows(chat.read_back(chat.format_turns(turns.limit(0).withColumn("parts", chat.text_part(turns["text"]))))) == []


def labelled_texts(n=400):
    rnd = random.Random(6)
    texts, labels = [], []
    for i in range(n):
        toxic, poor = i % 7 == 0, i % 5 == 0
        words = [rnd.choice(["river", "house", "green", "walks", "under", "light"]) + rnd.choice(["", "s", "er"]) for _ in range(60)]
        if toxic:
            for w in rnd.sample(["vile", "scum", "rotten", "fool", "wretch"], rnd.randint(1, 5)):
                words.insert(rnd.randrange(60), w)
        text = " | ".join(words) if poor else " ".join(words) + "."
        texts.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return texts, labels


def test_classifiers(spark):
    texts, labels = labelled_texts()
    docs = documents(spark, texts + [(1000, None), (1001, ""), (1002, None), (1002, "scum " * 20_000)])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    tox = {r["doc_id"]: r for r in rows(toxicity.assess(docs, marks)) if r["doc_id"] < 1000}
    assert all(tox[i]["rejected"] == bool(t) for i, _, t in labels)
    assert all(0 <= r["severity"] <= 3 for r in tox.values())
    good = {r["doc_id"]: r for r in rows(quality.assess(docs, marks))}
    assert all(good[i]["predicted"] == q for i, q, _ in labels)
    assert all(0 <= r["score"] <= 1 and not np.isnan(r["score"]) for r in good.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in good.items())


def test_classifiers_without_labels(spark):
    docs = documents(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["rejected"] for r in rows(toxicity.assess(docs, none)))
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows(quality.assess(docs, none)))
    assert rows(toxicity.assess(documents(spark, []), none)) == rows(quality.assess(documents(spark, []), none)) == []


def test_pipeline(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    texts, labels = labelled_texts()
    texts += [(2000, texts[1][1]), (2001, texts[2][1] + " Mail a@b.cd"), (2002, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus.STAGES] == ["toxicity", "quality", "ngram_jaccard", "pii", "packing"]
    out = {r["doc_id"] for r in rows(corpus.run(spark, str(tmp_path)))}
    bad = {i for i, q, t in labels if t or not q}
    assert not out & bad and 2000 not in out and 1 in out and 2001 not in out
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
