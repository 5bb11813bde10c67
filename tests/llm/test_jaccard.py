"""The Jaccard join against a brute force that shares no code with it."""

import random
import re

import pytest

from tallyscript.llm import jaccard, shared

from .test_operators import documents, rows


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(given):
    """(doc_id, n_shingles, n_similar, component_id) of each row."""
    sets = [shingle_set(t) for _, t in given]
    n = len(given)
    near = [[j for j in range(n) if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = [], [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            group.append(x)
            todo += [j for j in near[x] if j not in seen]
            seen.update(near[x])
        ids = [given[x][0] for x in group if given[x][0] is not None]
        for x in group:
            out[x] = (given[x][0], len(sets[x]), len(near[x]), min(ids) if ids else None)
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in rows(df)), key=repr)


def varied(rnd, base, words, most):
    w = list(base)
    for _ in range(rnd.randint(0, most)):
        w[rnd.randrange(len(w))] = rnd.choice(words)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies of several sizes and texts' lengths, a passage that unrelated texts share, and odd texts."""
    rnd = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for size, length, most in ((40, 150, 3), (25, 150, 6), (12, 12, 1), (30, 600, 12), (2, 40, 1), (2, 90, 2)):
        base = [rnd.choice(words) for _ in range(length)]
        texts += [varied(rnd, base, words, most) for _ in range(size)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts += [" ".join(passage + [rnd.choice(words) for _ in range(rnd.choice((3, 8, 40, 200)))]) for _ in range(40)]
    texts += [texts[0]] * 5 + ["", None, " \n", "a", "A", "a b", "A  B", "é É", "x " * 20_000, "x y z", "\x1cq r s"]
    given = list(enumerate(texts))
    rnd.shuffle(given)
    return given + [(None, texts[0]), (None, texts[1]), (None, varied(rnd, texts[-12].split(), words, 1)), (7, texts[50]), (7, texts[50]), (None, "alone here"), (None, "alone here"), (None, None)]


@pytest.mark.parametrize(("region_rows", "pivots"), [(384, 16), (8, 3), (4, 2)])
def test_against_brute_force(spark, corpus, region_rows, pivots):
    assert found(jaccard.similar(documents(spark, corpus), region_rows=region_rows, pivots=pivots)) == brute(corpus)


def test_rows_without_ids_link(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w99", "other")
    out = found(jaccard.similar(documents(spark, [(None, text), (None, near), (4, near + " more"), (None, "z")])))
    assert out == [(4, 97, 2, 4), (None, 1, 0, None), (None, 96, 2, 4), (None, 96, 2, 4)]
    assert [(r["doc_id"], r["text"]) for r in sorted(rows(jaccard.distinct_documents(documents(spark, [(None, text), (None, near), (4, near + " more"), (None, "z")]))), key=repr)] == [(4, near + " more"), (None, "z")]
    assert len(rows(jaccard.distinct_documents(documents(spark, [(None, text), (None, near), (None, near), (None, "z"), (None, "z"), (None, "")])))) == 3


def test_few_regions_hold_a_family(spark):
    """Sets are replicated into regions by the window alone, not into every region."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    given = list(enumerate(" ".join(rnd.choice(words) for _ in range(80)) for _ in range(300)))
    given += [(1000 + i, varied(rnd, given[0][1].split(), words, 2)) for i in range(30)]
    scan = spark.createDataFrame(given, "doc_id long, text string")
    asked = jaccard._nominees(jaccard.stored(jaccard._numbered(scan, "doc_id", "text").mapInArrow(jaccard._scan(90, 100, 5), "doc_id long, rid long, n long, hi long, lo long, keys array<long>")))
    assert len(rows(asked)) < 60


def shuffled(spark):
    """Bytes that the stages so far wrote for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_that_share_a_part_are_moved(spark, tmp_path, monkeypatch):
    """Texts that can't have a link stay where they are, and the parts' keys don't stay on disk."""
    rnd = random.Random(11)
    word = lambda: rnd.randbytes(500).hex()
    given = [(i, " ".join(word() for _ in range(20))) for i in range(300)]
    given += [(1000 + i, given[0][1]) for i in range(2)]
    docs = documents(spark, given)
    before = shuffled(spark)
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}/{rnd.randbytes(8).hex()}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        out = found(jaccard.similar(docs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = [spark.read.parquet(f"file://{p}").columns for p in tmp_path.iterdir()]
    assert out == sorted([(i, 16, 0, i) for i in range(1, 300)] + [(i, 16, 2, 0) for i in (0, 1000, 1001)], key=repr)
    assert shuffled(spark) - before < sum(len(t) for _, t in given) / 10
    assert stored and not any({"keys", "items"} & {*c} for c in stored)


def test_texts_by_number(spark):
    """All of the rows asked for and each text once, whatever the numbers; few others."""
    rnd = random.Random(3)
    numbers = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(4000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    docs = spark.createDataFrame([(n, f"t{n}") for n in numbers] + [(0, "other"), (0, "t0")], "rid long, text string")
    for some in (numbers[-4:], numbers[::40], numbers):
        got = [(r["rid"], r["text"]) for r in rows(jaccard._texts(docs, spark.createDataFrame([(n,) for n in some], "rid long")))]
        assert len(got) == len(set(got)) <= len(some) + 1 + 0.05 * len(numbers)
        assert set(got) >= {(n, f"t{n}") for n in some} | ({(0, "other")} if 0 in some else set())
    assert rows(jaccard._texts(docs, spark.createDataFrame([], "rid long"))) == []


def test_light_parts_are_left_out():
    import numpy as np

    rng = np.random.default_rng(1)
    bands = jaccard.Bands(90, 100)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 30, 200, 200, 200, 1000)]
    keys = [set(jaccard.signatures(s, bands).tolist()) for s in sets]
    assert all(not a & b for i, a in enumerate(keys) for b in keys[:i])
    for s in sets[2:]:
        for gone in range(1, len(s) // 20):
            assert set(jaccard.signatures(s, bands).tolist()) & set(jaccard.signatures(np.sort(rng.permutation(s)[gone:]), bands).tolist())


def test_empty_table(spark):
    assert rows(jaccard.similar(documents(spark, []))) == rows(jaccard.distinct_documents(documents(spark, []))) == []
