"""Cases in which an operator once did less than the whole job."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tallyscript.llm import neardup, packing, permutation

from .test_operators import RANKS, documents, rows, vectors


@pytest.fixture(scope="module")
def a_third_copies(spark):
    """4,000 vectors of which a third are the same, and what the index finds for some of them."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((4000, 24))
    hot = rng.permutation(4000)[:1333]
    v[hot] = v[hot[0]]
    found = {}
    for r in rows(permutation.search(vectors(spark, [(i, x, 0) for i, x in enumerate(v)]).coalesce(1), "vec_id % 40 = 0")):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return v, set(hot.tolist()), {q: [i for _, i, _ in sorted(x)] for q, x in found.items()}


def nearest(v, q):
    d = np.sqrt(((v - v[q]) ** 2).sum(1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(v)), d))[:10].tolist()


def test_recall_beside_copies(a_third_copies):
    v, hot, found = a_third_copies
    others = [q for q in range(0, 4000, 40) if q not in hot]
    assert sum(len(set(found[q]) & set(nearest(v, q))) for q in others) >= 0.9 * 10 * len(others)


def test_copies_of_smallest_id(a_third_copies):
    v, hot, found = a_third_copies
    own = [q for q in range(0, 4000, 40) if q in hot]
    assert own and all(found[q] == nearest(v, q) for q in own)


def test_block_with_repeated_ids():
    rng = np.random.default_rng(12)
    v = rng.standard_normal((60, 4))[rng.integers(0, 60, 3000)]
    v[:900] = v[0]
    ids = rng.integers(0, 400, 3000)
    ids[:30] = 5
    uids = rng.permutation(3000)
    pivots = v[900:920]
    block = permutation.Block.made(ids, uids, v, pivots, 8, 10)
    again = permutation.Block.read(block.stored(), 4)
    for q in (0, 1000, 2999):
        for b in (block, again):
            got, far, _ = b.nearest(int(uids[q]), v[q], permutation.lists(v[q : q + 1], pivots, 8)[0], 10, 1.0)
            d = np.sqrt(((v - v[q]) ** 2).sum(1))
            best = [i for i in np.lexsort((ids, d)) if i != q][:10]
            assert got.tolist() == ids[best].tolist() and far.tolist() == d[best].tolist()


def test_files_give_the_footrule():
    rng = np.random.default_rng(14)
    v, pivots = rng.standard_normal((500, 6)), rng.standard_normal((40, 6))
    block = permutation.Block.made(np.arange(500), np.arange(500), v, pivots, 12, 10)
    own = permutation.lists(block.v, pivots, 12)
    place = np.full((500, 40), 12)
    np.put_along_axis(place, own, np.broadcast_to(np.arange(12), own.shape), 1)
    for q in range(0, 500, 50):
        assert (12 * 13 - 2 * block.near(own[q]).astype(int) == np.abs(place - place[q]).sum(1)).all()
        assert (np.diff(block.ends) > 0).sum() <= 40 and len(block.rows) == 500 * 12


def test_candidates_are_a_share(spark):
    rng = np.random.default_rng(15)
    v = rng.standard_normal((6000, 24))
    block = permutation.Block.made(np.arange(6000), np.arange(6000), v, v[:256], permutation.NEAREST, 10)
    hits, most = 0, 0
    for q in range(0, 6000, 60):
        i = int(np.flatnonzero((block.v == v[q]).all(1))[0])
        got, _, compared = block.nearest(q, v[q], permutation.lists(v[q : q + 1], v[:256], permutation.NEAREST)[0], 10, permutation.RERANK)
        hits, most = hits + len(set(got.tolist()) & set(nearest(v, q))), max(most, compared)
    assert most < 0.12 * 6000 and hits >= 0.9 * 1000


def test_repeated_queries_and_widths(spark):
    given = [(100, [1.0, 0, 0], 0), (100, [-1.0, 0, 0], 0), (1, [0.9, 0.1, 0], 0), (2, [-0.9, 0.1, 0], 0), (200, [1.0, 2], 0), (3, [1.0, 2.1], 0), (None, [1.0, 0, 0], 0), (5, [3.0], 0)]
    out = sorted((r["query_id"], r["score"], r["vec_id"]) for r in rows(permutation.search(vectors(spark, given), "vec_id % 100 = 0")))
    assert [(q, i) for q, _, i in out] == [(100, 1), (100, 2), (100, 1), (100, 2), (100, 100), (100, 100), (200, 3)]


def test_mixed_widths_link(spark):
    given = [(9, [1.0, 2], 0)] + [(i, [1.0, 2, 3 + i / 1000], 0) for i in range(6)] + [(10, [1.0, 2.001], 0), (None, [1.0, 2.0], 0)]
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(vectors(spark, given)))), key=repr)
    assert out == sorted([(i, 5, 0, i == 0) for i in range(6)] + [(9, 2, 9, True), (10, 2, 9, False), (None, 2, 9, False)], key=repr)


END = "<|endoftext|>"
MARKED = [f"a {END} b", END, END * 3, f"{END}a", f"a{END}", f" {END} ", f"a{END}b c\n\n{END}  d <|endoftext| > {END[:-1]}", "é  ſ\u3000x 12's " * 40, "plain words only", "", " \n", f"x y {END} " * 1500]


def test_ids_of_tokenizers(spark):
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(MARKED)}
    out = rows(packing.pack(documents(spark, enumerate(MARKED)), RANKS))
    for i, x in ids.items():
        pieces = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(x)
        assert all(r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)


def test_more_passes_for_large_labels(spark):
    """A narrow window stands in for a large label: what counts is how many windows the classes fill."""
    rng = np.random.default_rng(13)
    v = rng.standard_normal((3000, 32))
    side = rng.standard_normal((1000, 32))
    side -= v[:1000] * ((side * v[:1000]).sum(1) / (v[:1000] ** 2).sum(1))[:, None]
    side *= np.sqrt((v[:1000] ** 2).sum(1) / (side**2).sum(1))[:, None]
    v[1000:2000] = 0.935 * v[:1000] + np.sqrt(1 - 0.935**2) * side
    out = {r["vec_id"]: r for r in rows(neardup.near_duplicates(vectors(spark, [(i, x, 0) for i, x in enumerate(v)]), window=1))}
    assert sum(out[i]["n_links"] == 1 and out[i + 1000]["component_id"] == i for i in range(1000)) >= 985


def linked(v, label):
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    return link.sum(1)


@pytest.mark.parametrize("parts", [None, 5])
def test_groups_larger_than_the_window(spark, parts):
    """Groups of 700 and 120 different vectors beside others, a window of 16 and borders between partitions."""
    rng = np.random.default_rng(16)
    v = np.concatenate([rng.standard_normal(32) + 0.13 * rng.standard_normal((n, 32)) for n in (700, 120, 40, *[1] * 600)])
    label = rng.integers(0, 2, len(v))
    out = {r["vec_id"]: r for r in rows(neardup.near_duplicates(vectors(spark, [(i, x, int(y)) for i, (x, y) in enumerate(zip(v, label))]), window=16, parts=parts))}
    true = linked(v, label)
    found = np.array([out[i]["n_links"] for i in range(len(v))])
    assert true.max() > 200 and (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert len({out[i]["component_id"] for i in range(700)}) == 2


def test_passes_grow(spark):
    given = spark.createDataFrame([(n,) for n in (1, 65, 4_000, 100_000, 1_000_000)], "n long")
    passes = [r["p"] for r in rows(given.select(neardup.passes_for(given["n"], 0.93, 12, 64).alias("p")))]
    assert passes[:3] == [12, 12, 12] and 12 < passes[3] < passes[4] < 60
    assert all(sorted(neardup.bit_order(k, 12)) == list(range(256)) for k in range(40))
