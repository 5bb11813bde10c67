"""Parts of the operators that need no Spark, against plain versions."""

import base64
import hashlib
import io
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyscript.llm import bpe, chat, jaccard, labelled, packing, pii, quality, toxicity, warc
from tallyscript.llm.vectors import matrices, stacked

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    only = lambda m: re.sub("[^0-9]", "", m)
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m)),
        "phone": lambda m: 9 <= len(only(m)) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0])]


@given(st.text(alphabet="a1@.+- (9)Z%0", max_size=40))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == plain_base(text)


def test_added_spans():
    text = "IBAN DE89 3704 0044 0532 0130 00, wrong DE88 3704 0044 0532 0130 00; social security 123-45-6789. " + "x " * 30 + "order 123-45-6789"
    found = [(k, text[s:e]) for k, s, e, _ in pii.spans(text)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found
    assert [f for f in found if f[0] == "ssn"] == [("ssn", "123-45-6789")]
    assert pii.spans(None) == pii.spans("") == []
    assert pii.redacted("mail a@b.cd now", pii.spans("mail a@b.cd now")) == "mail [EMAIL] now"


def test_long_runs_take_linear_time():
    for c in ("1", "a", "+", "1.", "@", "1 "):
        pii.spans(c * 60_000 + "@")


@given(st.text(alphabet="<[]|\\/s>INTS Ye", max_size=40))
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>"))


@given(st.text(max_size=20))
def test_roles_are_reversible(role):
    e = chat.escape_role(role)
    assert "\n" not in e and chat.unescape_role(e) == role


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "a<"}, {"type": "text", "text": "|end|>"}, {"type": "image", "ref": "i", "width": 700, "height": 300}, {"type": "audio", "seconds": 2.0}, {"type": "document", "pages": 3, "ref": "d"}, {"text": None}]
    text, attached = chat.flatten(parts)
    assert text == "a<\\|end|><|image|><|audio|><|document|>"
    assert [(a["kind"], a["position"], a["tokens"]) for a in attached] == [("image", 0, 3 * 144), ("audio", 1, 50), ("document", 2, 3 * 512)]
    assert chat.flatten(None) == ("", [])
    assert chat.flatten([{"type": "video", "ref": "r"}]) == ("<|unknown|>", [{"kind": "unknown", "position": 0, "ref": "r", "tokens": 0}])


def test_bpe_is_that_of_the_rank_file():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    pieces = ["the", " ", "  ", "\n", " ", " ", "é", "ß", "日本", "😀", "a" * 300, "12", "don't", "!!", "<|endoftext|>", "\x1c", "\x85", "_", "﻿", "x́"]
    for _ in range(400):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        ids = codec.encode(text)
        assert ids == ",".join(map(str, own.encode_ordinary(text)))
        assert codec.decode(ids) == text.encode()
    assert codec.encode(None) == codec.encode("") == ""


def test_packing_holds_every_piece_once():
    rnd = random.Random(5)
    for capacity in (7, 32, 64):
        lengths = [rnd.randint(1, capacity) for _ in range(500)] + [capacity // 3 + 1] * 50
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.plan(counts, capacity)
        held = {}
        for times, parts in plan:
            assert sum(n * k for n, k in parts) <= capacity
            for n, k in parts:
                held[n] = held.get(n, 0) + times * k
        assert held == counts
        bins = sum(t for t, _ in plan)
        assert bins <= sum(lengths) / capacity * 11 / 9 + 1
    assert packing.plan({}, 10) == []


def test_pieces_cut_only_long_documents():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [p[:3] for p in packing.pieces_of(ids, 4)] == [(0, 0, 2), (1, 2, 4), (2, 6, 4)]
    assert [p[:3] for p in packing.pieces_of(ids, 10)] == [(0, 0, 10)]


def test_shingles():
    assert len(jaccard.shingles(None)) == len(jaccard.shingles("")) == len(jaccard.shingles(" \n\t")) == 0
    assert len(jaccard.shingles("a b")) == 1
    assert len(jaccard.shingles("A b c d e f")) == 2
    assert (jaccard.shingles("A B c d e") == jaccard.shingles("a\tb\nc d e")).all()


def test_warc_records_are_read_in_any_cut():
    head, content = warc.record(3, "http://x/ y", "é".encode() * 50, None)
    rev_head, rev = warc.record(4, None, "é".encode() * 50, 3)
    assert b"WARC-Type: revisit" in rev_head and b"WARC-Refers-To: <urn:page:3>" in rev_head and rev.endswith(b"\r\n\r\n")
    data = head + content + b"\r\n\r\n" + rev_head + rev + b"\r\n\r\n"
    import gzip

    for blob in (data, gzip.compress(data), gzip.compress(head + content + b"\r\n\r\n") + gzip.compress(rev_head + rev + b"\r\n\r\n")):
        assert list(warc.read_records(io.BytesIO(blob))) == [(head, content), (rev_head, rev)]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(data[:-9])))
    assert warc.parse(head)["warc-payload-digest"] == "sha256:" + hashlib.sha256("é".encode() * 50).hexdigest()


def test_ordinal_fit_keeps_the_grades_in_order():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    rows = [[0] * 0 if g == 0 else [g - 1] for g in grade]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    w, theta = toxicity.fit_ordinal(starts, np.array([c for r in rows for c in r]), grade, 3)
    assert (np.diff(theta) > 0).all() and w[0] < w[1] < w[2]


def test_ordinal_gradient_descends_to_the_likelihood():
    w, theta = toxicity.fit_ordinal(np.array([0, 0, 0, 1, 2]), np.array([0, 0]), np.array([0, 0, 1, 1]), 1, grades=1)
    assert w[0] - theta[0] > 0 > -theta[0]


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = np.zeros((300, 1), int), np.ones((100, 1), int)
    w = quality.non_negative_risk(good[:150], np.concatenate((good[150:], bad)), 0.6)
    assert w[0] > 0 > w[1]
    assert len(quality.statistics(None)) == len(quality.statistics("a b.")) == len(quality.STATISTICS)
    assert rng is not None and labelled.FOLDS == 5


def test_matrices_leave_out_unusable_vectors():
    import pyarrow as pa

    given = [[1.0, 2.0], None, [0.0, 0.0], [1.0, None], [1.0, float("inf")], [], [3.0, 4.0], [1.0]]
    found = {v.shape[1]: (rows.tolist(), v.tolist()) for rows, v in matrices(pa.array(given, pa.list_(pa.float64())))}
    assert found == {1: ([7], [[1.0]]), 2: ([0, 6], [[1.0, 2.0], [3.0, 4.0]])}
    assert list(matrices(pa.array([], pa.list_(pa.float64())))) == []
    assert stacked([np.ones(2).tobytes(), np.ones(1).tobytes()]).tolist() == [[1.0, 1.0], [1.0, 0.0]]


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(21)
    features = lambda good: np.stack([np.where(good, rng.integers(0, 6, len(good)), rng.integers(4, 10, len(good))) + 10 * j for j in range(4)], axis=1)
    positive = features(np.ones(4000, bool))
    unlabelled = features(rng.random(6000) < share)
    assert abs(quality.prior_of(positive, unlabelled) - share) < 0.05
