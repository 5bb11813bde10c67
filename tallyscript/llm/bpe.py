"""Byte-level BPE (operator 5) by a sentencepiece model that is serialised straight from a rank file.

Each vocabulary entry becomes a piece whose bytes are mapped to printable characters (one each); its score is
its negative rank and normalisation is the identity, so sentencepiece's merge order is that of the ranks.
A pre-token (a match of the split pattern) is encoded on its own; one that is itself an entry gets that id at
once, as rank encoders do. Decoding maps ids to pieces and their characters back to bytes.

Nulls and empty texts have no ids. Texts that hold special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPACE, Chunks
from .shared import beside, text_batches


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [x for _, x in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece ModelProto: piece i is entry i, then the unknown piece that a model must have."""
    letters = byte_characters()
    out = bytearray()
    for rank, entry in enumerate(entries):
        piece = "".join(letters[b] for b in entry).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with the serialised model; `pattern` splits a text into pre-tokens."""

    def __init__(self, entries: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(entries))
        self.letters = byte_characters()
        self.split = regex.compile(pattern.replace(r"[^\s\p", rf"[^{SPACE[1:-1]}\p").replace(r"\s", SPACE).replace(r"\S", rf"[^{SPACE[1:-1]}]")).findall
        self.whole = {e: i for i, e in enumerate(entries)}
        byte = {c: bytes([b]) for b, c in enumerate(self.letters)}
        pieces = map(self.processor.id_to_piece, range(len(entries)))
        self.bytes_of = {str(i): b"".join(map(byte.__getitem__, p)) for i, p in enumerate(pieces)}
        self.chunks = Chunks(self.words)

    def tokens(self, tokens: list[str]) -> list[str]:
        """The ids of pre-tokens, each as decimals joined by commas."""
        data = [t.encode("utf-8", "replace") for t in tokens]
        ids = [self.whole.get(d) for d in data]
        letters = self.letters.__getitem__
        rest = [i for i, one in enumerate(ids) if one is None]
        found = self.processor.encode(["".join(map(letters, data[i])) for i in rest], out_type=int, num_threads=1) if rest else []
        out = list(map(str, ids))
        for i, x in zip(rest, found, strict=True):
            out[i] = str(x)[1:-1].replace(" ", "")
        return out

    def words(self, words: list[str]) -> list[str]:
        """The ids of words that follow a space. Letters alone are one pre-token, and so is a last full stop or comma."""
        tokens, ends = [], []
        for w in words:
            if w.isalpha():
                tokens.append(" " + w)
            elif w[-1] in ".,|" and w[:-1].isalpha():
                tokens += (" " + w[:-1], w[-1])
            else:
                tokens += self.split(" " + w)
            ends.append(len(tokens))
        distinct = list(set(tokens))
        of = dict(zip(distinct, self.tokens(distinct), strict=True)).__getitem__
        out, start = [], 0
        for end in ends:
            out.append(of(tokens[start]) if end == start + 1 else ",".join(map(of, tokens[start:end])))
            start = end
        return out

    def encode_all(self, texts: list[str | None]) -> list[str]:
        """For each text its ids as decimals joined by commas."""
        out = []
        for text, cut in zip(texts, self.chunks.of(texts), strict=True):
            if not text:
                out.append("")
            elif cut is None:
                out.append(",".join(self.tokens(self.split(text))))
            else:
                first, rest = cut
                out.append(",".join(self.tokens(self.split(first)) + rest))
        return out

    def encode(self, text: str | None) -> str:
        return self.encode_all([text])[0]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, kept by the worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The input with a column `ids` (array of int) of the encoded texts; one that is there becomes `ids_input`."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([list(map(int, ids.split(","))) if ids else [] for ids in c.encode_all(texts.to_pylist())], pa.list_(pa.int32()))

    docs = beside(docs, "ids")
    return docs.withColumn("ids", encode(F.col(text_col)))


def decode_column(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The input with a column `decoded` (binary), the bytes that the ids stand for; null ids give no
    bytes, and a column `decoded` that is there becomes `decoded_input`."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([c.decode(",".join(map(str, x or ()))) for x in ids.to_pylist()], pa.binary())

    docs = beside(docs, "decoded")
    return docs.withColumn("decoded", decode(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row of docs (doc_id, text): n_tokens, ids_sha256 and decoded_sha256, the last one of the bytes
    that the encoded ids decode to. Ids stay in the worker, so nothing of the size of the texts leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in text_batches(batches):
            n, a, d = [], [], []
            for ids in c.encode_all(b.column(1).to_pylist()):
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
