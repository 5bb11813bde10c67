"""Personal data in texts (operator 10): patterns propose spans, checksums confirm them, context words score them.

Base kinds (leftmost, non-overlapping per kind; a match that fails its check is dropped and not retried):
email, ip (four parts of at most 255), card (13 to 19 digits that pass Luhn), phone (+ and 9 to 15 digits).
The method adds iban and ssn, which has no checksum and so needs a context word nearby. An iban begins with a country
and two check digits, in either case, and may be parted by single spaces or hyphens; its country says how many
characters belong to it, whatever follows, and mod-97 confirms them.

Every span has a score: what its pattern and validator are worth by themselves, raised by a whole context word within
`CONTEXT` characters before it. Base spans always stay; added ones must reach `MIN_SCORE`. The query returns the scores.

Nulls and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT = 40
MIN_SCORE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does, and none of its runs can be shortened: so it is linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=[ -]?[A-Za-z0-9])")
_IBAN_PART = re.compile(r"[ -]?([A-Za-z0-9])")
#: How many characters an account number of each country has.
IBAN_LENGTHS = {
    k: int(n)
    for n, countries in (
        x.split(":")
        for x in (
            "15:NO", "16:BE", "18:DK FI FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL",
            "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for k in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_MAYBE = re.compile(r"[0-9@]")
#: What a confirmed match is worth alone, and the words that raise it.
_SCORES = {
    "email": (0.9, ("mail", "email", "contact", "kontakt", "correo", "courriel")),
    "ip": (0.6, ("ip", "host", "server", "address", "adresse")),
    "card": (0.8, ("card", "visa", "credit", "karte", "carte", "tarjeta")),
    "phone": (0.7, ("phone", "telephone", "tel", "call", "fax", "mobile", "anruf", "llame", "telefon", "teléfono", "téléphone")),
    "iban": (0.8, ("iban", "bank", "account", "konto", "compte", "cuenta")),
    "ssn": (0.3, ("ssn", "social", "security", "insurance")),
}
_PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of an account number without spaces."""
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """What `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds, found from its @ signs: a run of local
    characters without one costs nothing, however long it is."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def ips(text: str, start: int = 0) -> list[tuple[int, int]]:
    if text.count(".", start) < 3:
        return []
    return [m.span() for m in _IP.finditer(text, start) if all(map(_octet, m[0].split(".")))]


def cards(text: str, start: int = 0) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text, start):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    start = text.find("+")
    return [m.span() for m in _PHONE.finditer(text, start) if 9 <= len(_digits(m[0])) <= 15] if start >= 0 else []


def score(text: str, kind: str, start: int) -> float:
    """What a span of the kind at `start` is worth: more with a context word shortly before it."""
    alone, words = _SCORES[kind]
    before = set(re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT) : start].lower()))
    return min(1.0, alone + 0.3) if not before.isdisjoint(words) else alone


def ibans(text: str, start: int = 0) -> list[tuple[int, int]]:
    found, free = [], 0
    for m in _IBAN.finditer(text, start):
        length = IBAN_LENGTHS.get(m[0][:2].upper())
        if m.start() < free or not length:
            continue
        own, at = m[0], m.end()
        while len(own) < length and (part := _IBAN_PART.match(text, at)):
            own += part[1]
            at = part.end()
        if len(own) == length and not (at < len(text) and text[at].isalnum()) and mod97(own.upper()):
            found.append((m.start(), at))
            free = at
    return found


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all personal data in a text, by kind as listed in KINDS, then start."""
    if not text or not (first := _MAYBE.search(text)):
        return []
    at = first.start()
    found = [("email", *s) for s in emails(text)]
    found += [("ip", *s) for s in ips(text, at)]
    found += [("card", *s) for s in cards(text, at)]
    found += [("phone", *s) for s in phones(text)]
    added = [("iban", *s) for s in ibans(text, max(0, at - 2))]
    added += [("ssn", *m.span()) for m in _SSN.finditer(text, at)]
    return [(k, s, e, score(text, k, s)) for k, s, e in found] + [x for k, s, e in added if (x := (k, s, e, score(text, k, s)))[3] >= MIN_SCORE]


def redacted(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by its kind's placeholder; of overlapping spans the first and longest counts,
    and what it leaves of the others goes with it."""
    if not found:
        return text
    out, at, last = [], 0, -1
    for kind, start, end, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= last:
            out += (text[at:start], _PLACEHOLDERS[kind])
        at = last = max(last, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id and its spans, array<struct<kind, start, end, score>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in text_batches(batches):
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, score double>>")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans and their scores as text, per row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in text_batches(batches):
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digest, every, worth = [], [], []
            for text in b.column(1).to_pylist():
                found = spans(text)
                for k, column in counts.items():
                    column.append(sum(f[0] == k for f in found) if found else 0)
                base = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found if k in BASE)
                digest.append(hashlib.sha256(base.encode()).hexdigest() if base else none)
                every.append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
                worth.append(",".join(f"{x:.2f}" for *_, x in found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), *(pa.array(x, pa.string()) for x in (digest, every, worth))],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with personal data replaced by placeholders; n_chars, if there, follows the new text."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(t, spans(t)) for t in texts.to_pylist()], pa.string())

    maybe = F.col(text_col).rlike("[0-9@]")
    out = docs.withColumn(text_col, F.when(maybe, clean(F.when(maybe, F.col(text_col)))).otherwise(F.col(text_col)))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
