"""WARC archives (operator 2): records written to .warc.gz files, read back into a content-addressed store.

* `write` makes a WARC/1.1 record of each page. Of records with one payload of at least `MIN_SHARED` bytes, that of
  the smallest page_id is a response and the others are revisits of it, without a payload; smaller ones are all
  responses. A task writes one gzip file (a member per record) to the shared folder under a name of its own
  attempt, and reports it as a row; only rows that Spark commits count, so a task that is run again leaves nothing
  that is read.
* `ingest` reads archives, checks each payload against the SHA-256 its record states, and stores payload bytes once
  by that digest and, apart from them, each record's exact headers.
* `reconstruct` joins the two back into the original records.

Null html is an empty payload; a null url is an empty target. Rows that repeat the smallest page_id of a payload are
all responses (their bytes are still stored once). A row without a page_id has the record id `<urn:page:>`, comes back
with a null page_id, and is a revisit where a row with an id has its payload. An empty table gives an archive without
records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored, text_batches

MIN_SHARED = 100
LEVEL = 6
_CRLF = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> tuple[bytes, bytes]:
    """(headers, content) of a record; a revisit's content is the HTTP head alone."""
    digest = digest or hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    content = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", content


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for b in text_batches(batches, 64):
            if out is None:
                system, path = _opened(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, content = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, digest=digest)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(head + content + _CRLF + _CRLF) + z.flush()
                out.write(member)
                n += 1
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return run


def write(pages: DataFrame) -> DataFrame:
    """Writes the records of pages (page_id, url, html) and gives the manifest: file, records, bytes.

    What is shuffled is a digest per page; the pages themselves go straight to the archive unless there are so many
    revisits that their table is too large to send to each task.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.col("url").cast("string"), "html", F.sha2(F.encode(html, "utf-8"), 256).alias("digest"))
    shared = pages.where(F.octet_length(html) >= MIN_SHARED)
    first = shared.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first)
    pages = pages.join(first, "digest", "left")
    revisit = (F.octet_length(html) >= MIN_SHARED) & F.col("refers_to").isNotNull() & ~F.equal_null(F.col("page_id"), F.col("refers_to"))
    rows = pages.select("page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("html")).alias("html"), "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"))
    return stored(rows.mapInArrow(_writer(shared_dir(spark)), "file string, records long, bytes long"))


def parse(head: bytes) -> dict[str, str]:
    """The named fields of a record's header block, by lower-case name; of a repeated name the first counts."""
    fields: dict[str, str] = {}
    for line in head.split(_CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    return fields


def read_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(header block with its blank line, content) of each record of a .warc.gz or .warc stream, which is read in pieces."""
    data, z = bytearray(), None
    plain = None
    ended = False
    while True:
        end = data.find(b"\r\n\r\n")
        need = None
        if end >= 0:
            head = bytes(data[: end + 4])
            need = end + 4 + int(parse(head)["content-length"])
        if need is not None and len(data) >= need + 4:
            if data[need : need + 4] != b"\r\n\r\n":
                raise ValueError("a WARC record that isn't followed by two line ends")
            yield head, bytes(data[end + 4 : need])
            del data[: need + 4]
            continue
        if ended:
            if data.strip():
                raise ValueError("a WARC file that ends within a record")
            return
        chunk = stream.read(1 << 16)
        if not chunk:
            ended = True
            continue
        if plain is None:
            plain = chunk[:2] != b"\x1f\x8b"
        if plain:
            data += chunk
            continue
        while chunk:
            z = z or zlib.decompressobj(31)
            data += z.decompress(chunk)
            chunk, z = (z.unused_data, None) if z.eof else (b"", z)


_HEADERS = "file string, number long, record_id string, record_type string, refers_to string, digest string, warc_head binary, http_head binary"


def _reader(payloads: bool):
    """Files to their records: either the headers of all, with payloads verified, or the payloads of those that hold one."""
    schema = (
        pa.schema([("file", pa.string()), ("number", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])
        if payloads
        else pa.schema([("file", pa.string()), ("number", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("warc_head", pa.binary()), ("http_head", pa.binary())])
    )

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def read(file: str) -> Iterator[tuple[tuple, int]]:
        system, path = _opened(file)
        with system.open_input_stream(path, compression=None) as stream:
            for number, (head, content) in enumerate(read_records(stream)):
                f = parse(head)
                revisit = f["warc-type"] == "revisit"
                cut = content.find(b"\r\n\r\n") + 4 if f.get("content-type", "").startswith("application/http") else 0
                payload = content[cut:]
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                if payloads:
                    if not revisit:
                        yield (file, number, digest, payload), len(payload)
                    continue
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"record {f.get('warc-record-id')} of {file}: its payload has another digest")
                yield (file, number, f.get("warc-record-id"), f["warc-type"], f.get("warc-refers-to"), digest, head, content[:cut]), len(head) + cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                rows, size = [], 0
                for row, n in read(file):
                    rows.append(row)
                    size += n
                    if size > 4_000_000 or len(rows) >= 10_000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return run


def ingest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads the manifest's archives into the store: (headers, payloads), two tables in the shared folder.

    headers: file, number, record_id, record_type, refers_to, digest, warc_head, http_head. payloads: digest, payload,
    one row per digest. Which record's bytes are kept is settled by (file, number) alone, so no payload is shuffled.
    """
    files = manifest.select("file").repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, 1), "file")
    headers = stored(files.mapInArrow(_reader(False), _HEADERS))
    held = headers.where("record_type <> 'revisit'").groupBy("digest").agg(F.min(F.struct("file", "number")).alias("at"), F.count("*").alias("n"))
    again = stored(held.where("n > 1").select("digest", "at"))
    read = files.mapInArrow(_reader(True), "file string, number long, digest string, payload binary")
    kept = read.join(again, "digest", "left").where("at is null or (file = at.file and number = at.number)")
    return headers, stored(kept.select("digest", "payload"))


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records with their full payloads: headers' columns, payload, and `record`, the archive's exact bytes."""
    whole = headers.join(payloads, "digest", "left")
    own = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))
    return whole.withColumn("record", F.concat("warc_head", "http_head", own))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record as read back and reconstructed."""
    records = reconstruct(*ingest(write(pages)))
    number = r"<urn:page:(-?\d*)>"
    return records.select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), F.regexp_extract("refers_to", number, 1).cast("long")).alias("refers_to"),
    )
