"""WARC archives: written record by record, read back by byte range.

Every record is a gzip member of its own, so a reader needs no index. A read task gets a byte range of a file, looks for
the gzip magic in it, and tries each place: only one whose member decodes to a record header counts. From the first
such place on, members follow one another, and the task owns those that start inside its range, reading past its end to
finish the last. Pages with the payload of another one become revisits that name it.

Edge cases: a null page has an empty payload, and empty payloads are equal ones. A null ``url`` leaves the target out;
control characters in it are percent-encoded. Of equal payloads the row with the largest identifier is the response
(null identifiers count as smallest; rows repeated with
that identifier are responses too). Other columns are not stored. An empty
table gives no archive and reads back as no rows. A very long page is one record, held whole by the task that writes or
reads it, a few times over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lshthemes.llm.files import create, new_part, open_random

MAGIC = b"\x1f\x8b\x08"
#: Ranges are dealt to as many tasks as there are ranges, up to this many; then a task reads several.
MOST_TASKS = 50_000
#: Bytes of one read range, and of one fetch.
SPLIT_BYTES = 8 << 20
FETCH_BYTES = 1 << 20
#: A header is looked for in the first bytes of a member.
PEEK_BYTES = 64
RECORD_ID = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows with one payload are spread over so many tasks while they look up their response.
SALTS = 32


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, number: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{RECORD_ID}{'-' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields.append(("WARC-Profile", REVISIT))
        fields.append(("WARC-Refers-To", f"<{RECORD_ID}{'-' if refers_to is None else refers_to}>"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record. Raises on anything else."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    return fields, rest[:size]


def with_responses(pages: DataFrame, id: str, html: str, least: int = 0) -> DataFrame:
    """``(id, url, html, revisit, refers_to)``. Payloads shorter than ``least`` bytes are always stored.

    Digests shared by several rows are found by partial sums; a digest that very many rows share is looked up under
    salted keys, and the pages themselves are shuffled once, by salted digest."""
    body = F.coalesce(F.col(html), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(
        F.col(id).cast("bigint").alias("id"),
        url.cast("string").alias("url"),
        body.alias("html"),
        F.sha1(body.cast("binary")).alias("key"),
        F.monotonically_increasing_id().alias("number"),
    )
    heads = (
        pages.select(F.col(id).cast("bigint").alias("id"), body.alias("html"))
        .where(F.octet_length("html") >= least)
        .groupBy(F.sha1(F.col("html").cast("binary")).alias("key"))
        .agg(F.count("*").alias("n"), F.max("id").alias("head"))
        .where("n > 1")
    )
    salted = heads.select("key", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int")).join(
        salted.withColumn("shared", F.lit(True)), ["key", "salt"], "left"
    )
    shared = F.coalesce("shared", F.lit(False))
    return joined.select(
        "id",
        "url",
        "html",
        (shared & ~F.col("id").eqNullSafe(F.col("head"))).alias("revisit"),
        F.when(shared & ~F.col("id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """Writes archives below ``folder`` and returns their list ``(file, bytes, records)``, itself a stored table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, uri = new_part(folder, ".warc.gz")
        out, size, count = None, 0, 0
        try:
            for batch in batches:
                for i, url, body, revisit, to in zip(*(c for c in batch.columns), strict=True):
                    out = out or create(uri)
                    data = record(i.as_py(), count, url.as_py(), body.as_py().encode(), to.as_py(), revisit.as_py())
                    out.write(data)
                    size, count = size + len(data), count + 1
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_pydict({"file": [uri], "bytes": [size], "records": [count]})

    path = f"{folder}/archives"
    with_responses(pages, id, html, least).mapInArrow(write, "file string, bytes bigint, records bigint").write.parquet(path)
    return pages.sparkSession.read.parquet(path)


class _Window:
    """Bytes of a file from some place on, fetched as they are asked for."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start, self.data, self.size = file, start, b"", file.size()

    def at(self, place: int, count: int) -> bytes:
        """Up to ``count`` bytes at ``place``; only places at or after the last one asked for."""
        if place > self.start:
            self.data, self.start = self.data[place - self.start :], place
        missing = min(count, self.size - place) - len(self.data)
        if missing > 0:
            self.data += self.file.read_at(max(missing, min(FETCH_BYTES, self.size - self.start - len(self.data))), self.start + len(self.data))
        return self.data[:count]


def _member(window: _Window, place: int) -> tuple[bytes, int]:
    """The member at ``place``, decoded to its end and checked, and the place after it."""
    unpack, out, at = zlib.decompressobj(31), [], place
    while not unpack.eof:
        data = window.at(at, FETCH_BYTES)
        if not data:
            raise ValueError("the file ends within a member")
        out.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
    return b"".join(out), at


def _starts_record(window: _Window, place: int) -> bool:
    try:
        head = zlib.decompressobj(31).decompress(window.at(place, 4096), PEEK_BYTES)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.")


def records_of(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in ``[start, end)``."""
    window, place = _Window(file, start), start
    while place < end:
        data = window.at(place, FETCH_BYTES)
        found = data.find(MAGIC)
        if found < 0:
            if len(data) < FETCH_BYTES:
                return
            place += len(data) - len(MAGIC) + 1
            continue
        place += found
        if place >= end:
            return
        if not _starts_record(window, place):
            place += 1
            continue
        while place < end and place < window.size:
            raw, place = _member(window, place)
            yield parse(raw)
        return


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records: ``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)``. A revisit has no
    payload; its size and digest are those of the page it repeats. Digests of responses are verified."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_random(uri) as file:
                    rows, size = [], 0
                    for fields, block in records_of(file, start, end):
                        rows.append(_row(fields, block))
                        size += len(block)
                        if size > FETCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = archives.where("bytes > 0").select("file", starts.alias("start")).select(
        "file", "start", (F.col("start") + split_bytes).alias("end")
    )
    # a count without a key is kept as it is, else these few small rows would end up in one task
    tasks = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0)).cast("bigint")).first()[0]
    return ranges.repartition(min(max(tasks, 1), MOST_TASKS)).mapInArrow(read, schema)


def _page(value: str | None) -> int | None:
    number = value.strip("<>").removeprefix(RECORD_ID) if value else "-"
    return None if number == "-" else int(number)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)[1])
    known, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != known):
        raise ValueError("damaged payload")
    to = _page(fields.get("warc-refers-to"))
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, to, size, known, payload if kind == "response" else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
