"""Token ids as length-delimited binary records, with an offset index beside them for reads in any order.

A record is: payload length (8 bytes), its masked checksum (4), payload, masked checksum of the payload (4); numbers are
little-endian, the checksum is CRC-32, rotated and shifted as in the record files of machine-learning frameworks. The
payload is: whether there is an identifier (1 byte), the identifier (8), ids before this record in its file (8), then
the ids in 2 bytes each if the vocabulary allows, else 4. Files hold documents in ascending order of identifier, one
file per range; the index is a table ``(file, part, id, offset, bytes, n_tokens)``.

Edge cases: null and empty texts give the end id alone. Null identifiers come first, equal ones are ordered by text.
An empty table gives an empty index. A text of any length is one record. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lshthemes.llm.bpe import blocks
from lshthemes.llm.chunks import Remembered, cut
from lshthemes.llm.files import create, new_part, open_random

MASK_DELTA = 0xA282EAD8  # fixed value of the record format
_HEAD = "<?qQ"
_FRAME = 16
#: Neighbouring records are fetched together up to this size.
SPAN_BYTES = 8 << 20
BLOCK_CHARS = 1_000_000
#: Chunks that the library encodes as one text.
JOINED = 100
#: Remembered chunks of one Python worker, about 220 bytes each; forgetting them changes no result.
REMEMBERED = 800_000
INDEX = "file string, part int, id bigint, offset bigint, bytes bigint, n_tokens bigint"


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack("<I", (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, masked(length), payload, masked(payload)))


def unframe(record: bytes) -> bytes:
    """The payload. Raises where a length or checksum is wrong."""
    length, payload = record[:8], record[12:-4]
    if record[8:12] != masked(length) or struct.unpack("<Q", length)[0] != len(payload):
        raise ValueError("damaged record length")
    if record[-4:] != masked(payload):
        raise ValueError("damaged record")
    return payload


class _Library:
    """The tokenizers library over chunks, each encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.stop, self.stop_id = self._stop(added)
        self.chunks = Remembered(self.learn if self.stop is None else self.learn_joined, REMEMBERED)

    def _stop(self, added: dict) -> tuple[str | None, int]:
        """The special token, if it parts what stands before and after it and takes nothing of either."""
        if len(added) != 1 or self.library.normalizer is not None:
            return None, 0
        ((own, token),) = added.items()
        stop = token.content
        loose = token.lstrip or token.rstrip or token.single_word or any(stop.startswith(stop[k:]) for k in range(1, len(stop)))
        return (None, 0) if loose else (stop, own)

    def learn(self, texts: list[str]) -> list[bytes]:
        out = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.width).tobytes() for e in out]

    def learn_joined(self, chunks: list[str]) -> list[bytes]:
        """As ``learn``, of chunks without special tokens: many to a text, the special token after each."""
        out: list[bytes] = []
        for first in range(0, len(chunks), JOINED):
            part = chunks[first : first + JOINED]
            (found,) = self.library.encode_batch_fast([self.stop.join(part) + self.stop], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.width)
            data, size, begin = ids.tobytes(), ids.itemsize, 0
            for end in (np.flatnonzero(ids == self.stop_id) * size).tolist():
                out.append(data[begin:end])
                begin = end + size
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        found = self.chunks.ids([cut(t) for t in texts] if not whole else [[] if k in whole else cut(t) for k, t in enumerate(texts)])
        for k, ids in zip(whole, self.learn([texts[k] for k in whole]), strict=True):
            found[k] = ids
        return found


@functools.lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def write_token_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text"
) -> str:
    """Writes record files and their index below ``folder``; returns the path of the index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out, before, offset = _library(tokenizer), None, 0, 0
        part, uri = new_part(folder, ".records")
        end = np.array([end_id], dtype=model.width).tobytes()
        size = len(end)
        try:
            for batch in batches:
                ids, at = batch.column(0).to_pylist(), 0
                rows: list[tuple] = []
                out = out or create(uri)
                for block in blocks((t.as_py() for t in batch.column(1)), BLOCK_CHARS):
                    for tokens in model.encode(block):
                        head = struct.pack(_HEAD, ids[at] is not None, ids[at] or 0, before)
                        record = frame(head + tokens + end)
                        out.write(record)
                        count = len(tokens) // size + 1
                        rows.append((uri, part, ids[at], offset, len(record), count))
                        offset, before, at = offset + len(record), before + count, at + 1
                names = ("file", "part", "id", "offset", "bytes", "n_tokens")
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True) if rows else ((),) * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))
        finally:
            if out:
                out.close()

    index = f"{folder}/index"
    ordered = (
        docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
        .repartitionByRange(F.asc_nulls_first("id"))
        .sortWithinPartitions(F.asc_nulls_first("id"), "text")
    )
    ordered.mapInArrow(write, INDEX).write.parquet(index)
    return index


def read_token_records(index: DataFrame, width: str = "<u2") -> DataFrame:
    """Records of the given index rows, in whatever order and number they come: ``(part, id, before, ids)`` with ids as
    little-endian unsigned 32-bit integers. Every checksum is verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "bytes", "part")), strict=True))
            for rows in _spans(wanted):
                with open_random(rows[0][0]) as file:
                    first, last = rows[0][1], rows[-1][1] + rows[-1][2]
                    data = file.read_at(last - first, first)
                out = []
                for _, offset, size, part in rows:
                    payload = unframe(data[offset - first : offset - first + size])
                    known, own, before = struct.unpack_from(_HEAD, payload)
                    ids = np.frombuffer(payload, width, offset=struct.calcsize(_HEAD)).astype("<u4").tobytes()
                    out.append((part, own if known else None, before, ids))
                columns = zip(*out, strict=True)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "id", "before", "ids"]
                )

    return index.select("file", "offset", "bytes", "part").mapInArrow(
        read, "part int, id bigint, before bigint, ids binary"
    )


def _spans(wanted: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of neighbouring records of one file, up to the size of one fetch."""
    span: list[tuple] = []
    size = 0
    for row in wanted:
        if span and (row[0] != span[-1][0] or row[1] != span[-1][1] + span[-1][2] or size + row[2] > SPAN_BYTES):
            yield span
            span, size = [], 0
        span.append(row)
        size += row[2]
    if span:
        yield span


def token_layout(spark: SparkSession, index_path: str, width: str = "<u2") -> DataFrame:
    """Where each document's ids stand in the whole sequence: ``(doc_id, start, n_tokens, ids_crc32)``, from the files.
    The ids before each file come from the index: one row per file."""
    index = spark.read.parquet(index_path)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return (
        read_token_records(index, width)
        .select(
            "part",
            F.col("id").alias("doc_id"),
            "before",
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.crc32("ids").alias("ids_crc32"),
        )
        .join(base, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
