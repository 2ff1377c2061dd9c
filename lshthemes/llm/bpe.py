"""Byte-level BPE encoding and decoding by a pair occurrence index.

The new pieces of a batch of texts are laid end to end. An index maps every mergeable pair to all its positions there;
ranks are applied in ascending order, each to all positions of its pair at once, and only the lists of the pairs beside
a merge are updated. Within a piece this is the order of the library: lowest rank first, of one rank from the left.
Ids of chunks seen before are remembered (bounded), so the index only ever holds new ones.

``encode`` gives ids as bytes: little-endian unsigned 32-bit integers. The vocabulary is a file of the ``tokenizers``
library, read by each worker from a path that all machines have; nothing is trained.

Edge cases: a null or empty text has no ids, and no ids decode to the empty text. Special tokens in a text become their
ids, as in the library. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from lshthemes.llm.chunks import Remembered, cut

_GAP = -1  # stands between two pieces


def _byte_letters() -> list[str]:
    """The letter by which vocabulary files write each byte: visible Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in shown)
    moved = {b: chr(256 + k) for k, b in enumerate(rest)}
    return [chr(b) if b in shown else moved[b] for b in range(256)]


class PairIndexBpe:
    """A vocabulary with its merges, and the chunks encoded so far."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, letters = data["model"]["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(self.merges)}
        byte_at = {i: b for b, i in enumerate(self.byte_id.tolist())}
        self.byte_ranks = np.full((256, 256), -1, dtype=np.int64)
        for r, (a, b, _) in enumerate(self.merges):
            if a in byte_at and b in byte_at:
                self.byte_ranks[byte_at[a], byte_at[b]] = r
        self.pattern = regex.compile(pattern)
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = Remembered(self.learn)

    def parts(self, text: str) -> list[str]:
        """Chunks of a text; where special tokens occur, they and the pieces between them."""
        if self.stops and self.stops.search(text):
            out: list[str] = []
            for span in self.stops.split(text):
                out.extend([span] if span in self.special else self.pattern.findall(span))
            return out
        return cut(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.chunks.ids([self.parts(t) for t in texts])

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks, over one index."""
        find, special = self.pattern.findall, self.special
        # letters alone, or after one blank, are a piece by themselves
        split = [[c] if c.isalpha() or (c[:1] == " " and c[1:].isalpha()) else [] if c in special else find(c) for c in chunks]
        pieces = list({p for s in split for p in s})
        ids = dict(zip(pieces, self.merge([p.encode() for p in pieces]), strict=True))
        return [
            np.uint32(special[c]).astype("<u4").tobytes() if c in special else b"".join(map(ids.__getitem__, s))
            for c, s in zip(chunks, split, strict=True)
        ]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, all merged together over one index of pair positions."""
        if not pieces:
            return []
        flat = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        symbols = self.byte_id[flat]
        symbols[ends] = _GAP
        ranks = self.byte_ranks[flat[:-1], flat[1:]]
        ranks[ends[:-1]] = -1
        ranks[ends - 1] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        heads, starts = np.unique(ranks[at], return_index=True)
        places = {r: p.tolist() for r, p in zip(heads.tolist(), np.split(at, starts[1:]), strict=True)} if len(at) else {}
        active = list(places)
        heapq.heapify(active)
        sym = symbols.tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        rank_of, merges = self.rank.get, self.merges
        while active:
            r = heapq.heappop(active)
            left, right, new = merges[r]
            at_left = new << 32
            for i in sorted(places.pop(r)):
                j = after[i]
                if sym[i] != left or sym[j] != right:
                    continue  # an earlier merge took one of the two
                k = after[j]
                sym[i], sym[j] = new, _GAP
                after[i] = k
                before[k] = i
                h = before[i]
                n = rank_of(sym[h] << 32 | new)
                if n is not None:
                    if n in places:
                        places[n].append(h)
                    else:
                        places[n] = [h]
                        heapq.heappush(active, n)
                n = rank_of(at_left | sym[k])
                if n is not None:
                    if n in places:
                        places[n].append(i)
                    else:
                        places[n] = [i]
                        heapq.heappush(active, n)
        out = np.array(sym, dtype=np.int64)
        keep = out != _GAP
        counts = np.add.reduceat(keep, np.concatenate(([0], ends[:-1] + 1)))
        data, at = out[keep].astype("<u4").tobytes(), 0
        split = []
        for n in counts.tolist():
            split.append(data[at : at + 4 * n])
            at += 4 * n
        return split


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    known = data["model"]["vocab"] | {t["content"]: t["id"] for t in data["added_tokens"]}
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        plain = all(c in byte_of for c in token)
        out[i] = bytes(byte_of[c] for c in token) if plain else token.encode()
    return out


@functools.lru_cache(maxsize=2)
def _model(path: str, pattern: str) -> PairIndexBpe:
    return PairIndexBpe(path, pattern)


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.binary())


#: Texts of one index at a time; bounds its memory where batches hold long texts.
INDEX_CHARS = 1_000_000
#: Texts decoded together.
DECODED_ROWS = 512


def blocks(texts: Iterator[str | None], most: int) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, null as empty."""
    block, chars = [], 0
    for text in texts:
        block.append(text or "")
        chars += len(block[-1])
        if chars >= most:
            yield block
            block, chars = [], 0
    if block:
        yield block


def encoder(path: str, pattern: str) -> Callable:
    """A function from a text column to its ids as bytes."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(path, pattern)
        for batch in batches:
            for block in blocks((t.as_py() for t in batch), INDEX_CHARS):
                yield pa.array(model.encode(block), pa.binary())  # ids take more room than text: not whole batches

    return encode.asNondeterministic()  # else the optimizer may run it once for each use


def decode_ids(tokens: list[bytes], ids: bytes) -> str:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def decode_array(tokens: pa.Array, ids: pa.Array) -> pa.Array:
    """The text of each row of ids. The bytes of all tokens of the rows, taken one after the other, are the texts laid end to
    end; only rows that aren't UTF-8 as a whole are decoded one by one."""
    ids = pc.fill_null(ids, b"")
    _, ends, data = ids.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
    numbers = np.frombuffer(data, dtype="<u4")[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint32)
    taken = tokens.take(pa.array(numbers))
    places = np.frombuffer(taken.buffers()[1], dtype=np.int32) if len(taken) else np.zeros(1, dtype=np.int32)
    bounds = np.ascontiguousarray(places[taken.offset + ends - ends[0]])
    out = pa.StringArray.from_buffers(len(ids), pa.py_buffer(bounds), taken.buffers()[2] or pa.py_buffer(b""))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        known = tokens.to_pylist()
        return pa.array([decode_ids(known, i) for i in ids.to_pylist()], pa.string())
    return out


def decoder(path: str) -> Callable:
    """A function from ids as bytes to the text; null as no ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _tokens(path)
        for batch in batches:
            for first in range(0, len(batch), DECODED_ROWS):
                yield decode_array(tokens, batch.slice(first, DECODED_ROWS))

    return decode.asNondeterministic()


def round_trip(path: str, pattern: str) -> Callable:
    """A function from a text column to its ``ids`` as bytes and the text ``decoded`` from them, in one pass: of two
    functions in a row each would have a Python process for every task."""

    @F.arrow_udf("ids binary, decoded string")
    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, tokens = _model(path, pattern), _tokens(path)
        for batch in batches:
            for block in blocks((t.as_py() for t in batch), INDEX_CHARS):
                encoded = pa.array(model.encode(block), pa.binary())
                for first in range(0, len(encoded), DECODED_ROWS):
                    ids = encoded.slice(first, DECODED_ROWS)
                    yield pa.StructArray.from_arrays([ids, decode_array(tokens, ids)], names=["ids", "decoded"])

    return there_and_back.asNondeterministic()
