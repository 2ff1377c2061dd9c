"""Repeated passages of 100 bytes, removed by a family of suffix arrays of geometric sizes.

Which bytes go: each that lies in a 100-byte string that also starts earlier (smaller identifier, or the same document
further left), judged on the texts as given.

Every 100-byte string is owned by one of its 24-byte grams, the one with the smallest hash. Neighbouring strings with one
owner form a run (at most 77, about 40 on average). Equal strings have equal owners at equal places, so only runs whose
owners agree can share a string:

1. Runs travel as numbers: hash of the owner, hash of the run's bytes, document (identifier and hash of the text), place. A block of texts keeps the first
   of its equal runs, so a passage that very many documents share leaves each block once. Sorted by owner, a run that
   equals an earlier one repeats as a whole; a run alone with its owner repeats nothing.
2. What is left are owners with different runs, mostly at the ends of passages. Each of their first runs, whether its owner
   has few or many, is dealt in blocks: strings in which the owner stands at one of 8 neighbouring places. The strings of a
   block have 93 bytes in common, its core, so only blocks with equal cores can share a string. Blocks settle by the hash of
   the core as runs do by their owner; at most 10 rows come of a run (5 on average), however many runs its owner has.
3. Blocks still open, of one core and different, fetch their bytes and meet by core. A task takes them in document order,
   batch by batch. A batch gets a suffix array, cut at 100 bytes; it is scanned along the levels before it for equal
   strings; its new strings become a level, and levels of one size class merge into one of the next. So a string is merged
   as often as the logarithm of the strings, and every batch is compared with all before it.
   A task takes its cores share by share, so what an index family holds doesn't grow with the texts. The strings of a core
   with very many blocks (a passage that as many documents share, with other bytes next to it in each) don't meet by core:
   each of them, 8 of a block at most, travels singly, as a number of 128 bits, and settles like a run of step 1.
4. Spans of each document come together and are cut out.

Edge cases: a null text is an empty one, and texts of less than 100 bytes lose nothing. Null identifiers go before all
others. Rows repeated with identifier and text are one document; rows with one identifier and different texts are
ordered by a hash of the text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.llm.bpe import blocks
from lshthemes.llm.packing import ROWS, packed
from lshthemes.sources.scratch import scratch_path

LENGTH = 100
GRAM = 24
OWNED = LENGTH - GRAM + 1  # grams of a string
#: Characters of texts whose runs are looked at together, and strings of a batch of the index family.
BLOCK_CHARS = 1_000_000
BATCH_STRINGS = 4_096
#: Places of the owner in the strings of a block.
BLOCK = 8
#: Open blocks from which on a core's strings are dealt singly, and open blocks that one index family holds, about. A block
#: has at most ``BLOCK`` strings.
HOT_RUNS = 8_000
SHARE_RUNS = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)
_LETTERS = np.random.RandomState(5).randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A place: the start, in 7 bits how far on the owner stands, and in 7 bits the number of strings.
_COUNT_BITS = 7
_START_BITS = 2 * _COUNT_BITS
_COUNT = (1 << _COUNT_BITS) - 1
NO_ID = -(1 << 63)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _A + b
    out ^= out >> np.uint64(32)
    out *= _B
    return out


def _join(h: np.ndarray, size: int, other: np.ndarray | None = None, step: int | None = None) -> np.ndarray:
    """Hashes of strings put together from those at a place and ``step`` further on."""
    step = step or size
    right = (h if other is None else other)[step:]
    return _mix(h[: len(right)], right)


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end, all at least ``LENGTH`` long: ``(text, start, bytes from there to the owner, strings,
    owner hash, run hash)``."""
    h8 = _LETTERS[data]
    for size in (1, 2, 4):
        h8 = _join(h8, size)
    h16 = _join(h8, 8)
    gram = _join(h16, 16, h8)[: len(data) - GRAM + 1]
    h64 = _join(_join(h16, 16), 32)
    whole = _join(h64, 64, step=LENGTH - 64)
    least = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= OWNED:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < OWNED:
        least = np.minimum(least[: width - OWNED], least[OWNED - width :])
    owner = (least & _LOW).astype(np.int64)
    inside = np.zeros(len(owner) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - LENGTH + 1, -1)
    owner[np.cumsum(inside[:-1], dtype=np.int8) == 0] = -1
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(owner)))
    kept = owner[first] >= 0
    first, count = first[kept], count[kept]
    text = np.searchsorted(starts, first, side="right") - 1
    run = _mix(_mix(whole[first], whole[first + count - 1]), count.astype(np.uint64))
    return text, first - starts[text], owner[first] - first, count, gram[owner[first]].view(np.int64), run.view(np.int64)


def _first_of_equal(g: np.ndarray, r: np.ndarray, d: np.ndarray, t: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal runs, and of those that repeat one. Of one run told twice, only one is in them."""
    order = np.lexsort((pos, t, d, r, g))
    g, r, d, t, pos = g[order], r[order], d[order], t[order], pos[order]
    fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))
    twice = np.concatenate(([False], (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (pos[1:] == pos[:-1]))) & ~fresh
    return order[fresh], order[~fresh & ~twice]


def _document(id: str, text: str) -> list[Column]:
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return [F.coalesce(F.col(id).cast("bigint"), F.expr("-9223372036854775807L - 1L")).alias("d"), own.alias("t")]


def text_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(g, r, d, t, pos, again)``: runs by owner and bytes; ``again`` where the block has an equal one before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            for block in blocks((x.as_py() for x in batch.column(2)), BLOCK_CHARS):
                raw = [x.encode() for x in block]
                long = np.array([k for k, x in enumerate(raw) if len(x) >= LENGTH], dtype=np.int64)
                ids, own = d[at : at + len(raw)], t[at : at + len(raw)]
                at += len(raw)
                if not len(long):
                    continue
                sizes = np.array([len(raw[k]) for k in long], dtype=np.int64)
                data = np.frombuffer(b"".join(raw[k] for k in long), dtype=np.uint8)
                which, start, ahead, count, g, r = runs(data, np.cumsum(sizes) - sizes, sizes)
                of = long[which]
                pos = (start << _START_BITS) | (ahead << _COUNT_BITS) | count
                doc, mark = ids[of], own[of]
                first, again = _first_of_equal(g, r, doc, mark, pos)
                for picked, repeats in ((first, False), (again, True)):
                    key = doc[picked] * 31 if repeats else g[picked]  # repeats only pass through; spread them
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(r[picked]), pa.array(doc[picked]), pa.array(mark[picked]), pa.array(pos[picked]), pa.array(np.full(len(picked), repeats))],
                        ["g", "r", "d", "t", "pos", "again"],
                    )

    source = docs.select(*_document(id, text), F.col(text).alias("text"))
    return source.mapInArrow(cut, "g bigint, r bigint, d bigint, t bigint, pos bigint, again boolean")


def settle_runs(found: DataFrame) -> DataFrame:
    """``(g, d, t, pos, open)``: runs that repeat an earlier one, and (open) the first of equal runs where an owner has
    different ones. Holds one run at a time beside the batch."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, ...] | None = None  # the last first run, and whether another of its owner came before

        def rows(g, d, t, pos, open_) -> pa.RecordBatch:  # noqa: ANN001
            return pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(d), pa.array(t), pa.array(pos), pa.array(open_)], ["g", "d", "t", "pos", "open"]
            )

        last = (0, 0, 0, 0, 0)
        for batch in batches:
            g, r, d, t, pos = (batch.column(k).to_numpy() for k in range(5))
            again = batch.column(5).to_numpy(zero_copy_only=False)
            if again.any():
                yield rows(g[again], d[again], t[again], pos[again], np.zeros(int(again.sum()), dtype=bool))
                g, r, d, t, pos = g[~again], r[~again], d[~again], t[~again], pos[~again]
            if not len(g):
                continue
            before = [np.concatenate(([v], c[:-1])) for v, c in zip(last, (g, r, d, t, pos), strict=True)]
            same_owner = g == before[0]
            same_run = same_owner & (r == before[1])
            twice = same_run & (d == before[2]) & (t == before[3]) & (pos == before[4])
            if held is None:
                same_owner[0] = same_run[0] = twice[0] = False
            last = (g[-1], r[-1], d[-1], t[-1], pos[-1])
            repeats = same_run & ~twice
            if repeats.any():
                yield rows(g[repeats], d[repeats], t[repeats], pos[repeats], np.zeros(int(repeats.sum()), dtype=bool))
            first = np.flatnonzero(~same_run)
            if not len(first):
                continue
            fg, fd, ft, fp = g[first], d[first], t[first], pos[first]
            if held is not None:
                fg, fd, ft, fp = (np.concatenate(([h], x)) for h, x in zip(held[:4], (fg, fd, ft, fp), strict=True))
            joined = fg[1:] == fg[:-1]
            earlier = np.concatenate(([bool(held[4]) if held is not None else False], joined))
            later = np.concatenate((joined, [False]))
            held = (fg[-1], fd[-1], ft[-1], fp[-1], bool(earlier[-1]))
            mixed = (earlier | later)[:-1]
            if mixed.any():
                yield rows(fg[:-1][mixed], fd[:-1][mixed], ft[:-1][mixed], fp[:-1][mixed], np.ones(int(mixed.sum()), dtype=bool))
        if held is not None and held[4]:
            yield rows([held[0]], [held[1]], [held[2]], [held[3]], [True])

    kind = "g bigint, d bigint, t bigint, pos bigint, open boolean"
    return found.repartition("g").sortWithinPartitions("g", "r", "d", "t", "pos").mapInArrow(settle, kind)


class IndexFamily:
    """Levels of sorted 100-byte strings. Sizes of levels fall geometrically; two of one class merge."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, strings: list[bytes]) -> list[np.ndarray]:
        """Takes a batch of runs, in order; of each, which of its strings an earlier run of any batch has."""
        counts = np.array([len(s) - LENGTH + 1 for s in strings])
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        begins = np.cumsum([len(s) for s in strings]) - [len(s) for s in strings]
        at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}").ravel()
        array = np.argsort(suffixes, kind="stable")  # the batch's suffix array, cut at LENGTH
        ordered = suffixes[array]
        seen = np.concatenate(([False], ordered[1:] == ordered[:-1]))
        for level in self.levels:
            place = np.minimum(np.searchsorted(level, ordered), len(level) - 1)
            seen |= level[place] == ordered
        self._keep(ordered[~seen])
        known = np.zeros(len(array), dtype=bool)
        known[array] = seen
        return np.split(known, np.cumsum(counts)[:-1])

    def _keep(self, level: np.ndarray) -> None:
        if not len(level):
            return
        while self.levels and self.levels[-1].size.bit_length() <= level.size.bit_length():
            level = np.concatenate([self.levels.pop(), level])
            level.sort(kind="stable")
        self.levels.append(level)


def open_spans(strings: DataFrame, shares: int = 1) -> DataFrame:
    """``(d, t, start, count)`` of strings that are there earlier, of runs ``(g, d, t, pos, bytes)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, last, at_share = IndexFamily(), None, None
        for batch in (part for whole in batches for part in _by_share(whole)):
            if batch.num_rows and (share := batch.column(5)[0].as_py()) != at_share:
                family, at_share = IndexFamily(), share
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(4)])
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))  # repeated rows tell a run twice
            if len(keys):
                fresh[0] = last is None or (keys[0] != last).any()
                last = keys[-1]
            batch = batch.filter(pa.array(fresh[: len(keys)]))
            for first in range(0, batch.num_rows, BATCH_STRINGS):
                part = batch.slice(first, BATCH_STRINGS)
                d, t, pos = (part.column(k).to_numpy() for k in (1, 2, 3))
                known = family.add(part.column(4).to_pylist())
                of = np.repeat(np.arange(len(known)), [len(k) for k in known])
                flat = np.concatenate(known)
                place = np.concatenate([np.arange(len(k)) for k in known])
                begins = flat & np.concatenate(([True], ~flat[:-1] | (of[1:] != of[:-1])))
                at = np.flatnonzero(begins)
                if not len(at):
                    continue
                count = np.add.reduceat(flat.astype(np.int64), at)
                yield _spans(d[of[at]], t[of[at]], pos[of[at]], place[at], count)

    shared = strings.withColumn("share", F.pmod(F.xxhash64("g", F.lit(9)), F.lit(shares)).cast("int"))
    return shared.repartition("g").sortWithinPartitions("share", "d", "t", "pos", "g").mapInArrow(scan, SPANS)


def _by_share(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    share = batch.column(5).to_numpy()
    ends = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(share)]
    return (batch.slice(a, b - a) for a, b in zip(ends, ends[1:], strict=False))


SPANS = "d bigint, t bigint, start bigint, count bigint"


def _spans(d: np.ndarray, t: np.ndarray, pos: np.ndarray, shift: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    start = (pos >> _START_BITS) + shift
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(start), pa.array(count)], ["d", "t", "start", "count"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``(g, d, t, pos, bytes)`` of the runs, or blocks, of ``(d, t, runs, packed)``."""
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        for d, t, runs_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            data = tool.decompress(data.as_py())
            for run in runs_.as_py():
                pos = run["pos"]
                start, count = pos >> _START_BITS, pos & _COUNT
                yield run["g"], d, t, pos, data[start : start + count + LENGTH - 1]


def _with_texts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    wanted = open_.groupBy("d", "t").agg(F.collect_list(F.struct("pos", "g")).alias("runs"))
    return docs.join(wanted, ["d", "t"]).select("d", "t", "runs", "packed")


def _run_bytes(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """``(g, d, t, pos, bytes)`` of the open blocks."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in _pieces(batches):
            out.append(row)
            size += len(row[4])
            if size > 8_000_000:
                yield _strings(out)
                out, size = [], 0
        if out:
            yield _strings(out)

    def _strings(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], ["g", "d", "t", "pos", "bytes"])

    return _with_texts(docs, open_).mapInArrow(fetch, "g bigint, d bigint, t bigint, pos bigint, bytes binary")


def _blocks(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """The blocks of the open runs, in the shape of ``text_runs``: the hash of the core takes the place of the owner's."""

    def deal(g: int, d: int, t: int, pos: int, piece: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        start, owner, count = pos >> _START_BITS, pos >> _COUNT_BITS & _COUNT, pos & _COUNT
        first = 0
        while first < count:
            ahead = owner - first
            core = owner - ahead // BLOCK * BLOCK  # where the last string of a whole block would begin
            end = min(core + 1, count)
            common = xxhash.xxh3_64_intdigest(piece[core : core + LENGTH - BLOCK + 1], ahead // BLOCK)
            own = xxhash.xxh3_64_intdigest(piece[first : end + LENGTH - 1], ahead)
            yield common, own, d, t, (start + first) << _START_BITS | ahead << _COUNT_BITS | (end - first)
            first = end

    return _dealt(docs, open_, deal)


def _single_strings(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Each string of the open blocks by itself, in the shape of ``text_runs``: two hashes of it take the place of those of
    the owner and the run."""

    def deal(g: int, d: int, t: int, pos: int, piece: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        start = pos >> _START_BITS
        for k in range(pos & _COUNT):
            h = xxhash.xxh3_128_intdigest(piece[k : k + LENGTH])
            yield h >> 64, h & 0xFFFFFFFFFFFFFFFF, d, t, (start + k) << _START_BITS | 1

    return _dealt(docs, open_, deal)


def _dealt(docs: DataFrame, open_: DataFrame, deal: Callable) -> DataFrame:
    """What ``deal`` makes of the open runs or blocks: ``(g, r, d, t, pos)`` with unsigned hashes. Of the rows that a task
    holds together, ``again`` marks those that repeat one."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int]] = []
        for piece in _pieces(batches):
            held.extend(deal(*piece))
            if len(held) > 200_000:
                yield from _settled(held)
                held = []
        if held:
            yield from _settled(held)

    def _settled(held: list[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*held, strict=True))
        g, r = (np.array(c, dtype=np.uint64).view(np.int64) for c in columns[:2])
        d, t, pos = (np.array(c, dtype=np.int64) for c in columns[2:])
        first, again = _first_of_equal(g, r, d, t, pos)
        for picked, repeats in ((first, False), (again, True)):
            key = d[picked] * 31 + pos[picked] if repeats else g[picked]
            parts = [key, r[picked], d[picked], t[picked], pos[picked], np.full(len(picked), repeats)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], ["g", "r", "d", "t", "pos", "again"])

    return _with_texts(docs, open_).mapInArrow(fetch, "g bigint, r bigint, d bigint, t bigint, pos bigint, again boolean")


CUT = pa.struct(
    [
        ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)


def _without(data: bytes, spans: pa.StructArray | None) -> dict:
    """What is left of a text without the strings that ``spans(start, count)`` tell of, and the ranges that went."""
    merged, kept, at = [], [], 0
    if spans is not None and len(spans):
        start, count = spans.field(0).to_numpy(), spans.field(1).to_numpy()
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate((start + count + LENGTH - 1)[order])
        begin = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
        merged = list(zip(start[begin].tolist(), end[np.append(begin[1:], len(end)) - 1].tolist(), strict=True))
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return {"n_bytes": len(data), "spans": [{"start": a, "end": b} for a, b in merged], "kept": b"".join(kept)}


def _cut_out() -> Callable:
    @F.arrow_udf("struct<n_bytes:bigint,spans:array<struct<start:bigint,end:bigint>>,kept:binary>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tool = zstandard.ZstdDecompressor()
        for whole_texts, whole_spans in batches:
            for first in range(0, len(whole_texts), ROWS):
                texts, spans = whole_texts.slice(first, ROWS), whole_spans.slice(first, ROWS)
                out = [_without(tool.decompress(p.as_py()), s.values) for p, s in zip(texts, spans, strict=True)]
                yield pa.array(out, CUT)

    return cut.asNondeterministic()


def cut_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(id, n_bytes, spans array<struct<start, end>>, kept binary)``: what was removed, as byte
    ranges of the text in UTF-8, and what is left."""
    spark = docs.sparkSession
    path = scratch_path(spark, "runs")
    settle_runs(text_runs(docs, id, text)).write.parquet(path)
    settled = spark.read.parquet(path)
    texts = docs.select(F.col(id).alias("id"), *_document(id, text), packed(text).alias("packed"))
    sources = texts.drop("id")
    path = scratch_path(spark, "blocks")
    settle_runs(_blocks(sources, settled.where("open").select("g", "d", "t", "pos"))).write.parquet(path)
    blocks_ = spark.read.parquet(path)
    # cores with many open blocks are few: no more than the open blocks by HOT_RUNS
    open_ = blocks_.where("open").select("g", "d", "t", "pos")
    counts = open_.groupBy("g").count().where(F.col("count") > HOT_RUNS).select("g")
    path = scratch_path(spark, "hot-cores")
    counts.write.parquet(path)
    hot = spark.read.parquet(path)
    single, meeting = open_.join(F.broadcast(hot), "g", "left_semi"), open_.join(F.broadcast(hot), "g", "left_anti")
    shares = max(1, -(-meeting.count() // (SHARE_RUNS * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ends = settled.unionByName(blocks_).where("NOT open").drop("open")
    if not hot.isEmpty():
        ends = ends.unionByName(settle_runs(_single_strings(sources, single)).where("NOT open").drop("open"))
    whole = ends.select(
        "d",
        "t",
        F.shiftrightunsigned("pos", _START_BITS).alias("start"),
        F.col("pos").bitwiseAND(F.lit(_COUNT)).alias("count"),
    )
    spans = whole.unionByName(open_spans(_run_bytes(sources, meeting), shares))
    of = spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,count:bigint>>")
    cut = texts.join(of, ["d", "t"], "left").select("id", _cut_out()("packed", F.coalesce("spans", none)).alias("cut"))
    return cut.select(F.col("id").alias(id), "cut.*")
