"""Benchmark decontamination by templates.

Words are canonicalised: numbers, names (words with one capital in front) and units after a number become typed
placeholders, other words their lower case. Windows of ``WORDS`` words of the documents are joined with those of the
benchmark's items by hash, once as templates and once as plain lower-case words (a copy in other capitals). A template in
which plain words are no majority takes in the words beside it until they are. A filter of fixed size with the items' hashes lets tasks hold back windows that cannot
match. What fills the placeholders is then compared along each alignment of a document and an item: the same filler of the
item must always meet the same filler in the document. Templates along an alignment that contradicts itself do not count,
so a question whose names and numbers were exchanged is found, and a text that merely has the same form is not.

A document holds an item when matching windows cover ``SHARE`` of the item's windows.

Edge cases: null and empty texts have no windows. Items with fewer words than a window tell too little and are never
found; of an item with fewer than three plain words, windows of placeholders alone match only as plain words. Rows are told apart by identifier and a hash of the text, items too: rows with both alike are one, and rows without an
identifier, or with one identifier and different texts, are looked at one by one. Empty tables give no hits. Texts of
any length are cut whole, and rows that come back keep all their columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.llm.bpe import blocks
from lshthemes.sources.scratch import scratch_path

WORDS = 5
SHARE = 0.8
#: Bits of the filter that holds back windows: a fixed 2 MB, whatever the benchmark's size. No match depends on it.
FILTER_BITS = 24
REMEMBERED = 600_000
BLOCK_CHARS = 1_000_000
#: Words that are units when they follow a number. Fixed values.
UNITS = frozenset(
    "mm cm dm m km mg g kg t ml cl l s ms min h hz khz mhz w kw v a pa kb mb gb tb in ft yd mi oz lb lbs mph kmh "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms liter liters litre "
    "litres mile miles inch inches foot feet yard yards pound pounds ounce ounces degree degrees percent dollar dollars "
    "euro euros cent cents".split()
)
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_TOKENS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HOLES = np.array([0, *(xxhash.xxh64_intdigest(f"\x01{k}") for k in (NUMBER, NAME, UNIT))], dtype=np.uint64)
WINDOW = "hash bigint, place int, slots array<struct<kind:int, at:int, filler:string>>"


class _Grown:
    """A numpy array that grows at its end: values gather in a list and are moved over when the array is asked for."""

    def __init__(self, kind: type) -> None:
        self.data, self.size, self.new = np.zeros(1024, dtype=kind), 0, []
        self.add = self.new.append

    def array(self) -> np.ndarray:
        if self.new:
            need = self.size + len(self.new)
            while len(self.data) < need:
                self.data = np.concatenate([self.data, np.zeros_like(self.data)])
            self.data[self.size : need] = self.new
            self.size = need
            self.new.clear()
        return self.data


class _Tokens(dict):
    """Numbers of what stands between blanks. A token that isn't known yet is cut into its words when it is asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.first, self.count, self.flat = _Grown(np.int64), _Grown(np.int64), _Grown(np.int64)
        self.words: dict[str, int] = {}
        self.hashes, self.kinds, self.texts, self.length = _Grown(np.uint64), _Grown(np.int8), [], 0

    def __missing__(self, token: str) -> int:
        words = _TOKENS.findall(token)
        self.first.add(self.length)
        self.count.add(len(words))
        self.length += len(words)
        for word in words:
            known = self.words.get(word)
            self.flat.add(self._learn(word) if known is None else known)
        self[token] = own = len(self)
        return own

    def _learn(self, word: str) -> int:
        low, kind = word.lower(), PLAIN
        if word[0].isdigit():
            kind = NUMBER
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = NAME
        elif low in UNITS:
            kind = UNIT
        self.words[word] = own = len(self.texts)
        self.hashes.add(xxhash.xxh64_intdigest(low))
        self.kinds.add(kind)
        self.texts.append(word)
        return own


class Canon:
    """Words of texts as hashes with types. What a token holds is remembered; forgetting it changes nothing."""

    def __init__(self, limit: int = REMEMBERED) -> None:
        self.limit, self.known = limit, _Tokens()

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts laid end to end: hashes of the lower-case words, their types, their numbers in ``spelling``, and
        where each text begins, with the end of the last."""
        if len(self.known) > self.limit:
            self.known = _Tokens()
        known, tokens, sizes = self.known, [], [0]
        for text in texts:
            tokens += text.split()
            sizes.append(len(tokens))
        at = np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        count = known.count.array()[at]
        ends = np.concatenate(([0], np.cumsum(count)))
        begin = known.first.array()[at] - ends[:-1]
        word = known.flat.array()[np.repeat(begin, count) + np.arange(ends[-1])]
        bounds = ends[np.array(sizes)]
        kind = known.kinds.array()[word]
        units = np.flatnonzero(kind == UNIT)
        if len(units):
            alone = (kind[units - 1] != NUMBER) | np.isin(units, bounds)
            kind[units[alone]] = PLAIN
        return known.hashes.array()[word], kind, word, bounds

    def spelling(self, words: np.ndarray) -> list[str]:
        return [self.known.texts[w] for w in words.tolist()]


def _combined(hashes: np.ndarray, at: np.ndarray | None, size: int, salt: int) -> np.ndarray:
    """Hash of the ``size`` words from each place ``at`` on, or from every place."""
    n = len(hashes) - size + 1
    out = np.full(n if at is None else len(at), salt, dtype=np.uint64)
    for k in range(size):
        factor = np.uint64(pow(int(_STEP), k + 1, 1 << 64))
        out += (hashes[k : k + n] if at is None else hashes[at + k]) * factor
    out ^= out >> np.uint64(32)
    out *= _STEP
    return out


def _stretches(filled: np.ndarray) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """Hashes of the words from ``begin`` to ``end``, of any length, through sums over all words before."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(filled), _STEP))), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(filled), inverse))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((filled ^ (filled >> np.uint64(29))) * up[:-1], dtype=np.uint64)))

    def of(begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        out = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _HOLES[1] + np.uint64(salt)
        out ^= out >> np.uint64(32)
        out *= _STEP
        return out

    return of


def _heavy(
    filled: np.ndarray, special: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, size: int, own: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, hashes)`` of windows ``at`` in which plain words are no majority, of texts from ``first`` to ``last``: each
    window reaches out to the right, and to the left, until it holds as many plain words as would be one. In a text around
    an item one of the two stays within the item, unless the item has too few plain words on both sides. Such a window of
    an item (``own``) stands for itself if it has any plain word, and texts show all of theirs."""
    if not len(at):
        return
    most, spots = size // 2 + 1, np.flatnonzero(~special)
    before = np.concatenate(([0], np.cumsum(~special)))
    of = _stretches(filled)
    far = np.concatenate((spots, np.full(most, len(special))))  # past the end where there are too few
    end = far[before[at] + most - 1] + 1
    right = end <= last
    yield at[right], of(at[right], end[right], 3)
    begin = np.concatenate((np.full(most, -1), spots))[before[at + size]]
    left = begin >= first
    yield at[left], of(begin[left], at[left] + size, 4)
    bare = before[at + size] > before[at]
    if own:
        bare &= ~right & ~left
    yield at[bare], of(at[bare], at[bare] + size, 5)


def _rows(canon: Canon, texts: list[str], size: int, allow: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
    """Number of windows of each text, and ``(text, hash, place, slots)`` of those that the filter lets pass: all windows
    as plain words, and those with placeholders as templates."""
    hashes, kinds, numbers, bounds = canon.words(texts)
    totals = np.maximum(np.diff(bounds) - size + 1, 0)
    if not totals.any():
        return totals, []
    n = len(hashes) - size + 1
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))[:n]
    inside = np.arange(size, size + n) <= bounds[text + 1]  # windows never reach into the next text
    special = kinds != PLAIN
    holes = np.concatenate(([0], np.cumsum(special)))
    held = holes[size:] - holes[:n]
    light, heavy = (np.flatnonzero((held > 0) & most & inside) for most in (2 * held < size, 2 * held >= size))
    filled = np.where(special, _HOLES[kinds], hashes)
    begins, ends = bounds[text[heavy]], bounds[text[heavy] + 1]
    out = []
    for template, places, found in (
        (False, np.flatnonzero(inside), _combined(hashes, None, size, 2)[inside]),
        (True, light, _combined(filled, light, size, 1)),
        *((True, *x) for x in _heavy(filled, special, begins, ends, heavy, size, allow is None)),
    ):
        if allow is not None:
            passed = np.flatnonzero(allow[(found >> np.uint64(64 - FILTER_BITS)).view(np.int64)])
            places, found = places[passed], found[passed]
        for start, h in zip(places.tolist(), found.view(np.int64).tolist(), strict=True):
            slots = _slots(canon, start, kinds, numbers, size) if template else []
            out.append((int(text[start]), h, start - int(bounds[text[start]]), slots))
    return totals, out


def _slots(canon: Canon, start: int, kinds: np.ndarray, numbers: np.ndarray, size: int) -> list[dict]:
    held = np.flatnonzero(kinds[start : start + size])
    fillers = canon.spelling(numbers[start + held])
    return [{"kind": int(kinds[start + k]), "at": k, "filler": w.lower()} for k, w in zip(held.tolist(), fillers, strict=True)]


_SLOTS = pa.list_(pa.struct([("kind", pa.int32()), ("at", pa.int32()), ("filler", pa.string())]))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    names, types = [*names, "hash", "place", "slots"], [*types, pa.int64(), pa.int32(), _SLOTS]
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _mark(text: str) -> Column:
    """Tells apart the texts of rows with one identifier, or none."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark")


def item_windows(items: DataFrame, id: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(item, item_mark, total, hash, place, slots)``: the windows of each item, as plain words and as templates."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            totals, found = _rows(canon, [t or "" for t in batch.column(1).to_pylist()], words)
            marks = batch.column(2).to_pylist()
            rows = [(ids[k], marks[k], int(totals[k]), *window) for k, *window in found]
            yield _batch(rows, ["item", "item_mark", "total"], [pa.int64(), pa.int64(), pa.int32()])

    source = items.select(F.col(id).cast("bigint").alias("item"), F.col(text).alias("text"), _mark(text))
    return source.mapInArrow(cut, f"item bigint, item_mark bigint, total int, {WINDOW}")


def _filter(windows: DataFrame) -> np.ndarray:
    """Which leading bits the hashes have, as a bit map of ``2 ** FILTER_BITS`` bits that Spark puts together."""
    lead = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = windows.groupBy(F.shiftrightunsigned(lead, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(hash, %d), 64) as int))" % (64 - FILTER_BITS))).alias("bits")
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in bits.collect():
        out[row["word"]] = row["bits"]
    return out


def document_windows(docs: DataFrame, wanted: np.ndarray, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc, mark, hash, place, slots)``: windows of the documents that the filter ``wanted`` lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        allow = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").view(bool)
        for batch in batches:
            ids, marks, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for block in blocks((t.as_py() for t in batch.column(1)), BLOCK_CHARS):
                rows = [(ids[at + k], marks[at + k], *window) for k, *window in _rows(canon, block, words, allow)[1]]
                at += len(block)
                if rows:
                    yield _batch(rows, ["doc", "mark"], [pa.int64(), pa.int64()])

    source = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"), _mark(text))
    return source.mapInArrow(cut, f"doc bigint, mark bigint, {WINDOW}")


def text_hits(
    docs: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    words: int = WORDS,
    id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """One row per text and item text it holds: ``(doc, mark, item, matched, total, coverage, replaced)``."""
    windows = item_windows(items, item_id, text, words).distinct()
    mine = windows.select("item", "item_mark", "total", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = document_windows(docs, _filter(windows), id, text, words).join(mine, "hash")
    fillers = F.zip_with(
        "item_slots",
        "slots",
        lambda a, b: F.struct(a["kind"].alias("kind"), a["filler"].alias("old"), b["filler"].alias("new")),
    )
    # written once: alignments are judged and then counted, and the texts are to be cut into windows for both together
    path = scratch_path(docs.sparkSession, "aligned")
    met.select(
        "doc", "mark", "item", "item_mark", "total", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), fillers.alias("fillers")
    ).write.parquet(path)
    aligned = docs.sparkSession.read.parquet(path)
    along = ["doc", "mark", "item", "item_mark", "shift"]
    swaps = aligned.select(*along, F.explode("fillers").alias("f")).select(*along, "f.*").distinct()
    by_old = swaps.groupBy(*along, "kind", "old").agg(
        F.count("*").alias("n"), F.max((F.col("old") != F.col("new")).cast("int")).alias("other")
    )
    judged = by_old.groupBy(*along).agg((F.max("n") == 1).alias("consistent"), F.sum("other").alias("replaced"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"j.{c}")) for c in along]
    told = aligned.alias("a").join(judged.alias("j"), same, "left").where(
        (F.size("fillers") == 0) | F.coalesce("consistent", F.lit(False))
    )
    replaced = F.when(F.size("fillers") > 0, F.col("replaced")).otherwise(F.lit(0))
    places = (
        told.select("a.doc", "a.mark", "a.item", "a.item_mark", "total", "item_place", replaced.alias("replaced"))
        .groupBy("doc", "mark", "item", "item_mark", "total", "item_place")
        .agg(F.min("replaced").alias("replaced"))
    )
    found = places.groupBy("doc", "mark", "item", "item_mark", "total").agg(F.count("*").alias("matched"), F.max("replaced").alias("replaced"))
    return (
        found.withColumn("coverage", F.col("matched") / F.col("total"))
        .where(F.col("coverage") >= share)
        .select("doc", "mark", "item", "matched", F.col("total").cast("bigint").alias("total"), "coverage", "replaced")
    )


def benchmark_hits(docs: DataFrame, items: DataFrame, id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """One row per document and item it holds: ``(id, item_id, matched, total, coverage, replaced)``. ``replaced`` is
    the number of different fillers that took another one's place. Of texts that share an identifier, and of items that
    do, the best covered one tells."""
    best = F.max(F.struct("coverage", "matched", "total", "replaced")).alias("best")
    hits = text_hits(docs, items, id=id, item_id=item_id, **options).groupBy("doc", "item").agg(best)
    columns = ("matched", "total", "coverage", "replaced")
    return hits.select(F.col("doc").alias(id), F.col("item").alias(item_id), *(F.col("best")[c].alias(c) for c in columns))


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose text holds no item, as they came in."""
    hits = text_hits(docs, items, id=id, text=text, **options).select(F.col("doc").alias("hit"), F.col("mark").alias("hit_mark")).distinct()
    here = docs[id].cast("bigint").eqNullSafe(hits["hit"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == hits["hit_mark"])
    return docs.join(hits, here, "left_anti")
