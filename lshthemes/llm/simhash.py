"""Near duplicates by SimHash, linked exactly through vantage-point trees.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Distinct fingerprints are dealt to shards
by a vantage-point tree: each inner node parts its fingerprints by their Hamming distance to a vantage point, and by the
triangle inequality a fingerprint at distance ``d`` can only link into the near half if ``d - radius`` is within the
bound, and into the far half if ``d + radius`` is beyond it. The tree over shards is built from a bounded sample of
fingerprints (``SAMPLE``); every fingerprint goes to its own shard and is asked in each shard that the bounds leave
open, so no link is lost. Within a shard the same goes on in memory. Shards with many fingerprints are cut into
blocks of askers and blocks of points. Instead of all pairs a shard reports, for each asker, a spanning set of links.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, and such texts link like any others.
Fewer words than a shingle has form one shingle. Rows with a null identifier belong to their group but never name it
unless no other row can. Repeated rows have equal fingerprints and share a group. No rows in, no rows out. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lshthemes.llm.components import SALTS, components
from lshthemes.sources.scratch import scratch_path

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints from which the tree over shards is built, at most.
SAMPLE = 20_000
#: Shards grow with the root of the fingerprints, so that neither their number (and with it how often a fingerprint is
#: asked) nor their size grows in full proportion: this many fingerprints' root makes one shard.
SHARD_ROOT = 16
MOST_SHARDS = 4_096
#: Askers and points of one task's block.
ASK_BLOCK = 65_536
OWN_BLOCK = 65_536
#: Links held before they are reduced to a spanning set.
HELD_LINKS = 500_000
#: Share of comparisons that a split may leave.
WORTH = 0.95
#: Below this many points a node is compared as a whole.
LEAF = 48
#: Shingles of a text that are counted at a time.
STEP = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not tokens:
        return 0
    count = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, STEP):
        size = min(STEP, count - at)
        part = tokens[at : at + size + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > count, bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(words: int = WORDS, seed: int = SEED) -> Callable:
    """A function from a text column to its fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = [fingerprint(t.as_py() or "", words, seed) for t in batch]
            yield pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return of.asNondeterministic()


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a bound, of some that are tried on some of the points: those that leave the smallest share of
    comparisons, with askers near the bound going both ways. None where no split saves anything to speak of."""
    tried = points[:: max(1, len(points) // 16)][:16]
    some = points[:: max(1, len(points) // 512)]
    distances = _distance(tried[:, None], some[None, :])
    counts = np.zeros((len(tried), 65 + 2 * radius))
    np.add.at(counts, (np.arange(len(tried))[:, None], distances.astype(np.int64) + radius), 1)
    within = np.cumsum(counts, axis=1) / len(some)  # share at a distance of at most (column - radius)
    near, reached, missed = within[:, radius : radius + 64], within[:, 2 * radius : 2 * radius + 64], within[:, :64]
    cost = reached * near + (1 - missed) * (1 - near)
    best = np.unravel_index(int(np.argmin(cost)), cost.shape)
    return (tried[best[0]], int(best[1])) if cost[best] < WORTH else None


class Tree:
    """Vantage points over shards: node ``k`` has a point, a bound and two children, shards are negative."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int) -> None:
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.shards, self.radius = 0, radius
        self.leaf = max(1, len(sample) // max(1, shards))
        self.root = self._grow(sample)

    def _grow(self, points: np.ndarray) -> int:
        split = choose_split(points, self.radius) if len(points) > self.leaf else None
        if split is None:
            self.shards += 1
            return -self.shards
        vantage, bound = split
        near = _distance(points, vantage) <= bound
        at = len(self.nodes)
        self.nodes.append((vantage, bound, 0, 0))
        left, right = self._grow(points[near]), self._grow(points[~near])
        self.nodes[at] = (vantage, bound, left, right)
        return at

    def places(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, shard, owner)``: every shard that a point must be asked in, and whether the shard is its own."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            node, rows, own = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -node - 1, own))
                continue
            vantage, bound, left, right = self.nodes[node]
            d = _distance(points[rows], vantage).astype(np.int16)
            for child, take, mine in (
                (left, d - self.radius <= bound, d <= bound),
                (right, d + self.radius > bound, d > bound),
            ):
                todo.append((child, rows[take], own[take] & mine[take]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        return (
            np.concatenate([r for r, _, _ in out]),
            np.concatenate([np.full(len(r), s, np.int32) for r, s, _ in out]),
            np.concatenate([o for _, _, o in out]),
        )


def near_links(askers: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within ``radius`` between askers and points connect: one for each node at most,
    to the smallest of its component. Never holds the pairs of a dense group."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    todo = [(points, askers)]
    while todo:
        own, ask = todo.pop()
        if not len(own) or not len(ask):
            continue
        split = choose_split(own, radius) if len(own) > LEAF else None
        if split:
            vantage, bound = split
            near = _distance(own, vantage) <= bound
            e = _distance(ask, vantage).astype(np.int16)
            todo.append((own[near], ask[e - radius <= bound]))
            todo.append((own[~near], ask[e + radius > bound]))
            continue
        for at in range(0, len(ask), 4096):
            part = ask[at : at + 4096]
            for first in range(0, len(own), LEAF):
                some = own[first : first + LEAF]
                close = np.bitwise_count(part[:, None] ^ some[None, :]) <= radius
                close &= part[:, None] != some[None, :]
                a, b = np.nonzero(close)
                if len(a):
                    found.append((part[a], some[b]))
                    held += len(a)
                if held > HELD_LINKS:
                    found = [_stars(found)]
                    held = len(found[0][0])
    return _stars(found)


def _stars(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of the given ones: every node to the smallest of its component."""
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        np.minimum.at(fresh, label[left], low)
        np.minimum.at(fresh, label[right], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def link_fingerprints(
    prints: DataFrame,
    radius: int = RADIUS,
    sample: int = SAMPLE,
    shard_root: int = SHARD_ROOT,
    ask_block: int = ASK_BLOCK,
    own_block: int = OWN_BLOCK,
) -> DataFrame:
    """Links ``(a, b)`` that connect what all links within ``radius`` connect, of distinct ``prints(fp)``."""
    spark = prints.sparkSession
    total = prints.count()
    share = min(1.0, sample / max(1, total))
    picked = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample)
    some = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64)).view(np.uint64)
    tree = Tree(some, min(MOST_SHARDS, math.ceil(math.sqrt(total) / shard_root)), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, shard, own = tree.places(fps.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "fp": pa.array(fps[rows]), "own": pa.array(own)})

    path = scratch_path(spark, "shards")
    prints.mapInArrow(deal, "shard int, fp bigint, own boolean").write.parquet(path)
    dealt = spark.read.parquet(path)
    # at most MOST_SHARDS rows: how many blocks of askers and of points each shard has
    sizes = dealt.groupBy("shard").agg(
        F.ceil(F.count("*") / ask_block).cast("int").alias("asks"),
        F.ceil(F.sum(F.col("own").cast("int")) / own_block).cast("int").alias("owns"),
    )
    placed = dealt.join(F.broadcast(sizes), "shard")
    slot = F.xxhash64("fp", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    asks = placed.select("shard", "fp", F.lit(False).alias("own"), F.pmod(slot, F.col("asks")).cast("int").alias("x"), every("owns").alias("y"))
    owns = placed.where("own").select("shard", "fp", "own", every("asks").alias("x"), F.pmod(slot, F.col("owns")).cast("int").alias("y"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        own = rows["own"].to_numpy(dtype=bool)
        a, b = near_links(fps[~own], fps[own], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return asks.unionByName(owns).groupBy("shard", "x", "y").applyInPandas(link, "a bigint, b bigint")



def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``(id, fp, component_id, mark, stays)``. ``component_id`` is the smallest identifier of the
    group, and the row with it stays; ``mark`` is a hash of the text, which tells rows of one identifier apart."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    docs.select(
        F.col(id).alias("id"), F.xxhash64(text).alias("mark"), fingerprints(words)(text).alias("fp")
    ).write.parquet(path)
    who = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    marked = spark.read.parquet(path).withColumn("who", who)
    first = marked.groupBy("fp").agg(F.min("who").alias("least"))
    linked = components(link_fingerprints(first.select("fp"), radius))
    named = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("head"))
    # a group that most rows share is looked up under salted keys, twice: by label, then by fingerprint
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")
    of_print = (
        named.select("fp", "label", salt("fp").alias("salt"))
        .join(least.select("*", salts), ["label", "salt"])
        .select("fp", "head")
    )
    return (
        marked.withColumn("salt", salt("id", "mark"))
        .join(of_print.select("*", salts), ["fp", "salt"])
        .select(
            F.col("id").alias(id), "fp", F.col("head")["id"].alias("component_id"), "mark", (F.col("who") == F.col("head")).alias("stays")
        )
    )


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The row that stays of each group, as it came in; rows repeated in full stay or go together.

    Only those that go are looked up, by identifier and a hash of the text."""
    path = scratch_path(docs.sparkSession, "near-groups")
    near_groups(docs, id, text, words, radius).where("NOT stays").select(
        F.col(id).alias("gone_id"), F.col("mark").alias("gone_mark")
    ).distinct().write.parquet(path)
    gone = docs.sparkSession.read.parquet(path)
    here = docs[id].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text]) == gone["gone_mark"])
    return docs.join(gone, here, "left_anti")
