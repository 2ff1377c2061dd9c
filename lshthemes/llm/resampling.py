"""Importance resampling of raw text towards a target (Xie et al., 2023).

Two bags of hashed n-grams (words and pairs of words) are counted: one over the target's documents, one over all. The
weight of a document is the ratio of its probabilities under the two smoothed models, taken per n-gram so that a long
text is not decided by its length, and sharpened by ``SHARPNESS``. Adding Gumbel noise to the logarithms of the weights
and keeping the ``k`` largest draws ``k`` documents without replacement, in proportion to the weights. The noise is a
hash of identifier and seed, so a run can be repeated.

The k-th largest key is found by counting keys in bins and narrowing the bin that holds it; only counts of ``BINS`` bins
reach the driver. Ties at the last key are settled by the identifier within that last bin.

Edge cases: a null or empty text has no n-grams and the weight of a text that is as likely under both models (log weight
0). Null identifiers take part as one more identifier; repeated rows are drawn as one, so they may exceed ``k`` by their
repeats. Without target documents both models are uniform in what they add, and all weights come from the raw text
alone. Texts of any length are weighed whole, one at a time. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lshthemes.llm.bpe import blocks
from lshthemes.llm.packing import packed
from lshthemes.sources.scratch import scratch_path

BUCKETS = 10_000
SMOOTHING = 1.0
SHARPNESS = 50.0
SEED = 17
BINS = 4_096
#: Keys that are ranked once the bin is this small; narrowing stops earlier if it can't part them.
RANKED = 10_000
REMEMBERED = 400_000
BLOCK_CHARS = 1_000_000
_WORDS = re.compile(r"\w+|[^\w\s]")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Buckets of the n-grams of texts. Word hashes are remembered; forgetting them changes nothing."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = np.uint64(buckets), {}

    def of(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text.lower())
        if not words:
            return np.empty(0, dtype=np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        pairs = (h[:-1] * _PAIR) ^ (h[1:] + _PAIR)
        pairs ^= pairs >> np.uint64(29)
        return np.concatenate([h % self.buckets, (pairs * _PAIR >> np.uint64(7)) % self.buckets]).astype(np.int64)


def gram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target)`` over ``texts(packed, target boolean)``: counts of one pass, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, tool = Grams(buckets), np.zeros((2, buckets), dtype=np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(grams.of(tool.decompress(text.as_py()).decode()), minlength=buckets)
                total[0] += found
                if target:
                    total[1] += found
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "raw": total[0][used], "target": total[1][used]})

    parts = texts.select("packed", "target").mapInArrow(count, "bucket int, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability for each bucket. At most ``buckets`` rows come to the driver."""
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for row in counts.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weight(ratios: np.ndarray, text: str, sharpness: float = SHARPNESS) -> Column:
    """The log weight of a text."""

    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(len(ratios))
        for batch in batches:
            out: list[float] = []
            for block in blocks((t.as_py() for t in batch), BLOCK_CHARS):
                for one in block:
                    found = grams.of(one)
                    out.append(float(ratios[found].mean()) * sharpness if len(found) else 0.0)
            yield pa.array(out, pa.float64())

    return weigh.asNondeterministic()(text)


def gumbel(id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise by a hash: the hash's upper 52 bits are a number between 0 and 1, ends left out."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id.cast("string"), F.lit("null"))), 12)
    return -F.log(-F.log((hashed.cast("double") + 0.5) / float(1 << 52)))


def mark_top(rows: DataFrame, k: int, key: str = "key", id: str = "id") -> DataFrame:
    """``rows`` with ``selected``: the ``k`` rows with the largest finite ``key``. ``rows`` should be a stored table."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return rows.withColumn("selected", F.lit(False))
    rest, last = k, low
    while True:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        bin = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)).cast("int")
        counts = rows.where(F.col(key).between(low, high)).groupBy(bin.alias("bin")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        ).collect()
        for found in sorted(counts, key=lambda r: -r["bin"]):
            if found["n"] >= rest:
                break
            rest -= found["n"]
        else:
            return rows.withColumn("selected", F.lit(True))
        narrowed = (found["low"], found["high"])
        if found["n"] <= RANKED or narrowed == (low, high):
            low, high = narrowed
            break
        low, high = narrowed
    at = F.col(key).between(low, high)
    # what is left is small, or equal keys that repeated rows share
    edge = rows.where(at).select(id, key).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.desc(key), F.asc_nulls_last(id))))
    taken = edge.where(F.col("place") <= rest).select(F.col(id).alias("edge_id"), F.col(key).alias("edge_key"), F.lit(True).alias("taken"))
    same = rows[id].eqNullSafe(taken["edge_id"]) & (rows[key] == taken["edge_key"])
    return rows.join(taken, same, "left").select(
        rows["*"], ((F.col(key) > high) | F.coalesce("taken", F.lit(False))).alias("selected")
    )


def resample(docs: DataFrame, target: DataFrame, share: float | None = None, id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: ``(id, log_weight, key, selected)``. ``target(id, is_target)`` marks documents of the
    target; rows of null or of documents that are not there do not matter. ``share`` of the rows are drawn; by default
    the share that the target has among the marked ones."""
    spark = docs.sparkSession
    marks = target.select(F.col(id).alias("id"), F.col("is_target").alias("target")).where("id IS NOT NULL AND target IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("target").alias("target"))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # a merge join whatever the tables' sizes: marks may be as many as documents, and what is shuffled are packed texts
    marked = texts.select("id", packed("text").alias("packed")).join(marks.hint("merge"), "id", "left")
    marked = marked.select("packed", F.coalesce("target", F.lit(False)).alias("target"))
    ratios = log_ratios(gram_counts(marked))
    if share is None:
        share = marks.agg(F.avg(F.col("target").cast("double"))).first()[0] or 0.0
    path = scratch_path(spark, "weights")
    weighed = texts.select("id", log_weight(ratios, "text").alias("log_weight"))
    weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("id"), seed)).write.parquet(path)
    rows = spark.read.parquet(path)
    return mark_top(rows, round(share * rows.count())).withColumnRenamed("id", id)
