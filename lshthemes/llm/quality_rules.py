"""Quality rules: plain counts of each text, and a logistic regression over hashed word and character n-grams.

Counts decide first: texts of fewer than ``MIN_WORDS`` words, or of which more than ``MOST_REPEATED_PCT`` in a hundred words
stand in three-word windows that the text has twice, have failed. The others are judged by a model of what labelled texts of
good and bad quality are made of: words, pairs of neighbouring words, and runs of ``CHAR_GRAMS`` characters of words with
their ends, hashed to ``BUCKETS`` features, each the mean number per word. Training rows that fail the counts teach
nothing. The regression is fitted by L-BFGS; its margins on rows it hasn't seen (``FOLDS`` parts) are calibrated to
probabilities (Platt, 1999), and a text is kept from ``KEPT_FROM`` on.

Training uses at most ``TRAIN_ROWS`` labelled rows, by a hash of the identifier; tasks count their features, so what comes to
the driver is bounded by rows and features whatever the texts. Scoring goes over whole texts in Arrow batches; what a token
adds to the margin is remembered, bounded.

Words are what stands between blanks and the characters from tab to carriage return; case and marks count.

Edge cases: null and empty texts have no words and fail. Very long texts are held one at a time, very long words aren't
remembered. With labels of one kind only, or none, every text that passes the counts is kept, with a probability of 1 or, if
all labels are bad, dropped with 0. Null labels and identifiers teach nothing. Repeated rows get the same verdict. An empty
table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.llm.bpe import blocks

MIN_WORDS = 50
MOST_REPEATED_PCT = 50
KEPT_FROM = 0.5
TRAIN_ROWS = 3_000
BUCKETS = 1 << 13
CHAR_GRAMS = (3, 4)
FOLDS = 3
#: Weight of the squared weights against the mean loss.
PENALTY = 1e-5
#: Remembered tokens of one Python worker; forgetting them changes no result.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 64
BLOCK_CHARS = 1_000_000
# Separators of words, and what counts as a symbol.
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCORED = ", ".join(f"{c}: bigint" for c in _STATS) + ", base_failed: boolean, probability: double"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _repeated(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    numbers = _Numbers()
    at = np.array(list(map(numbers.__getitem__, words)), dtype=np.int64)
    pair = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(numbers) + at[2:], return_inverse=True, return_counts=True)
    often = count[window] > 1
    covered = np.zeros(len(at), dtype=bool)
    for k in range(3):
        covered[k : len(often) + k] |= often
    return int(covered.sum())


def text_stats(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """``_STATS`` of a text in UTF-8 and its words."""
    letters = data.translate(None, _BLANKS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(letters.decode()),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
    )


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MOST_REPEATED_PCT * n_words


def token_buckets(word: bytes) -> np.ndarray:
    """Features of a word: itself and its character n-grams."""
    if word.isascii():
        marked = b"<" + word + b">"
        grams = [marked[k : k + n] for n in CHAR_GRAMS for k in range(len(marked) - n + 1)]
    else:
        letters = f"<{word.decode()}>"
        grams = [letters[k : k + n].encode() for n in CHAR_GRAMS for k in range(len(letters) - n + 1)]
    return np.array([zlib.crc32(b"word " + word), *map(zlib.crc32, grams)], dtype=np.int64) % BUCKETS


def _pair_buckets(numbers: np.ndarray) -> np.ndarray:
    """Features of neighbouring words, from the checksums of the words."""
    mixed = numbers[:-1] * np.uint64(0x9E3779B97F4A7C15) + numbers[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _checksums(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def features(words: list[bytes]) -> np.ndarray:
    """Mean number of each feature per word."""
    counts = np.bincount(_pair_buckets(_checksums(words)), minlength=BUCKETS).astype(np.float64)
    seen = _Numbers()
    place = np.array(list(map(seen.__getitem__, words)), dtype=np.int64)
    for word, n in zip(seen, np.bincount(place), strict=True):
        np.add.at(counts, token_buckets(word), n)
    return (counts / len(words)).astype(np.float32)


@dataclass
class Model:
    """``probability = 1 / (1 + exp(-(slope * (mean weight + bias) + shift)))``."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 50.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


class Scorer:
    def __init__(self, model: Model, limit: int = REMEMBERED) -> None:
        self.model, self.limit = model, limit
        self.weights = model.weights.astype(np.float64)
        self.known: dict[bytes, float] = {}

    def _weight(self, word: bytes) -> float:
        return float(self.weights[token_buckets(word)].sum())

    def margin(self, words: list[bytes]) -> float:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        long = {}
        for word in set(words).difference(known):
            (known if len(word) <= LONGEST_REMEMBERED else long)[word] = self._weight(word)
        get = {**known, **long}.__getitem__ if long else known.__getitem__
        total = sum(map(get, words)) + self.weights[_pair_buckets(_checksums(words))].sum()
        return float(total) / len(words) + self.model.bias


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss with penalty and its gradient; the last weight is the bias and goes free."""
    margin = (x @ w[:-1].astype(np.float32)).astype(np.float64) + w[-1]
    loss = np.logaddexp(0, -y * margin).mean() + 0.5 * PENALTY * (w[:-1] @ w[:-1])
    pull = -y / (1 + np.exp(np.clip(y * margin, -50, 50))) / len(y)
    return float(loss), np.append((pull.astype(np.float32) @ x).astype(np.float64) + PENALTY * w[:-1], pull.sum())


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """Weights and bias by L-BFGS with backtracking; ``y`` is 1 or -1."""
    w = np.zeros(x.shape[1] + 1)
    value, slope = _loss(x, y, w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        move, used = slope.copy(), []
        for s, g in reversed(past):
            a = (s @ move) / (s @ g)
            move -= a * g
            used.append(a)
        if past:
            s, g = past[-1]
            move *= (s @ g) / (g @ g)
        else:
            move /= max(np.abs(slope).max(), 1e-12)
        for (s, g), a in zip(past, reversed(used), strict=True):
            move += s * (a - (g @ move) / (s @ g))
        step = 1.0
        while True:
            fresh = w - step * move
            new_value, new_slope = _loss(x, y, fresh)
            if new_value <= value - 1e-4 * step * (slope @ move) or step < 1e-8:
                break
            step /= 2
        s, g = fresh - w, new_slope - slope
        if s @ g > 1e-12:
            past = [*past, (s, g)][-memory:]
        done = abs(value - new_value) < 1e-7
        w, value, slope = fresh, new_value, new_slope
        if done:
            break
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of good quality, on smoothed labels, by Newton's method."""
    good = float((y > 0).sum())
    goal = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    at = np.array([1.0, 0.0])
    design = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        bend = design.T @ (design * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-9 * np.eye(2)
        move = np.linalg.solve(bend, design.T @ (p - goal))
        at -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(x: np.ndarray, good: np.ndarray) -> Model:
    """A model of rows of features and whether each is good."""
    y = np.where(good, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(shift=-50.0 if len(y) and not good.any() else 50.0)
    part = np.random.RandomState(5).permutation(len(y)) % FOLDS
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        learn = part != k
        w = fit(x[learn], y[learn])
        unseen[~learn] = x[~learn] @ w[:-1].astype(np.float32) + w[-1]
    w = fit(x, y)
    slope, shift = _calibrate(unseen, y)
    return Model(w[:-1].astype(np.float32), float(w[-1]), slope, shift)


def _feature_rows(text: str):
    @F.arrow_udf("binary")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for line in batch:
                data = (line.as_py() or "").encode()
                words = data.split()
                ok = not fails(len(words), _repeated(words))
                out.append(tool.compress(features(words).tobytes()) if ok else None)
            yield pa.array(out, pa.binary())

    return count.asNondeterministic()(text)


def train_on(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Model:
    """A model from at most ``train_rows`` labelled rows, by a hash of the identifier."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    # features are counted where the rows are, before the few that count are brought together
    found = rows.select("id", "label", F.xxhash64("text").alias("mark"), _feature_rows("text").alias("x"))
    first = found.orderBy("id", "label", "mark").limit(train_rows)
    counted = first.select((F.col("label") == 1).alias("good"), "x").where("x IS NOT NULL").collect()
    if not counted:
        return Model()
    tool = zstandard.ZstdDecompressor()
    x = np.stack([np.frombuffer(tool.decompress(r["x"]), dtype=np.float32) for r in counted])
    return train(x, np.array([r["good"] for r in counted]))


def judged(model: Model, text: str = "text") -> Column:
    """A struct of the counts of a text, whether it fails them, and the probability that its quality is good; that of a text
    that fails is null."""
    parts = (model.weights, model.bias, model.slope, model.shift)

    @F.arrow_udf(_SCORED.replace(":", ""))
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Model(*parts))
        for batch in batches:
            for block in blocks((t.as_py() for t in batch), BLOCK_CHARS):
                stats, failed, chance = [], [], []
                for line in block:
                    data = line.encode()
                    words = data.split()
                    stats.append(text_stats(data, words))
                    failed.append(fails(stats[-1][0], stats[-1][4]))
                    chance.append(None if failed[-1] else float(scorer.model.probability(np.float64(scorer.margin(words)))))
                columns = [pa.array(c, pa.int64()) for c in zip(*stats, strict=True)]
                columns += [pa.array(failed, pa.bool_()), pa.array(chance, pa.float64())]
                yield pa.StructArray.from_arrays(columns, [*_STATS, "base_failed", "probability"])

    return judge.asNondeterministic()(text)


def quality_rules(docs: DataFrame, model: Model, kept_from: float = KEPT_FROM, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, counts, base_failed, probability, kept)`` of every row."""
    rows = docs.select(F.col(id).alias("_id"), judged(model, text).alias("_q"))
    kept = F.coalesce(F.col("_q.probability") >= kept_from, F.lit(False))
    return rows.select(F.col("_id").alias(id), *[F.col(f"_q.{c}").alias(c) for c in (*_STATS, "base_failed", "probability")], kept.alias("kept"))
