"""Toxicity by a support vector machine over a gapped subsequence kernel, with Nyström landmarks.

The kernel of two strings counts their common subsequences of ``ORDER`` letters, each weighted by ``DECAY`` to the
letters it spans in both (Lodhi et al., 2002), normalised to 1 for equal strings. Inserted or dropped letters only add to
the span, so a disguised insult stays close to the plain one. Kernel values with a few landmark strings, whitened
(Nyström), are the features of a linear support vector machine.

Labels mark whole documents while an insult is a word or two, so documents are bags of units: words between word ends,
words with marks inside joined up, and single letters in a row joined up. The machine is trained as for multiple instances
(Andrews et al., 2003): of a toxic document its worst units count, if they are rarer in clean ones, of a clean one all; rounds
settle which are the worst, and clean units that score high become training rows and landmarks of the next round. A
document scores by its ``WORST`` highest margins, as a probability that is fitted to margins of texts unseen in training
(Platt, 1999): one clear insult is enough, and of weaker ones it takes several, since a clean text may well have one.

Training reads a sample of labelled documents of at most ``TRAIN_ROWS`` rows, by a hash of the identifier. Scoring reads
every text whole.

Edge cases: null and empty texts have no unit and score as one without anything in common with a landmark. Very long
words are scored in overlapping parts. Without both labels in the sample, nothing can be learnt: every score is 0 then.
Labels of null are not used. Rows that repeat score alike. Other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.llm.bpe import blocks

ORDER = 3
DECAY = 0.5
#: Labelled rows from which the machine is trained, at most.
TRAIN_ROWS = 4_000
LANDMARKS = 100
#: Lengths of the word parts among which landmarks are looked for.
STEM_LETTERS = (4, 5, 6)
#: Units longer than this are scored in overlapping parts.
LONGEST = 22
THRESHOLD = 0.7
#: Remembered tokens of one Python worker; forgetting them changes no result.
REMEMBERED = 400_000
ROUNDS = 4
#: Units of a toxic document that are taken for what makes it toxic, and how much rarer than there they must be in clean ones.
WITNESSES, RARER = 2, 4
#: They must tell half as much as the document's most telling one.
AS_TELLING = 0.5
#: Units by whose margins a document is judged, and how far a margin counts.
WORST, FAR = 3, 4.0
#: Cost of a row on the wrong side of the machine's margin.
COST = 30.0
#: Units among which new landmarks are looked for at a time.
LOOKED_AT = 600
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters that only ever stand for these in disguised words.
_STAND_INS = str.maketrans("013457@$", "oieastas")


def _split(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[k : k + LONGEST] for k in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def token_units(token: str) -> set[str]:
    """Units of what stands between blanks, in lower case already."""
    runs = _LETTERS.findall(token)
    if len(runs) == 1 and len(runs[0]) == len(token):
        return set(_split(token))
    out = {part for run in runs for part in _split(run)}
    plain = token.strip(".,;:!?\"'()[]{}|#%&*")
    joined = "".join(_LETTERS.findall(plain.translate(_STAND_INS)))
    if joined:
        out.update(_split(joined))
    return out


def spelled(tokens: list[str]) -> set[str]:
    """Units spelled out letter by letter, as in ``i d i o t``."""
    out, run = set(), []
    for token in [*tokens, "--"]:
        letters = token if len(token) == 1 else token.strip(".,;:!?-_*")
        if len(letters) == 1 and letters.isalpha():
            run.append(letters)
            continue
        if len(run) > 2:
            out.update(_split("".join(run)))
        run = []
    return out


def _by_length(strings: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and character codes of strings with equal numbers of letters, word ends included."""
    places: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        places.setdefault(len(s), []).append(k)
    for long, at in places.items():
        for first in range(0, len(at), most):
            part = np.array(at[first : first + most])
            text = "".join(f"^{strings[k]}$" for k in part)
            yield part, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(part), long + 2)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each string with itself: sums over both strings' places, one letter at a time."""
    long = codes.shape[1]
    gap = np.arange(long)[:, None] - np.arange(long)[None, :] - 1
    hand_on = np.where(gap >= 0, np.power(DECAY, np.maximum(gap, 0)), 0).astype(np.float32)
    step = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(DECAY * DECAY)
    out = step
    for _ in range(ORDER - 1):
        out = step * (hand_on @ out @ hand_on.T)
    return np.sqrt(out.sum(axis=(1, 2)))


class Features:
    """Kernel values with given strings, through the letter triples that occur in them: the kernel is the inner product
    of the weighted counts of triples, so a table over those triples gives all values of a string in one walk over its
    own triples, and one weight for each string folds the table to a single column."""

    def __init__(self, landmarks: list[str], weights: np.ndarray | None = None) -> None:
        letters = sorted({ord(c) for s in landmarks for c in f"^{s}$"})
        self.letters = np.array(letters, dtype=np.uint32)
        self.size = len(letters) + 1
        table = np.zeros((self.size**ORDER, len(landmarks)), dtype=np.float32)
        for k, codes in _by_length(landmarks):
            norm = _norms(codes)
            for weight, triple in self._walk(codes):
                np.add.at(table, (triple, k), weight / norm)
        self.table = table if weights is None else table @ weights.astype(np.float32)[:, None]

    def _walk(self, codes: np.ndarray) -> Iterator[tuple[np.float32, np.ndarray]]:
        place = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(place, len(self.letters) - 1)] == codes
        at = np.where(known, place + 1, 0)
        for picks in combinations(range(codes.shape[1]), ORDER):
            triple = at[:, picks[0]]
            for p in picks[1:]:
                triple = triple * self.size + at[:, p]
            yield np.float32(DECAY ** (picks[-1] - picks[0] + 1)), triple

    def of(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.table.shape[1]), dtype=np.float32)
        for k, codes in _by_length(units):
            total = np.zeros((len(k), self.table.shape[1]), dtype=np.float32)
            for weight, triple in self._walk(codes):
                total += weight * self.table[triple]
            out[k] = total / np.maximum(_norms(codes), np.float32(1e-6))[:, None]
        return out


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """``(units, landmarks)``, each between 0 and 1."""
    return Features(landmarks).of(units)


@dataclass
class Machine:
    """``margin = kernel(unit, landmarks) @ weights + bias``, and the probability of a document from the margins of its
    worst units: ``slopes @ margins + shift``. Where a document has fewer units, ``usual`` margins of clean ones stand in."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -1.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(WORST))
    shift: float = -50.0
    usual: np.ndarray = field(default_factory=lambda: np.full(WORST, -1.0))

    def __post_init__(self) -> None:
        self.folded = Features(self.landmarks, self.weights) if self.landmarks else None

    def margins(self, units: list[str]) -> np.ndarray:
        if not units or not self.folded:
            return np.full(len(units), self.bias)
        return self.folded.of(units)[:, 0] + self.bias

    def worst(self, margins: Iterable[float]) -> list[float]:
        """The highest different margins of a document; units of one margin are as good as always the same one."""
        top = heapq.nlargest(WORST, set(margins))
        return [min(max(m, -FAR), FAR) for m in [*top, *self.usual[len(top) :].tolist()]]

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of rows of ``worst`` margins."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.slopes + self.shift, -50, 50)))


def document_units(text: str) -> set[str]:
    tokens = text.lower().split()
    return set().union(*map(token_units, set(tokens)), spelled(tokens))


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 40) -> np.ndarray:
    """Linear machine by dual coordinate descent (Hsieh et al., 2008); the last feature is the constant."""
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    square = np.maximum((x * x).sum(axis=1), 1e-12)
    order = np.random.RandomState(7)
    for _ in range(epochs):
        moved = 0.0
        for k in order.permutation(len(x)):
            slack = y[k] * (x[k] @ w) - 1
            fresh = min(max(a[k] - slack / square[k], 0.0), cost[k])
            if fresh != a[k]:
                moved = max(moved, abs(fresh - a[k]))
                w += (fresh - a[k]) * y[k] * x[k]
                a[k] = fresh
        if moved < 1e-3:
            break
    return w


def _fit_probability(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and shift by Newton steps on smoothed labels (Platt, 1999, for several margins)."""
    ones = label.sum()
    goal = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    used = list(range(margin.shape[1]))
    while True:
        design = np.column_stack([margin[:, used], np.ones(len(margin))])
        at = np.zeros(design.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
            bend = design.T @ (design * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-3 * np.eye(len(at))
            move = np.linalg.solve(bend, design.T @ (p - goal) + 1e-3 * at)
            at -= np.clip(move, -5, 5)
            if np.abs(move).max() < 1e-9:
                break
        falling = [k for k, slope in zip(used, at, strict=False) if slope < 0]
        if not falling:
            slopes = np.zeros(margin.shape[1])
            slopes[used] = at[:-1]
            return slopes, float(at[-1])
        used = [k for k in used if k not in falling]


def _stems(unit: str) -> set[str]:
    """Beginnings and other parts of a unit; the word's ends count as letters."""
    marked = f"^{unit}$"
    return {marked[k : k + n] for n in STEM_LETTERS for k in range(len(marked) - n + 1)}


def _telling_stems(bags: list[list[str]], toxic: np.ndarray, good: Counter, most: int) -> tuple[list[str], dict[str, float]]:
    """Parts of words by which toxic documents differ: one after the other, each telling of documents that those before
    leave. Also how much each part seen in several toxic documents tells."""
    of_bag = [set().union(*map(_stems, bag)) if bag else set() for bag, x in zip(bags, toxic, strict=True) if x]
    seen = Counter(s for own in of_bag for s in own)
    clean = Counter()
    for unit, n in good.items():
        for s in _stems(unit):
            if seen[s] > 1:
                clean[s] += n
    n_bad, n_good = len(of_bag), len(bags) - len(of_bag)
    odds = {s: math.log((n + 0.5) / (n_bad + 1) * (n_good + 1) / (clean[s] + 0.5)) for s, n in seen.items() if n > 1}
    best = sorted((s for s in odds if odds[s] > 1), key=lambda s: (-odds[s] * seen[s], s))[:4_000]
    kept = set(best)
    # of each toxic document: its units with their telling parts, and how often it is explained already
    left = [{u: own for u in bag if (own := _stems(u) & kept)} for bag, x in zip(bags, toxic, strict=True) if x]
    times = [0] * len(left)
    chosen: list[str] = []
    while len(chosen) < most:
        count: dict[str, float] = {}
        for units, k in zip(left, times, strict=True):
            for stem in set().union(*units.values()) if units else ():
                count[stem] = count.get(stem, 0.0) + 0.6**k
        if not count:
            break
        stem = max(count, key=lambda s: (odds[s] * count[s], len(s), s))
        if count[stem] < 0.5:
            break
        holders: Counter = Counter()
        for k, units in enumerate(left):
            gone = [u for u, own in units.items() if stem in own]
            holders.update(gone)
            for u in gone:
                del units[u]
            times[k] += bool(gone)
        # the word itself if one word has most of it, else what the words share
        word, n = max(holders.items(), key=lambda x: (x[1], x[0]))
        chosen.append(word if 2 * n >= sum(holders.values()) else stem.strip("^$"))
    # log-odds from few documents say little
    return list(dict.fromkeys(chosen)), {s: x * math.sqrt(min(seen[s], 16)) for s, x in odds.items()}


def _unlike(units: list[str], chosen: list[str], most: int, alike: float = 0.85) -> list[str]:
    """The first ``most`` of ``units`` that are like none of ``chosen`` and none before them."""
    units = [u for u in dict.fromkeys(units) if len(u) >= ORDER and u not in chosen][:LOOKED_AT]
    if not units or most <= 0:
        return []
    near = kernel(units, units)
    free = kernel(units, chosen).max(axis=1) < alike if chosen else np.ones(len(units), dtype=bool)
    out: list[int] = []
    for k in range(len(units)):
        if len(out) < most and free[k] and not (near[k, out] >= alike).any():
            out.append(k)
    return [units[k] for k in out]


def _machine(bags: list[list[str]], toxic: np.ndarray, landmarks: int, rounds: int) -> Machine:
    """A machine without its probability."""
    bad, good = Counter(), Counter()
    for bag, x in zip(bags, toxic, strict=True):
        (bad if x else good).update(bag)
    n_bad, n_good = int(toxic.sum()), int(len(toxic) - toxic.sum())
    stems, odds = _telling_stems(bags, toxic, good, landmarks // 4)
    tell = lambda u: (max((odds.get(s, 0.0) for s in _stems(u)), default=0.0), u)
    # what is as usual in clean documents can't be what makes one toxic
    suspects = [
        sorted((u for u in bag if bad[u] * n_good > RARER * good[u] * n_bad), key=tell, reverse=True)
        for bag, x in zip(bags, toxic, strict=True)
        if x
    ]
    suspects = [[u for u in bag if tell(u)[0] >= AS_TELLING * tell(bag[0])[0]] for bag in suspects]
    worst = [u for bag in suspects for u in bag[:WITNESSES]]
    common = [u for u, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if len(u) >= ORDER]
    chosen = stems + _unlike([u for u, _ in sorted(Counter(worst).items(), key=lambda x: (-x[1], x[0]))], stems, landmarks // 4)
    chosen += [u for u in common if u not in chosen][: landmarks // 10]
    pool = sorted(good)
    picks = np.random.RandomState(11).permutation(len(pool))[:3_000]
    negatives = {pool[k] for k in picks} | set(common[:3_000])
    machine = Machine()
    units = sorted(set(bad) | set(good))
    place = {u: k for k, u in enumerate(units)}
    clean_at = np.array([place[u] for u in pool], dtype=np.int64)
    for step in range(rounds):
        gram = kernel(chosen, chosen).astype(np.float64)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        keep = value > 1e-4
        white = vector[:, keep] / np.sqrt(value[keep])
        positives = Counter(worst)
        rows = [*positives, *sorted(negatives - positives.keys())]
        y = np.array([1.0] * len(positives) + [-1.0] * (len(rows) - len(positives)))
        seen = np.array([float(positives[u]) for u in rows[: len(positives)]])
        cost = COST * np.concatenate([np.sqrt(seen), np.full(len(rows) - len(positives), 1.0)])
        x = np.column_stack([kernel(rows, chosen) @ white, np.ones(len(rows))])
        w = _fit_svm(x, y, cost)
        machine = Machine(list(chosen), (white @ w[:-1]).astype(np.float32), float(w[-1]))
        margin = machine.margins(units)
        if step < rounds - 1:
            worst = [u for bag in suspects for u in sorted(bag, key=lambda u: (-margin[place[u]], u))[:WITNESSES]]
            hardest = [pool[k] for k in np.argsort(-margin[clean_at], kind="stable")[:2_000]]
            negatives |= set(hardest)
            chosen += _unlike(hardest, chosen, (landmarks - len(chosen)) // (rounds - 1 - step))
    of_clean = [machine.worst(margin[[place[u] for u in bag]].tolist()) for bag, x in zip(bags, toxic, strict=True) if not x and len(bag) >= WORST]
    if of_clean:
        machine.usual = np.median(np.array(of_clean), axis=0)
    return machine


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> Machine:
    """A machine from all texts. Its probability is fitted to margins of texts that the machine of the other half of them
    gave, as it will meet texts it hasn't seen."""
    toxic = np.array([1 if x else 0 for x in labels])
    if len(set(toxic.tolist())) < 2:
        return Machine()
    bags = [sorted(document_units(t)) for t in texts]
    machine = _machine(bags, toxic, landmarks, ROUNDS)
    half = np.random.RandomState(3).permutation(len(bags)) % 2
    both = all(len(set(toxic[half == k].tolist())) == 2 for k in range(2))
    worst = np.zeros((len(bags), WORST))
    for k in range(2):
        learn, told = np.flatnonzero(half != k).tolist(), np.flatnonzero(half == k).tolist()
        other = _machine([bags[i] for i in learn], toxic[learn], landmarks, ROUNDS - 1) if both else machine
        flat = sorted(set().union(*(bags[i] for i in told)))
        of = dict(zip(flat, other.margins(flat).tolist(), strict=True))
        worst[told] = [other.worst(map(of.__getitem__, bags[i])) for i in told]
    machine.slopes, machine.shift = _fit_probability(worst, toxic)
    return machine


class Scorer:
    """Margins of documents, with the tokens seen before."""

    def __init__(self, machine: Machine, limit: int = REMEMBERED) -> None:
        self.machine, self.limit = machine, limit
        self.known: dict[str, float] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        units = [token_units(t) for t in new]
        flat = sorted(set().union(*units))
        margin = dict(zip(flat, self.machine.margins(flat).tolist(), strict=True))
        floor = self.machine.bias
        self.known.update((t, max((margin[u] for u in own), default=floor)) for t, own in zip(new, units, strict=True))

    def worst(self, texts: list[str]) -> np.ndarray:
        """The worst margins of each text."""
        tokens = [t.lower().split() for t in texts]
        sets = [set(t) for t in tokens]
        self._learn(set().union(*sets))
        extra = [spelled(t) for t in tokens]
        flat = sorted(set().union(*extra))
        margin = dict(zip(flat, self.machine.margins(flat).tolist(), strict=True))
        known, worst = self.known.__getitem__, self.machine.worst
        rows = [worst([*map(known, s), *(margin[u] for u in e)]) for s, e in zip(sets, extra, strict=True)]
        return np.array(rows, dtype=np.float64).reshape(len(texts), WORST)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return self.machine.probability(self.worst(texts))


#: Texts whose tokens are learnt together; bounds memory where batches hold long texts.
BLOCK_CHARS = 1_000_000


def train_on(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Machine:
    """A machine from a sample of at most ``train_rows`` labelled documents, chosen by a hash of the identifier. That
    bound is also what the sample's broadcast and the rows sent to the driver are limited by."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    rows = (
        docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "id")
        .orderBy("id", "label", "text")
        .limit(train_rows)
        .collect()
    )
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def toxicity(machine: Machine, text: str = "text") -> Column:
    """The probability that a text is toxic."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(machine)  # comes with its table folded to one column; no task builds that of all landmarks
        for batch in batches:
            for block in blocks((t.as_py() for t in batch), BLOCK_CHARS):
                yield pa.array(scorer.probabilities(block), pa.float64())

    return score.asNondeterministic()(text)
