"""Spelling variants, quality rules and collocations against brute force on small and given tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lshthemes.llm import collocations, quality_rules, queries, spelling
from tests.conftest import SF01, SF001

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- spelling -------------------------------------------------------------------------------------------------------------


def near_by_edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    by_gap = {}
    for w in n:
        for k in range(len(w)):
            by_gap.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for group in by_gap.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("few", [0, 2, 8])
def test_variants_by_brute_force(docs, few):
    pick = random.Random(3)
    words = ["".join(pick.choice("abcé") for _ in range(pick.randint(5, 8))) for _ in range(40)]
    texts = [" ".join(pick.choice(words) + pick.choice(["", "", "s", "×"]) for _ in range(60)) for _ in range(30)]
    texts += [None, "", "ABCDEF " * 30, "abcdeg " * 6, "abcdefg " * 5, "x" * 3000 + " " + "x" * 2999, *["y" * 3000 + " " + "y" * 2999] * 5]
    rows = list(enumerate(texts)) + [(None, "abcdef abcdeg " * 40), (3, texts[3]), (3, "bcdefg " * 9)]
    table = docs([(i, t) for i, t in rows])
    got = spelling.spelling_variants(table, few=few).collect()
    assert {tuple(r) for r in got} == plain_variants(rows) and len(got) == len({r["word"] for r in got})
    assert got[0].asDict().keys() == {"word", "form", "root", "n", "n_near", "form_n"}


def test_neighbour_sums_are_those_of_the_neighbours():
    codes = lambda w: np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)[None, :]
    word, letters = "abca", "abcd"
    table = spelling._PLAIN
    replaced, inserted, left_out = spelling.neighbour_sums(table[codes(word)], table[codes(letters)[0]])
    of = lambda w: spelling.sums(codes(w), table)[0]
    for k in range(4):
        assert left_out[0, k] == of(word[:k] + word[k + 1 :])
        for j, c in enumerate(letters):
            assert replaced[0, k, j] == of(word[:k] + c + word[k + 1 :])
    for k in range(5):
        for j, c in enumerate(letters):
            assert inserted[0, k, j] == of(word[:k] + c + word[k:])


def test_variants_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = queries.op11_reduced_alphabet_variants(spark, SF001).collect()
    assert {tuple(r) for r in got} == plain_variants(rows)


def test_variants_of_nothing(docs):
    assert spelling.spelling_variants(docs(["ab cd", None])).count() == 0
    assert spelling.spelling_variants(docs(["a"]).limit(0)).count() == 0


# -- quality rules --------------------------------------------------------------------------------------------------------


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base)


def test_stats_by_brute_force(docs):
    pick = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a b c a b c", "é ü x y \x1c z", "x\n\nx\n x\nx\n", "#*$%&|<>#", "w " * 5000, "q" * 100_000]
    for _ in range(60):
        texts.append("".join(pick.choice(["a", "b", "cé", "|"]) + pick.choice([" ", " ", "\n", "\r", "\t"]) for _ in range(pick.randint(1, 140))))
    rows = quality_rules.quality_rules(docs(texts), quality_rules.Model()).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        assert tuple(row)[1:7] == plain_stats(text)
        assert row["kept"] == (not row["base_failed"])


def test_op12_stats_of_given_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op12_quality_rules(spark, SF001).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:7] == plain_stats(texts[r["doc_id"]]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_scores_are_those_of_the_features():
    model = quality_rules.Model(np.random.RandomState(1).randn(quality_rules.BUCKETS).astype(np.float32), 0.5, 1.0, 0.0)
    words = "the café was a ### house the café".encode().split() + [b"z" * 200]
    by_features = float(quality_rules.features(words).astype(np.float64) @ model.weights) + model.bias
    scorer = quality_rules.Scorer(model, limit=2)
    assert abs(scorer.margin(words) - by_features) < 1e-3
    assert abs(scorer.margin(words) - by_features) < 1e-3  # and again from memory


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    unseen = labels.where(queries.held_out())
    model = quality_rules.train_on(docs, labels.where(~queries.held_out()))
    rows = quality_rules.quality_rules(docs, model).join(unseen, "doc_id").collect()
    passed = [r for r in rows if not r["base_failed"]]
    bad, good = [r for r in passed if r["quality"] == 0], [r for r in passed if r["quality"] == 1]
    assert bad and good
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    # calibrated: the mean probability is near the share of good ones
    mean = sum(r["probability"] for r in passed) / len(passed)
    assert abs(mean - len(good) / len(passed)) < 0.05


def test_nothing_to_learn(docs, spark):
    text = " ".join(f"w{k}" for k in range(60))
    table = docs([text, "short", None])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    for rows, kept in (([], True), ([(0, 1), (None, 0), (0, None)], True), ([(0, 0)], False)):
        model = quality_rules.train_on(table, labels(rows))
        got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(table, model).collect()}
        assert got == {0: kept, 1: False, 2: False}
    assert quality_rules.quality_rules(table.limit(0), quality_rules.Model()).count() == 0


# -- collocations ---------------------------------------------------------------------------------------------------------


def plain_phrases(rows, top=2000, least=10):
    f = {}
    for lang, text in rows:
        mine = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                mine.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, mine in f.items():
        n = sum(c for g, c in mine.items() if len(g) == 1)
        cand = {g: a for g, a in mine.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cand.items()):
                continue
            cuts = [(1_000_000 * a * a // (mine[g[:k]] * mine[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), mine[g[:k]], mine[g[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}
    return out


def phrase_rows(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 AS node", "2 AS tail", "3 AS salt", "4 AS n")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrases_by_brute_force(spark, seed):
    pick = random.Random(seed)
    fixed = "once upon a time there was a king"
    rows = [(None, None), ("en", ""), ("en", " ... "), ("fr", "seul")]
    for _ in range(120):
        words = [pick.choice("a b c D é f g".split(" ")) + pick.choice(["", "", "", ".", ",", "\n", "!"]) for _ in range(pick.randint(1, 40))]
        if pick.random() < 0.3:
            words.insert(pick.randrange(len(words)), fixed)
        rows.append((pick.choice(["en", "en", None, "de"]), pick.choice([" ", "\t", "  "]).join(words)))
    got = collocations.collocations(phrase_rows(spark, rows)).collect()
    assert {tuple(r) for r in got} == plain_phrases(rows) and len(got) == len(set(got))
    few = collocations.collocations(phrase_rows(spark, rows), top=5).collect()
    assert {tuple(r) for r in few} == plain_phrases(rows, top=5)


def test_blocks_and_hot_nodes_change_nothing(spark, monkeypatch):
    pick = random.Random(9)
    rows = [("en", " ".join(["x", "y", pick.choice("abcdefgh")] * 3 + [pick.choice("pq")] * 2)) for _ in range(200)]
    table = phrase_rows(spark, rows)
    rank = lambda graph: {(r["lang"], r["node"], r["flow"], tuple(sorted(map(tuple, r["tails"])))) for r in graph.collect()}
    monkeypatch.setattr(collocations, "hot_nodes", lambda *_: {})
    plain = rank(collocations.phrase_graph(table))
    monkeypatch.setattr(collocations, "hot_nodes", lambda *_: {"en": ["x y", "p p"]})
    assert rank(collocations.phrase_graph(table, block=50)) == plain


def test_hot_nodes_are_found(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE", 1)
    monkeypatch.setattr(collocations, "HOT_SHARE", 4)
    table = phrase_rows(spark, [("en", "x y z x y z x y q r s t")])
    assert collocations.hot_nodes(table) == {"en": ["x y"]}


def test_paths(spark):
    rows = [("en", "m a b c d e f g")] * 12 + [("en", "q b c z")] * 11
    graph = collocations.phrase_graph(phrase_rows(spark, rows))
    got = {r["path"]: (r["words"], r["n"], list(r["inner"])) for r in collocations.compact_paths(graph).collect()}
    assert got == {
        "m a b c": (4, 12, ["a b"]),
        "b c d e f g": (6, 12, ["c d", "d e", "e f"]),
        "q b c": (3, 11, []),
        "b c z": (3, 11, []),
    }


def test_scores_pass_64_bits(spark):
    graph = spark.createDataFrame(
        [("en", "", 10**13, []), ("en", "a", 10**12, []), ("en", "b", 10**12 + 7, []), ("en", "a b", 10**12 - 3, [])],
        "lang string, node string, flow bigint, tails array<struct<tail:string,n:bigint>>",
    )
    a, l, r = 10**12 - 3, 10**12, 10**12 + 7
    assert [x["score"] for x in collocations.scored_phrases(graph).collect()] == [1_000_000 * a * a // (l * r)]


def test_phrases_of_nothing(spark):
    assert collocations.collocations(phrase_rows(spark, [("en", None)])).count() == 0
    assert collocations.collocations(phrase_rows(spark, [("en", "x")]).limit(0)).count() == 0


def test_a_hot_node_that_no_word_follows():
    """The piece ends after each of its occurrences, so the block has no word to tell of."""
    from lshthemes.llm.collocations import _graph_rows, _Walk

    walk = _Walk()
    walk.read("a b. a b")
    rows = [r for batch in _graph_rows("en", walk, pa.array(["a b"])) for r in batch.to_pylist()]
    assert [(r["n"], r["tails"]) for r in rows if r["hot"]] == [(2, "")]
