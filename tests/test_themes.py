import random

import pytest
from pyspark.sql import functions as F

from lshthemes.operators import (
    bucket_items,
    bucket_summary,
    clean_labels,
    coalesce_labels,
    dense_buckets,
    group_labels,
    keyword_counts,
    label_samples,
    merge_themes,
    sample_bucket_items,
    sample_items,
    similar_labels,
    theme_buckets,
    theme_labels,
    theme_samples,
)
from lshthemes.plans import discover_themes
from lshthemes.registry.tables import KEYWORDS_FOUND, WORD_PARTS


def words(label):
    return set(label.lower().replace("+", " ").split())


def alike(a, b):
    return len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) and words(b) else 0.0


def greedy(labels, threshold):
    """Leader of every label, one label after the other."""
    leaders, out = [], {}
    for label in labels:
        lead = next((x for x in leaders if alike(label, x) >= threshold), None)
        if lead is None:
            leaders.append(label)
        out[label] = lead or label
    return out


def ranked(spark, labels):
    return spark.createDataFrame(list(zip(labels, range(len(labels)))), "label string, rank long")


def random_labels(seed, n=60):
    rng = random.Random(seed)
    # "hot" is in a third of the labels.
    picks = {
        " + ".join(rng.sample("a b c d e f g h".split(), rng.randint(1, 3)) + ["hot"] * (i % 3 == 0))
        for i in range(n)
    }
    return sorted(picks, key=lambda x: rng.random()) + [f"Theme {i}" for i in range(20)] + ["+"]


@pytest.mark.parametrize("threshold", [0.0, 0.25, 1 / 3, 0.5, 0.67, 1.0])
def test_grouping_is_greedy_in_every_form(spark, threshold):
    labels = random_labels(int(threshold * 100))
    want = greedy(labels, threshold)
    table = ranked(spark, labels).repartition(5)
    for how in ({"small": True}, {"small": False, "block": 30}, {}):
        assert dict(map(tuple, group_labels(table, threshold, **how).collect())) == want


@pytest.mark.parametrize("threshold", [0.2, 1 / 3, 0.5, 1.0])
def test_rounds_with_narrow_windows_and_hot_keys_are_greedy(spark, threshold):
    rng = random.Random(17)
    labels = ["+"] + [" ".join(rng.sample("a b c d e f g h i".split(), rng.randint(1, 4)) + ["hot"] * (rng.random() < 0.7)) for _ in range(150)]
    labels = list(dict.fromkeys(labels))
    want = greedy(labels, threshold)
    for how in ({"block": 3}, {"block": 1000, "hot_rows": 2}, {"block": 5, "hot_rows": 1}):
        got = group_labels(ranked(spark, labels), threshold, small=False, **how).collect()
        assert len(got) == len(labels) and dict(map(tuple, got)) == want


def test_unlike_labels_take_few_rounds(spark, monkeypatch):
    """Labels that share nothing lead in one round, a key that all share is worked off by windows; none is collected."""
    from lshthemes.operators import labels as labels_op

    rounds, settle = [], labels_op._settle

    def count(df, purpose):
        rounds.extend([1] if purpose == "label-window" else [])
        return settle(df, purpose)

    monkeypatch.setattr(labels_op, "_settle", count)
    unlike = ranked(spark, [f"w{i} v{i}" for i in range(10_000)])
    got = group_labels(unlike, 0.5, small=False)
    assert got.where("label = leader").count() == 10_000 and len(rounds) == 1
    rounds.clear()
    # at a third every label is like the first, by the word they share
    assert group_labels(ranked(spark, [f"hot w{i}" for i in range(3_000)]), 1 / 3, small=False).where("leader = 'hot w0'").count() == 3_000
    assert len(rounds) < 20


def test_similar_labels_with_a_token_in_every_label(spark):
    labels = [f"hot x{i % 40} y{i}" for i in range(300)]
    want = {(a, b) for a in labels for b in labels if a < b and alike(a, b) >= 0.4}
    for hot_rows in (1, 7, 1_000):
        got = similar_labels(ranked(spark, labels), 0.4, hot_rows)
        assert {(r[0], r[1]) for r in got.collect()} == want and got.count() == len(want)


def addresses(n=140):
    """Labels that differ from many others by a word of their own, or by one that only another has."""
    rng = random.Random(5)
    words = lambda i: rng.sample("a b c d e f".split(), rng.randint(1, 4)) + [f"n{i - i % 2 if i % 10 < 2 else i}"] * (i % 7 > 0)
    return list(dict.fromkeys(" ".join(words(i)) for i in range(n))) + ["u v", "v u", "v + u"]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_classes_of_labels_are_grouped_and_paired_as_labels_are(spark, threshold):
    labels = addresses()
    for how in ({"block": 2}, {"block": 1000, "hot_rows": 1}):
        assert dict(map(tuple, group_labels(ranked(spark, labels), threshold, small=False, **how).collect())) == greedy(labels, threshold)
    want = {(a, b): alike(a, b) for a in labels for b in labels if a < b and alike(a, b) >= threshold}
    for hot_rows in (1, 1_000):
        got = similar_labels(ranked(spark, labels), threshold, hot_rows).collect()
        assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == pytest.approx(want)


def test_labels_with_a_word_of_their_own_are_compared_by_class(spark, monkeypatch):
    """Two classes of 400 labels have a handful of keys, not some for each label, and are grouped in one round."""
    from lshthemes.operators import labels as labels_op

    kept, settle = {}, labels_op._settle

    def keep(df, purpose):
        kept.setdefault(purpose, []).append(settle(df, purpose))
        return kept[purpose][-1]

    monkeypatch.setattr(labels_op, "_settle", keep)
    labels = ranked(spark, [f"{'x' if i % 2 else 'y'} a b c d e n{i}" for i in range(800)])
    assert similar_labels(labels, 0.55).count() == 800 * 799 // 2
    assert kept["label-keys"][0].count() < 50
    kept.clear()
    assert group_labels(labels, 0.55, small=False, block=8).select("leader").distinct().count() == 1
    assert kept["label-keys"][0].count() < 50 and len(kept["label-window"]) == 1


def test_grouping_in_one_row_is_bounded(spark):
    with pytest.raises(Exception, match="too many labels"):
        group_labels(ranked(spark, [f"w{i}" for i in range(300)]), 0.5, small=True).collect()
    assert group_labels(ranked(spark, [f"w{i}" for i in range(300)]), 0.5).count() == 300


@pytest.mark.parametrize("threshold", [0.1, 1 / 3, 0.5, 0.67, 1.0])
def test_similar_labels_finds_every_pair(spark, threshold):
    labels = random_labels(3)
    got = {(r[0], r[1]): r[2] for r in similar_labels(ranked(spark, labels), threshold).collect()}
    want = {(a, b): alike(a, b) for a in labels for b in labels if a < b and alike(a, b) >= threshold}
    assert got == pytest.approx(want)


def test_similar_labels_needs_a_threshold(spark):
    with pytest.raises(ValueError):
        similar_labels(ranked(spark, ["a"]), 0)


def test_common_tokens_do_not_pair_labels_that_cannot_be_alike(spark):
    """All labels share a word, which is a key only where it would be enough."""
    labels = ranked(spark, [f"Theme {i}" for i in range(500)])
    from lshthemes.functions import label_tokens
    from lshthemes.operators.labels import _join_keys

    keys = _join_keys(labels.withColumn("tokens", label_tokens("label")), 0.5)
    assert keys.where("token = 'theme' and own = 2 and other = 2").count() == 0
    assert similar_labels(labels, 0.5).count() == 0


GOLDEN = {
    0.3: [("License + Tel", 24, 4, True), ("Theme 173", 21, 4, True), ("License", 13, 2, False)],
    0.5: [("License + Tel", 24, 4, True), ("License", 13, 2, False), ("Theme 173", 6, 1, False)]
    + [(f"Theme {i}", 5, 1, False) for i in (121, 30, 31)],
    1.0: [("Tel", 19, 3, False), ("License", 13, 2, False), ("Theme 173", 6, 1, False), ("License + Tel", 5, 1, False)]
    + [(f"Theme {i}", 5, 1, False) for i in (121, 30, 31)],
}


@pytest.mark.parametrize("threshold", GOLDEN)
def test_golden_themes(index, documents, threshold):
    found = discover_themes(index, documents, lexicon=KEYWORDS_FOUND, threshold=threshold)
    rows = found.themes.collect()
    assert [(r["label"], r["total_count"], len(r["buckets"]), r["is_merged"]) for r in rows] == GOLDEN[threshold]
    assert all(r["n_items"] == r["total_count"] for r in rows)
    assert sum(r["total_count"] for r in rows) == 58
    ids = [b["bucket_id"] for r in rows for b in r["buckets"]]
    assert len(ids) == len(set(ids)) == 10


@pytest.mark.parametrize("threshold, n", [(0.5, 10), (0.3, 1), (0.0, 1)])
def test_default_keywords_name_nothing_here(index, documents, threshold, n):
    found = discover_themes(index, documents, threshold=threshold)
    assert found.themes.count() == n


def test_swapped_keywords_merge_at_full_similarity(index, documents):
    found = discover_themes(index, documents, lexicon=WORD_PARTS, threshold=1.0)
    merged = found.themes.where("is_merged").collect()
    assert [r["original_labels"] for r in merged] == [["Est + Ment", "Ment + Est"]]
    assert found.labels.select("label").distinct().count() == 6 and found.themes.count() == 5


def test_themes_of_all_buckets(index, documents):
    """Without a limit the general form of grouping is used, with the same outcome."""
    buckets = dense_buckets(index)
    items = bucket_items(index, documents)
    labels = theme_labels(items, KEYWORDS_FOUND)
    all_of = theme_buckets(buckets, labels, 0.5, top_n=None)
    wide = theme_buckets(buckets, labels, 0.5, top_n=1000)
    assert all_of.count() == 17 and all_of.exceptAll(wide).count() == 0
    total = merge_themes(buckets, labels, items, 0.5, top_n=None).agg(F.sum("total_count")).first()[0]
    assert total == buckets.agg(F.sum("count")).first()[0]


def test_dangling_entries_keep_counts_apart(spark, index, documents):
    few = documents.where("row_id < 250")
    found = discover_themes(index, few, lexicon=KEYWORDS_FOUND)
    rows = found.themes.collect()
    assert sum(r["total_count"] for r in rows) == 58
    top = [r["bucket_id"] for r in found.buckets.collect()]
    assert sum(r["n_items"] for r in rows) == bucket_items(index, few, top).count() < 58


def test_sampling_before_and_after_the_join_agree(index, documents):
    few = documents.where("row_id >= 100")
    ids = [39, 26, 96]
    late = sample_items(bucket_items(index, few, ids), 3).select("bucket_id", "row_id", "pos", "display_text")
    early = sample_bucket_items(index, few, ids, 3).select(late.columns)
    assert early.exceptAll(late).count() == 0 and early.count() == late.count() == 9


def items_of(spark, rows):
    return spark.createDataFrame(rows, "bucket_id long, row_id long, display_text string")


def test_keywords_count_inside_words_and_ties_keep_the_order(spark):
    items = items_of(spark, [(1, 0, "Happy APP login"), (1, 1, "reset LOGIN app"), (2, 0, "nothing")])
    counts = {(r["bucket_id"], r["keyword"]): r["n"] for r in keyword_counts(items).collect()}
    assert counts[1, "app"] == 3 and counts[1, "login"] == 2 and counts[2, "app"] == 0
    labels = {r["bucket_id"]: r["label"] for r in theme_labels(items).collect()}
    assert labels == {1: "App + Login", 2: "Theme 2"}
    tie = theme_labels(items_of(spark, [(1, 0, "wifi app login")])).first()["label"]
    assert tie == "Login + App"


def test_only_the_sample_is_counted(spark):
    items = items_of(spark, [(1, i, "x" if i < 10 else "wifi") for i in range(30)])
    assert theme_labels(items).first()["label"] == "Theme 1"
    assert theme_labels(items, sample=11).first()["label"] == "Wifi"


def test_label_samples_and_external_labels(spark):
    items = items_of(spark, [(1, i, f"{i}" + "z" * 200) for i in range(8)] + [(2, 0, "wifi"), (3, 0, "q")])
    sample = {r["bucket_id"]: r["sample"] for r in label_samples(items).collect()}
    assert sample[1] == "\n".join(f"- {i}" + "z" * 99 for i in range(5)) and sample[2] == "- wifi"
    raw = spark.createDataFrame([(1, ' "Long tail" '), (3, '""')], "bucket_id long, raw_label string")
    both = coalesce_labels(clean_labels(raw), theme_labels(items))
    assert {r[0]: r[1] for r in both.collect()} == {1: "Long tail", 2: "Wifi", 3: "Theme 3"}


def test_external_labels_in_discovery(spark, index, documents):
    raw = spark.createDataFrame([(39, "**Phone numbers**"), (26, "numbers phone")], "bucket_id long, raw_label string")
    found = discover_themes(index, documents, lexicon=KEYWORDS_FOUND, external=raw)
    merged = {r["label"]: r for r in found.themes.collect()}["numbers phone"]
    assert merged["total_count"] == 15
    assert merged["original_labels"] == ["Phone numbers", "numbers phone"]


def test_best_label_is_longest_then_greatest(spark):
    buckets = spark.createDataFrame([(1, 9), (2, 8), (3, 7)], "bucket_id long, count long")
    labels = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "B a")], "bucket_id long, label string")
    assert theme_buckets(buckets, labels, 1.0).select("theme").distinct().collect()[0][0] == "b a"


def test_bucket_summary(spark):
    def summary(*ids):
        df = spark.createDataFrame([([(i, 1) for i in ids],)], "buckets array<struct<bucket_id:long,count:long>>")
        return df.select(bucket_summary("buckets")).first()[0]

    assert summary(10) == "bucket 0xa"
    assert summary(1, 255) == "2 buckets: 0x1, 0xff"
    assert summary(1, 2, 3) == "3 buckets: 0x1, 0x2, 0x3"
    assert summary(1, 2, 3, 1023, 5) == "5 buckets: 0x1, 0x2, 0x3, +2 more"


def test_theme_samples(index, documents):
    found = discover_themes(index, documents, lexicon=KEYWORDS_FOUND)
    items = bucket_items(index, documents, found.buckets, bits=8)
    rows = theme_samples(found.themes, items, n=8).where("label = 'License + Tel'").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, 9))
    assert {r["bucket_id"] for r in rows} == {39} and {r["more_items"] for r in rows} == {16}
    ids = [r["row_id"] for r in rows]
    assert ids == sorted(ids)
