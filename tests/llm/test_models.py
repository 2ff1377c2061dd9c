"""Toxicity and resampling: the kernel by definition, held-out accuracy, exact draws, edge cases; and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lshthemes.llm import queries, resampling, toxicity
from lshthemes.sources.scratch import scratch_path

CLEAN = "the of and house river mountain walking table green yellow summer winter paper music garden window".split()
BAD = ["idiot", "scumbag", "moron"]


def plain_kernel(a, b):
    def features(s):
        s, out = f"^{s}$", {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            key = tuple(s[k] for k in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = features(a), features(b)
    inner = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return inner(x, y) / (inner(x, x) * inner(y, y)) ** 0.5


def test_kernel_is_the_gapped_one():
    units, marks = ["idiot", "idxiot", "ab", "éàé", "worthlessness"], ["idiot", "worthless", "ab"]
    got = toxicity.kernel(units, marks)
    want = [[plain_kernel(u, m) for m in marks] for u in units]
    assert np.allclose(got, want, atol=1e-4)


def make_texts(n, seed):
    pick = random.Random(seed)
    rows = []
    for k in range(n):
        words = [pick.choice(CLEAN) + pick.choice(["", "s", "er"]) for _ in range(pick.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            words[pick.randrange(len(words))] = pick.choice(BAD)
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_texts():
    train, test = make_texts(300, 1), make_texts(200, 2)
    machine = toxicity.train(*zip(*train, strict=True))
    scorer = toxicity.Scorer(machine)
    score = scorer.probabilities([t for t, _ in test])
    label = np.array([x for _, x in test])
    assert ((score >= toxicity.THRESHOLD) == label).mean() > 0.97
    odd = ["you i d i o t there", "id-iot", "1diot", "an idiot", "x" * 5000 + " moron"]
    assert (scorer.probabilities(odd) > 0.5).all()
    calm = scorer.probabilities(["", "the summer house", "x" * 5000])
    assert (calm < 0.5).all()


def test_toxicity_in_every_language(spark):
    """Trained as the query trains, judged on the labels it never sees."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    machine = toxicity.train_on(docs, labels.where(~queries.held_out()))
    rows = docs.join(labels.where(queries.held_out()), "doc_id").select("lang", "toxic", toxicity.toxicity(machine).alias("score")).collect()
    for lang in ("en", "de", "fr", "es"):
        bad = np.array([r["score"] for r in rows if r["lang"] == lang and r["toxic"]])
        good = np.array([r["score"] for r in rows if r["lang"] == lang and not r["toxic"]])
        ahead = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
        assert len(bad) > 9 and ahead >= 0.9, lang
        assert (bad >= toxicity.THRESHOLD).mean() >= 0.7, lang
    good = np.array([r["score"] for r in rows if not r["toxic"]])
    assert (good >= toxicity.THRESHOLD).mean() < 0.01


def test_long_obfuscated_tokens_are_scored_in_parts():
    phrase = ".".join("thehouseidiotmountainwinter")
    assert any("idiot" in unit for unit in toxicity.token_units(phrase))
    machine = toxicity.train(*zip(*make_texts(300, 1), strict=True))
    score = toxicity.Scorer(machine).probabilities([f"the {'.'.join('idiot' * 6)} green", phrase.replace("idiot", "table")])
    assert score[0] > 0.5 > score[1]


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    table = docs([BAD[0] + " the house", "the green house", None, "", (None, "idiot"), "idiot " * 30_000])
    machine = toxicity.train_on(table, labels)
    rows = table.select("text", toxicity.toxicity(machine).alias("score")).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 6
    nothing = toxicity.train_on(table, labels.limit(0))
    assert {round(r[0], 6) for r in table.select(toxicity.toxicity(nothing)).collect()} == {0.0}
    assert table.limit(0).select(toxicity.toxicity(machine)).count() == 0


def test_bound_of_the_training_sample(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id bigint, toxic int")
    machine = toxicity.train_on(docs([f"{BAD[0] if k % 2 else ''} house" for k in range(50)]), labels, train_rows=10)
    assert machine.landmarks


@pytest.mark.parametrize("k", [0, 1, 7, 100, 399, 400, 500])
def test_top_keys_are_the_largest(spark, k):
    pick = random.Random(k)
    rows = [(i, pick.choice([pick.random(), 0.5, float(pick.randint(0, 3))])) for i in range(400)]
    path = scratch_path(spark, "keys")
    spark.createDataFrame(rows, "id bigint, key double").write.parquet(path)
    got = {r["id"] for r in resampling.mark_top(spark.read.parquet(path), k).where("selected").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_weights_are_ratios_of_smoothed_models(spark, docs):
    texts = ["good prose here"] * 5 + ["junk junk junk"] * 5 + [None, ""]
    marks = spark.createDataFrame([(k, k < 5) for k in range(10)] + [(None, True), (99, True)], "doc_id bigint, is_target boolean")
    rows = resampling.resample(docs(texts), marks, share=0.5).collect()
    weight = {r["doc_id"]: r["log_weight"] for r in rows}
    grams = resampling.Grams(resampling.BUCKETS)
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for k, t in enumerate(texts):
        found = np.bincount(grams.of(t or ""), minlength=resampling.BUCKETS)
        raw += found
        target += found * (k < 5)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for k, t in enumerate(texts):
        found = grams.of(t or "")
        assert weight[k] == pytest.approx(ratio[found].mean() * resampling.SHARPNESS if len(found) else 0.0)
    assert sum(r["selected"] for r in rows) == 6 and all(weight[k] > weight[9] for k in range(5))
    assert resampling.resample(docs([]).limit(0), marks).count() == 0
    assert resampling.resample(docs(texts), marks.limit(0)).where("selected").count() == 0


def test_noise_is_gumbel(spark):
    row = spark.range(20_000).select(F.avg(resampling.gumbel(F.col("id"))), F.var_samp(resampling.gumbel(F.col("id")))).first()
    assert row[0] == pytest.approx(0.5772, abs=0.03) and row[1] == pytest.approx(np.pi**2 / 6, abs=0.06)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_over_whole_tables(spark, name):
    import duckdb

    from check_oracle import TABLES, rows_of

    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    if name in queries.oracle_sql():
        duck = duckdb.connect()
        for table in TABLES:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        assert rows_of(got.toPandas()) == rows_of(duck.execute(queries.oracle_sql()[name]).df())
    elif "decontamination" not in name and "variants" not in name:
        table = "pages" if "warc" in name else "documents"
        assert got.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    pick = random.Random(4)
    words = lambda n: " ".join(pick.choice(CLEAN) + str(pick.randint(0, 40)) for _ in range(n))
    item = words(30)
    base = words(1500)
    texts = [f"{words(20)} {BAD[k % 3]} {words(9)}" for k in range(60)] + [words(30) for _ in range(90)]
    first = len(texts)
    texts += [base, base + "  ", base + "\nend", f"{words(10)} {item} {words(10)}", None, ""]
    sf = str(tmp_path)
    table = docs(texts).select("doc_id", "text", "lang", "source", "n_chars", "salt", F.lit(1).alias("_toxicity"), F.lit(2).alias("label"), F.lit(3).alias("fp"), F.lit(4).alias("mark"))
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60)) for k in range(150)], "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    seen, current = [], spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, current, sf).write.parquet(path)
        current = spark.read.parquet(path)
        assert current.columns == table.columns
        seen.append({r["doc_id"] for r in current.select("doc_id").collect()})
    every = set(range(len(texts)))
    assert every - seen[0] == set(range(60))
    assert seen[0] - seen[1] == {first, first + 5}  # of the equal ones the longest stays, of the empty ones the first
    assert seen[1] - seen[2] == {first + 2}
    assert seen[2] - seen[3] == {first + 3}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == seen[3]
