import numpy as np
import pytest
from pyspark.sql import functions as F

from lshthemes.functions import TokenHashEncoder
from lshthemes.operators import (
    build_index,
    candidates,
    density_search,
    documents_by_id,
    fetch_documents,
    lsh_search,
    multi_probe_candidates,
    multi_probe_search,
    multi_probe_stats,
    recall_at_k,
    refine_candidates,
    search_exact,
    search_strategy,
)
from lshthemes.plans import search_text
from lshthemes.registry import tables
from lshthemes.sources import read_index, write_index
from tests.conftest import SF01

DIM = 64


def found(df):
    return sorted((r["query_id"], r["rank"], r["row_id"]) for r in df.collect())


def brute_force(queries, rows, k, allowed=lambda q, r: True):
    """Rank by similarity to nine digits, undefined last, then by id."""
    out = []
    for qid, q in queries:
        scored = []
        for rid, v in rows:
            if allowed(qid, rid):
                norm = np.linalg.norm(q) * np.linalg.norm(v)
                sim = np.dot(q, v) / norm if norm else -2.0
                scored.append((-round(float(sim), 9), rid))
        out += [(qid, i + 1, rid) for i, (_, rid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def random_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(300)]
    return rows + [(300 + i, rows[0][1]) for i in range(150)] + [(450, [0, 0, 0, 0])]


@pytest.fixture(scope="module")
def random_queries():
    rng = np.random.default_rng(6)
    return [(i, rng.integers(-2, 3, 4).tolist()) for i in range(40)] + [(40, [0, 0, 0, 0])]


def test_exact_search_with_ties_and_zero_vectors(make_vectors, random_rows, random_queries):
    corpus = make_vectors(random_rows)
    queries = make_vectors(random_queries, "query_id")
    want = brute_force(random_queries, random_rows, 10)
    assert found(search_exact(queries, corpus, k=10)) == want
    assert found(search_exact(queries, corpus.repartition(7), k=10)) == want
    assert found(search_exact(queries, corpus, k=1000)) == brute_force(random_queries, random_rows, 1000)


def test_queries_beyond_one_pass_go_in_blocks(make_vectors, random_rows, random_queries):
    corpus, queries = make_vectors(random_rows), make_vectors(random_queries, "query_id")
    got = search_exact(queries, corpus, k=3, dim=4, query_bytes=8 * 4 * 10)
    assert found(got) == brute_force(random_queries, random_rows, 3)


def test_repeated_query_ids_in_blocks_are_refused(make_vectors):
    queries = make_vectors([(1, [1, 0])] * 30, "query_id")
    with pytest.raises(ValueError, match="unique"):
        search_exact(queries, make_vectors([(0, [1, 1])]), dim=2, query_bytes=8 * 2 * 4)


def test_undefined_similarity_is_null_and_last(make_vectors):
    corpus = make_vectors([(0, [0, 0]), (1, [-1, -1]), (2, [float("nan"), 1]), (3, [1, 1])])
    rows = search_exact(make_vectors([(7, [1, 1])], "query_id"), corpus).orderBy("rank").collect()
    assert [r["row_id"] for r in rows] == [3, 1, 0, 2]
    assert [r["similarity"] for r in rows][2:] == [None, None]


def test_text_query_ids_and_unfit_vectors(spark, make_vectors):
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", None)], "query_id string, embedding array<float>")
    got = search_exact(queries, make_vectors([(0, [1, 1]), (1, [1])]), dim=2)
    assert found(got) == [("a", 1, 0)]


def test_no_queries(make_vectors, searchable):
    none = make_vectors([], "query_id")
    assert search_exact(none, make_vectors([(0, [1, 1])]), dim=2).count() == 0
    assert density_search(none, searchable([(0, [1, 1])], 2), dim=2).count() == 0


@pytest.fixture(scope="module")
def searches(spark):
    queries = tables.text_queries(spark, SF01).cache()
    index = tables.stored_documents(spark, SF01)
    yield queries, index
    queries.unpersist(), index.unpersist()


def test_golden_density_outcomes(searches):
    queries, index = searches
    rows = search_strategy(queries, index, dim=DIM).groupBy("status", "fell_back").count().collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {
        ("sparse", False): 21,
        ("refined", False): 13,
        ("refined", True): 2,
        ("empty", False): 4,
    }


def test_strategy_leaves_absent_fields_null(searches):
    queries, index = searches
    for r in search_strategy(queries, index, dim=DIM).collect():
        if r["status"] == "empty":
            assert r["bucket_size"] is r["final_candidates"] is r["level_1_hash"] is None
        elif r["status"] == "sparse":
            assert r["refined_candidates"] is r["reduction_pct"] is None
            assert r["final_candidates"] == r["bucket_size"] < 10
        elif r["fell_back"]:
            assert r["refined_candidates"] == 0 and r["final_candidates"] == r["bucket_size"]


def test_golden_recall_and_probe_statistics(searches):
    queries, index = searches
    exact = search_exact(queries, index, k=5, dim=DIM).cache()

    def recall(approx):
        return recall_at_k(approx, exact, 5).agg(F.avg("recall")).first()[0]

    assert recall(lsh_search(queries, index, k=5, dim=DIM)) == pytest.approx(0.06)
    assert recall(density_search(queries, index, k=5, dim=DIM)) == pytest.approx(0.03)
    assert recall(multi_probe_search(queries, index, k=5, dim=DIM)) == pytest.approx(0.64)
    assert recall(exact) == 1.0
    stats = multi_probe_stats(queries, index, dim=DIM)
    assert stats.agg(F.avg("total_candidates")).first()[0] == pytest.approx(278.375)
    assert {r["num_probes"] for r in stats.collect()} == {37}


def test_probing_every_bucket_is_exact(searches):
    queries, index = searches
    exact = search_exact(queries, index, k=5, dim=DIM)
    assert found(multi_probe_search(queries, index, k=5, radius=8, dim=DIM)) == found(exact)


def test_candidates_nest(searches):
    queries, index = searches
    own = candidates(queries, index, dim=DIM)
    refined = refine_candidates(queries, index, dim=DIM)
    probed = multi_probe_candidates(queries, index, dim=DIM)
    assert refined.exceptAll(own).count() == own.exceptAll(probed).count() == 0


def test_index_with_and_without_vectors_agree(spark, searches):
    queries, index = searches
    corpus = tables.encoded_documents(spark, SF01)
    bare = tables.document_index(spark, SF01)
    for search in (lsh_search, density_search, multi_probe_search):
        assert found(search(queries, bare, corpus, dim=DIM)) == found(search(queries, index, dim=DIM))
    with pytest.raises(ValueError, match="carries no vectors"):
        lsh_search(queries, bare, dim=DIM)


def test_stored_index_prunes_by_bucket(spark, searches, tmp_path):
    queries, index = searches
    path = str(tmp_path / "index")
    write_index(index, path)
    stored = read_index(spark, path)
    one = queries.limit(1)
    plan = lsh_search(one, stored, dim=DIM)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "bucket_id" in pushed and "bits" in pushed
    assert found(lsh_search(queries, stored, dim=DIM)) == found(lsh_search(queries, index, dim=DIM))


def test_index_of_other_bits_serves_any_bucket_width(spark, searches):
    queries, index = searches
    wide = tables.document_index(spark, SF01, bits=10, carry=("embedding", "item_id", "title"))
    assert found(lsh_search(queries, wide, dim=DIM)) == found(lsh_search(queries, index, dim=DIM))


def test_foreign_index_of_other_width_is_cut_and_hashed(searches, spark):
    queries, index = searches
    wide = tables.document_index(spark, SF01, bits=10)
    corpus = tables.encoded_documents(spark, SF01)
    for bits, source in ((8, index), (10, wide)):
        foreign = source.select("bucket_id", "file_path", "row_id")
        got = lsh_search(queries, foreign, corpus, dim=DIM, index_bits=bits)
        assert found(got) == found(lsh_search(queries, index, dim=DIM))
        dense = density_search(queries, foreign, corpus, dim=DIM, index_bits=bits)
        assert found(dense) == found(density_search(queries, index, dim=DIM))
    with pytest.raises(ValueError, match="index_bits"):
        lsh_search(queries, foreign, corpus, dim=DIM)
    with pytest.raises(ValueError, match="12 bits are asked for"):
        lsh_search(queries, foreign, corpus, base_bits=12, dim=DIM, index_bits=10)


def test_index_that_cannot_answer_is_refused(vectors):
    """Requests beyond the stored hash, another seed and another width; within them every row finds itself."""
    asked = vectors.where("row_id < 100").withColumnRenamed("row_id", "query_id")
    index = build_index(vectors, dim=DIM, carry=("embedding",))
    for search, wrong in (
        (density_search, {"base_bits": 14, "refine_bits": 4}),
        (lsh_search, {"base_bits": 20}),
        (lsh_search, {"seed": 7}),
        (lsh_search, {"dim": 32}),
        (multi_probe_search, {"seed": 7}),
        (search_strategy, {"base_bits": 14}),
        (multi_probe_stats, {"seed": 7}),
        (candidates, {"seed": 7}),
    ):
        with pytest.raises(ValueError):
            search(asked, index, **{"dim": DIM, **wrong})
    mixed = index.unionByName(build_index(vectors, dim=DIM, seed=7, carry=("embedding",)))
    with pytest.raises(ValueError, match="differ in seed"):
        lsh_search(asked, mixed, dim=DIM)
    wide = build_index(vectors, bits=20, dim=DIM, carry=("embedding",))
    for found_ in (
        lsh_search(asked, wide, k=1, base_bits=20, dim=DIM),
        lsh_search(asked, build_index(vectors, bits=10, dim=DIM, carry=("embedding",)), k=1, dim=DIM),
        density_search(asked, wide, k=1, base_bits=14, refine_bits=4, dim=DIM),
    ):
        assert found_.where("query_id = row_id").count() == 100


def test_queries_that_do_not_fit_are_named(make_vectors, searchable):
    asked = make_vectors([(0, [1, 2]), (1, [1, 2, 3]), (2, None)], "query_id")
    index = searchable([(5, [1, 2])], 2)
    status = {r["query_id"]: r["status"] for r in search_strategy(asked, index, dim=2).collect()}
    assert status == {0: "sparse", 1: "unfit", 2: "unfit"}
    probes = {r["query_id"]: (r["num_probes"], r["total_candidates"]) for r in multi_probe_stats(asked, index, dim=2).collect()}
    assert probes == {0: (37, 1), 1: (0, 0), 2: (0, 0)}


def test_repeated_query_ids_raise_with_one_block_and_with_many(make_vectors, searchable):
    asked = make_vectors([(0, [1, 2]), (0, [2, 1])], "query_id")
    index = searchable([(5, [1, 2])], 2)
    for limit in (1 << 20, 16):
        with pytest.raises(ValueError, match="unique"):
            lsh_search(asked, index, dim=2, query_bytes=limit)


def test_hot_bucket_is_searched_whole(make_vectors, searchable):
    rows = [(i, [1, 2, 3, 4]) for i in range(30_000)] + [(30_000 + i, [1, 2, 3, 5]) for i in range(30)]
    got = lsh_search(make_vectors([(0, [1, 2, 3, 5])], "query_id"), searchable(rows, 4), k=40, dim=4)
    ids = [r["row_id"] for r in got.orderBy("rank").collect()]
    assert ids == [30_000 + i for i in range(30)] + list(range(10))


def test_documents_of_results(spark, searches, documents):
    queries, index = searches
    got = fetch_documents(search_exact(queries, index, k=2, dim=DIM).drop("file_path"), documents)
    assert got.count() == 80
    for r in got.collect():
        assert r["preview"] == (r["body"] if len(r["body"]) > 100 else None)
    assert documents_by_id(documents, [3, "5"]).count() == 2


def test_documents_by_id_take_every_item_of_the_benchmark(spark, tmp_path):
    from lshthemes import registry

    docs = [(k, f"text {k}", "en", "web", 6) for k in range(1500)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(k,) for k in [*range(1400), 7, 7, 9000, None]]
    spark.createDataFrame(items, "item_id bigint").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["documents_by_id"](spark, str(tmp_path)).collect()
    assert sorted(int(r["item_id"]) for r in got) == list(range(1400))


def test_searching_texts(spark, searches):
    queries, index = searches
    texts = spark.read.parquet(f"{SF01}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    report = search_text(texts, TokenHashEncoder(DIM), index)
    assert found(report.results) == found(density_search(queries, index, dim=DIM))
    assert report.strategy.count() == 40


def test_golden_outcomes_at_a_low_threshold(vectors):
    """Given vectors against each other, with every branch of the density rule."""
    asked = vectors.where("row_id < 50").withColumnRenamed("row_id", "query_id")
    index = build_index(vectors.where("row_id >= 50"), dim=DIM, carry=("embedding",))
    rows = search_strategy(asked, index, threshold=3, dim=DIM).groupBy("status", "fell_back").count()
    assert {(r[0], r[1]): r[2] for r in rows.collect()} == {
        ("sparse", False): 19,
        ("refined", False): 7,
        ("refined", True): 15,
        ("empty", False): 9,
    }
    assert density_search(asked, index, k=5, threshold=3, dim=DIM).count() == 92
