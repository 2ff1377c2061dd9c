"""The registered queries.

For comparison with other engines arrays and structs are shown as text, floats to six digits, and whole
numbers that may be missing as floats.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lshthemes.functions.encoders import TokenHashEncoder
from lshthemes.functions.hashing import hash_vectors, hyperplanes, probe_buckets, with_buckets
from lshthemes.functions.text import label_tokens
from lshthemes.functions.vectors import cosine, project
from lshthemes.operators import documents as documents_op
from lshthemes.operators import index as index_op
from lshthemes.operators import items as items_op
from lshthemes.operators import labels as labels_op
from lshthemes.operators import maps as maps_op
from lshthemes.operators import models as models_op
from lshthemes.operators import reports as reports_op
from lshthemes.operators import search as search_op
from lshthemes.operators import themes as themes_op
from lshthemes.plans.models import index_model, load_model
from lshthemes.plans.search import search_text
from lshthemes.plans.themes import discover_themes
from lshthemes.registry import tables as t
from lshthemes.registry.tables import DIM, KEYWORDS_FOUND, WORD_PARTS
from lshthemes.sources.corpora import CorpusShape, DatasetCatalog, load_corpus
from lshthemes.sources.indexes import merge_indexes, read_index, write_index, write_partitions
from lshthemes.sources.manifest import read_manifest
from lshthemes.sources.scratch import scratch_path
from lshthemes.sources.tables import read_map_points, read_metadata, write_metadata
from lshthemes.streaming.index_stream import (
    append_index,
    read_bucket_counts,
    stream_bucket_counts,
    stream_index,
    write_bucket_counts,
)

Query = Callable[[SparkSession, str], DataFrame]

_ALL: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _ALL[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_ALL)


def _joined(array: Column | str, separator: str = ",") -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), separator)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Hashing and encoding


@_query
def vector_hash(spark, sf_dir):
    hashed = hash_vectors(t.vectors(spark, sf_dir), hyperplanes(DIM))
    return with_buckets(hashed).select("row_id", "hash", "bucket_id", "level1")


@_query
def encode_documents(spark, sf_dir):
    vector = F.transform("embedding", lambda x: x.cast("bigint"))
    return t.encoded_documents(spark, sf_dir).select("row_id", _joined(vector).alias("embedding"))


@_query
def vector_cosine(spark, sf_dir):
    """Each given vector against the encoded text of the document with its id."""
    given = t.vectors(spark, sf_dir).withColumnRenamed("embedding", "given")
    texts = t.encoded_documents(spark, sf_dir).select("row_id", "embedding")
    pairs = given.join(texts, "row_id").withColumn("similarity", cosine("given", "embedding"))
    return _rounded(pairs.select("row_id", "similarity"), "similarity")


@_query
def probe_lists(spark, sf_dir):
    hashed = search_op.hash_queries(t.text_queries(spark, sf_dir), DIM)
    return probe_buckets(hashed).select("query_id", "bucket_id", "probe_bucket")


# Corpora


def _corpus_columns(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "row_id",
        "item_id",
        "title",
        "display_text",
        "preview",
        "category",
        F.col("score").cast("double").alias("score"),
        "author",
    )


@_query
def corpus_tweets(spark, sf_dir):
    return _corpus_columns(t.documents(spark, sf_dir, t.AS_TWEETS))


@_query
def corpus_papers(spark, sf_dir):
    return _corpus_columns(t.documents(spark, sf_dir, t.AS_PAPERS))


@_query
def corpus_posts(spark, sf_dir):
    return _corpus_columns(t.documents(spark, sf_dir, t.AS_POSTS))


@_query
def corpus_profile(spark, sf_dir):
    names = ("documents", "embeddings", "benchmark", "pages", "conversations")
    return models_op.corpus_profile({n: t.table(spark, sf_dir, n) for n in names})


@_query
def corpus_files(spark, sf_dir):
    """A corpus in several folders whose files have like names: every row keeps an identity of its own."""
    path = scratch_path(spark, "corpus")
    t.table(spark, sf_dir, "documents").write.partitionBy("lang").parquet(path)
    corpus = load_corpus(spark, path, CorpusShape(item_id="doc_id", body="text"))
    return corpus.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file_path", "row_id").alias("n_identities")
    )


# Index and density


@_query
def dense_buckets(spark, sf_dir):
    return index_op.dense_buckets(t.vector_index(spark, sf_dir))


@_query
def top_buckets(spark, sf_dir):
    return index_op.dense_buckets(t.vector_index(spark, sf_dir), top_n=10)


@_query
def stored_index(spark, sf_dir):
    """The index after a round trip through files in bucket order."""
    path = scratch_path(spark, "index")
    write_index(t.vector_index(spark, sf_dir), path)
    return read_index(spark, path)


@_query
def partitioned_index(spark, sf_dir):
    """The index as files of whole buckets, read beside a file that is no part of it."""
    path = scratch_path(spark, "partitions")
    index = t.vector_index(spark, sf_dir)
    write_partitions(index, path, 4)
    index.write.mode("append").parquet(path)  # files of other names
    return read_index(spark, path, layout="partitioned")


def _vector_manifest(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "index")
    write_index(t.vector_index(spark, sf_dir), path, manifest=True)
    return read_manifest(spark, path)


@_query
def manifest_dense_buckets(spark, sf_dir):
    """Dense buckets from what the index says about itself."""
    return index_op.dense_buckets(_vector_manifest(spark, sf_dir))


@_query
def manifest_stats(spark, sf_dir):
    stats = index_op.index_stats(_vector_manifest(spark, sf_dir))
    return _rounded(stats, "avg_bucket_size", "load_factor")


@_query
def stored_dense_buckets(spark, sf_dir):
    return index_op.dense_buckets(stored_index(spark, sf_dir))


@_query
def index_stats(spark, sf_dir):
    stats = index_op.index_stats(t.vector_index(spark, sf_dir))
    return _rounded(stats, "avg_bucket_size", "load_factor")


@_query
def size_histogram(spark, sf_dir):
    return index_op.bucket_size_histogram(t.vector_index(spark, sf_dir))


@_query
def density_stats(spark, sf_dir):
    return _rounded(index_op.density_stats(t.document_index(spark, sf_dir)), "avg_size")


@_query
def inverted_lists(spark, sf_dir):
    lists = index_op.inverted_lists(t.vector_index(spark, sf_dir), chunk_rows=100)
    return lists.select("bucket_id", "chunk", _joined("row_ids").alias("row_ids"))


@_query
def dangling_entries(spark, sf_dir):
    """Entries of the vector index without a label row."""
    labelled = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    return index_op.dangling_entries(t.vector_index(spark, sf_dir), labelled).select(
        "bucket_id", "row_id"
    )


@_query
def index_health(spark, sf_dir):
    """The vector index against the labelled rows, some of which have no vector."""
    labelled = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    corpus = labelled.join(t.vectors(spark, sf_dir), "row_id", "left")
    return index_op.index_health(t.vector_index(spark, sf_dir), corpus, DIM)


@_query
def merged_indexes(spark, sf_dir):
    """Vectors and encoded documents indexed apart, then counted as one index."""
    merged = merge_indexes(t.vector_index(spark, sf_dir), t.document_index(spark, sf_dir))
    parts = F.count_distinct("file_path").alias("parts")
    return merged.groupBy("bucket_id").agg(F.count("row_id").alias("count"), parts)


# Items


@_query
def bucket_items(spark, sf_dir):
    items = items_op.bucket_items(t.document_index(spark, sf_dir), t.documents(spark, sf_dir))
    return items.select("bucket_id", "row_id", "item_id", "display_text")


@_query
def top_bucket_items(spark, sf_dir):
    index = t.document_index(spark, sf_dir)
    top = index_op.dense_buckets(index, top_n=10)
    items = items_op.bucket_items(index, t.documents(spark, sf_dir), top, bits=8)
    return items.select("bucket_id", "row_id", "item_id", "title")


@_query
def sample_items(spark, sf_dir):
    items = items_op.bucket_items(t.document_index(spark, sf_dir), t.documents(spark, sf_dir))
    return items_op.sample_items(items, 3).select("bucket_id", "pos", "row_id", "item_id")


# Search


@_query
def search_exact(spark, sf_dir):
    found = search_op.search_exact(
        t.text_queries(spark, sf_dir), t.encoded_documents(spark, sf_dir), k=10, dim=DIM
    )
    return _shown(found)


@_query
def search_vectors(spark, sf_dir):
    """Every given vector as a query on all of them, the queries in several blocks."""
    rows = t.vectors(spark, sf_dir)
    asked = rows.withColumnRenamed("row_id", "query_id")
    found = search_op.search_exact(asked, rows, k=5, dim=DIM, query_bytes=64 * 1024)
    return _rounded(found.select("query_id", "rank", "row_id", "similarity"), "similarity")


def _shown(found: DataFrame) -> DataFrame:
    columns = ("query_id", "rank", "row_id", "item_id", "title", "similarity")
    return _rounded(found.select(*columns), "similarity")


@_query
def fetch_documents(spark, sf_dir):
    corpus = t.encoded_documents(spark, sf_dir)
    found = search_op.search_exact(t.text_queries(spark, sf_dir), corpus, k=5, dim=DIM)
    shown = documents_op.fetch_documents(found, corpus)
    return shown.select("query_id", "rank", "item_id", "body", "preview")


@_query
def lsh_search(spark, sf_dir):
    """Through an index that holds ids only, joined to the corpus."""
    found = search_op.lsh_search(
        t.text_queries(spark, sf_dir),
        t.document_index(spark, sf_dir),
        t.encoded_documents(spark, sf_dir),
        k=10,
        dim=DIM,
    )
    return _shown(found)


@_query
def density_search(spark, sf_dir):
    """Through a stored index, which is read for its sizes first and then for its rows."""
    index = t.stored_documents(spark, sf_dir)
    return _shown(search_op.density_search(t.text_queries(spark, sf_dir), index, dim=DIM))


@_query
def search_strategy(spark, sf_dir):
    return _strategy_rows(spark, sf_dir, t.document_index(spark, sf_dir))


@_query
def manifest_strategy(spark, sf_dir):
    """The same without a look at the index."""
    return _strategy_rows(spark, sf_dir, t.documents_with_manifest(spark, sf_dir)[1])


def _strategy_rows(spark, sf_dir, index: DataFrame) -> DataFrame:
    plan = search_op.search_strategy(t.text_queries(spark, sf_dir), index, dim=DIM)
    maybe = ["bucket_size", "original_candidates", "level_1_hash", "refined_candidates", "final_candidates"]
    return _rounded(plan, "reduction_pct").withColumns({c: F.col(c).cast("double") for c in maybe})


@_query
def multi_probe_search(spark, sf_dir):
    index = t.stored_documents(spark, sf_dir)
    return _shown(search_op.multi_probe_search(t.text_queries(spark, sf_dir), index, dim=DIM))


@_query
def multi_probe_stats(spark, sf_dir):
    return _probe_stats(spark, sf_dir, t.document_index(spark, sf_dir))


@_query
def manifest_probe_stats(spark, sf_dir):
    """The same without a look at the index."""
    return _probe_stats(spark, sf_dir, t.documents_with_manifest(spark, sf_dir)[1])


def _probe_stats(spark, sf_dir, index: DataFrame) -> DataFrame:
    stats = search_op.multi_probe_stats(t.text_queries(spark, sf_dir), index, dim=DIM)
    return _rounded(stats, "pct_candidates", "speedup")


@_query
def candidates(spark, sf_dir):
    found = search_op.candidates(
        t.text_queries(spark, sf_dir), t.document_index(spark, sf_dir), dim=DIM
    )
    return found.select("query_id", "row_id")


@_query
def refine_candidates(spark, sf_dir):
    found = search_op.refine_candidates(
        t.text_queries(spark, sf_dir), t.document_index(spark, sf_dir), dim=DIM
    )
    return found.select("query_id", "row_id")


@_query
def multi_probe_candidates(spark, sf_dir):
    found = search_op.multi_probe_candidates(
        t.text_queries(spark, sf_dir), t.document_index(spark, sf_dir), dim=DIM
    )
    return found.select("query_id", "row_id")


@_query
def recall_at_k(spark, sf_dir):
    """Recall of the three approximate searches."""
    asked = t.text_queries(spark, sf_dir)
    index, manifest = t.documents_with_manifest(spark, sf_dir)
    exact = search_op.search_exact(asked, index, k=5, dim=DIM)
    found = {
        "bucket": search_op.lsh_search(asked, index, k=5, dim=DIM, manifest=manifest),
        "density": search_op.density_search(asked, index, k=5, dim=DIM, manifest=manifest),
        "probes": search_op.multi_probe_search(asked, index, k=5, dim=DIM, manifest=manifest),
    }
    rows = [
        search_op.recall_at_k(approx, exact, 5).select(F.lit(mode).alias("mode"), "query_id", "recall")
        for mode, approx in found.items()
    ]
    return _rounded(reduce(DataFrame.unionByName, rows), "recall")


@_query
def narrow_search(spark, sf_dir):
    """An index of 10 bits searched at 8."""
    index = t.document_index(spark, sf_dir, bits=10, carry=("embedding", "item_id", "title"))
    return _shown(search_op.lsh_search(t.text_queries(spark, sf_dir), index, k=10, dim=DIM))


@_query
def density_search_ids(spark, sf_dir):
    """Through an index of 10-bit ids alone: the entries of the queries' buckets are hashed again from the corpus."""
    ids = t.document_index(spark, sf_dir, bits=10).select("bucket_id", "file_path", "row_id")
    found = search_op.density_search(
        t.text_queries(spark, sf_dir), ids, t.encoded_documents(spark, sf_dir), dim=DIM, index_bits=10
    )
    return _shown(found)


@_query
def found_texts(spark, sf_dir):
    """Texts in, results out."""
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _shown(search_text(asked, TokenHashEncoder(DIM), t.stored_documents(spark, sf_dir)).results)


@_query
def documents_by_id(spark, sf_dir):
    """The documents that the benchmark's numbers name."""
    found = documents_op.documents_by_id(t.documents(spark, sf_dir), t.table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "title")


# Labels and themes


def _items(spark, sf_dir) -> DataFrame:
    """The items that labels are made from, for all buckets: every document under its own vector."""
    index, corpus = t.document_index(spark, sf_dir), t.documents(spark, sf_dir)
    return items_op.sample_bucket_items(index, corpus, None, 10)


@_query
def keyword_counts(spark, sf_dir):
    counts = labels_op.keyword_counts(_items(spark, sf_dir), KEYWORDS_FOUND)
    return counts.select("bucket_id", "keyword", "n")


@_query
def theme_labels(spark, sf_dir):
    return labels_op.theme_labels(_items(spark, sf_dir), KEYWORDS_FOUND)


@_query
def theme_labels_word_parts(spark, sf_dir):
    return labels_op.theme_labels(_items(spark, sf_dir), WORD_PARTS)


@_query
def theme_labels_default(spark, sf_dir):
    return labels_op.theme_labels(_items(spark, sf_dir))


@_query
def label_samples(spark, sf_dir):
    return labels_op.label_samples(_items(spark, sf_dir))


def _raw_labels(spark, sf_dir) -> DataFrame:
    """Passages in the role of labels written elsewhere, dressed up the way such labels come."""
    raw = F.concat(F.lit('  **"'), F.col("text"), F.lit('"** \n'))
    return t.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("bucket_id"), raw.alias("raw_label")
    )


@_query
def clean_labels(spark, sf_dir):
    return labels_op.clean_labels(_raw_labels(spark, sf_dir))


@_query
def coalesce_labels(spark, sf_dir):
    given = labels_op.clean_labels(_raw_labels(spark, sf_dir))
    return labels_op.coalesce_labels(given, labels_op.theme_labels(_items(spark, sf_dir), WORD_PARTS))


@_query
def label_buckets(spark, sf_dir):
    """All buckets, of which only those with a passage of their id have a label of their own."""
    sizes = index_op.dense_buckets(t.vector_index(spark, sf_dir), min_count=1)
    return labels_op.label_buckets(sizes, labels_op.clean_labels(_raw_labels(spark, sf_dir)))


def _similar(threshold: float) -> Query:
    def query(spark, sf_dir):
        labels = labels_op.theme_labels(_items(spark, sf_dir), WORD_PARTS)
        return _rounded(labels_op.similar_labels(labels, threshold), "jaccard")

    return query


for _name, _threshold in (("03", 0.3), ("05", 0.5), ("10", 1.0)):
    _ALL[f"similar_labels_{_name}"] = _similar(_threshold)


@_query
def label_token_sets(spark, sf_dir):
    words = F.sort_array(label_tokens("text"))
    return t.table(spark, sf_dir, "benchmark").select("item_id", _joined(words).alias("tokens"))


@_query
def group_labels(spark, sf_dir):
    """Labels of all buckets, ranked by bucket."""
    labels = labels_op.theme_labels(_items(spark, sf_dir), WORD_PARTS)
    ranked = labels.groupBy("label").agg(F.min("bucket_id").alias("rank"))
    return labels_op.group_labels(ranked, 0.5)


def _url_labels(spark, sf_dir) -> DataFrame:
    """Page addresses in the role of labels: many, and with words that most of them share."""
    return t.table(spark, sf_dir, "pages").select(F.col("url").alias("label"), F.col("page_id").alias("rank"))


@_query
def group_many_labels(spark, sf_dir):
    """More labels than one block holds."""
    return labels_op.group_labels(_url_labels(spark, sf_dir), 0.5, small=False, block=64)


@_query
def similar_many_labels(spark, sf_dir):
    return _rounded(labels_op.similar_labels(_url_labels(spark, sf_dir), 0.6), "jaccard")


def _themes(lexicon: tuple[str, ...], threshold: float) -> Query:
    def query(spark, sf_dir):
        found = discover_themes(
            t.document_index(spark, sf_dir),
            t.documents(spark, sf_dir),
            lexicon=lexicon,
            threshold=threshold,
        )
        pair = F.transform(
            "buckets",
            lambda b: F.concat(b["bucket_id"].cast("string"), F.lit(":"), b["count"].cast("string")),
        )
        return found.themes.select(
            "label",
            _joined("original_labels", "|").alias("original_labels"),
            F.array_join(pair, ",").alias("buckets"),
            "total_count",
            "n_items",
            "is_merged",
            "bucket_summary",
        )

    return query


for _name, _lexicon, _threshold in (
    ("merge_themes_03", KEYWORDS_FOUND, 0.3),
    ("merge_themes_05", KEYWORDS_FOUND, 0.5),
    ("merge_themes_10", KEYWORDS_FOUND, 1.0),
    ("merge_themes_word_parts", WORD_PARTS, 1.0),
    ("merge_themes_default", labels_op.KEYWORDS, 0.3),
):
    _ALL[_name] = _themes(_lexicon, _threshold)


@_query
def theme_samples(spark, sf_dir):
    index, corpus = t.document_index(spark, sf_dir), t.documents(spark, sf_dir)
    found = discover_themes(index, corpus, lexicon=KEYWORDS_FOUND)
    entries = items_op.present_entries(index, corpus, found.buckets, bits=8)
    samples = themes_op.theme_samples(found.themes, entries, corpus=corpus)
    return samples.select("label", "pos", "bucket_id", "row_id", "display_text", "more_items")


# Models and maps


def _metadata(spark, sf_dir) -> DataFrame:
    models = [
        models_op.ModelIndex("words-16", "Smallest - 16 slots", t.document_index(spark, sf_dir, 16)),
        models_op.ModelIndex("words-32", "Balanced - 32 slots", t.document_index(spark, sf_dir, 32)),
        models_op.ModelIndex("words-64", "Finest", t.document_index(spark, sf_dir, 64, bits=10)),
        models_op.ModelIndex("given", "As given - 64 slots", t.vector_index(spark, sf_dir, bits=10)),
    ]
    path = scratch_path(spark, "metadata")
    write_metadata(models_op.build_metadata(models, capacity=256), path)
    return read_metadata(spark, path)


@_query
def model_metadata(spark, sf_dir):
    return _rounded(_metadata(spark, sf_dir), "load_factor")


@_query
def loaded_model(spark, sf_dir):
    """A model's files written to a catalog, loaded from it, and its dense buckets."""
    catalog = DatasetCatalog({"docs": scratch_path(spark, "catalog")})
    t.encoded_documents(spark, sf_dir).write.parquet(catalog.corpus_path("docs", "words-64"))
    shape = CorpusShape(item_id="item_id", title="title", body="body", row_id="row_id")
    index_model(spark, catalog, "docs", "words-64", DIM, shape=shape)
    return load_model(spark, catalog, "docs", "words-64", shape).dense


@_query
def principal_axes(spark, sf_dir):
    """The vectors along their principal axes: each axis holds at least the variance of the next."""
    rows = t.vectors(spark, sf_dir)
    placed = rows.select(project("embedding", maps_op.principal_axes(rows, DIM)).alias("at"))
    spread = placed.agg(*[F.var_pop(f"at.{c}").alias(c) for c in "xyz"])
    return spread.select((F.col("x") >= F.col("y")).alias("x_first"), (F.col("y") >= F.col("z")).alias("y_next"))


@_query
def compare_models(spark, sf_dir):
    return _rounded(models_op.compare_models(_metadata(spark, sf_dir)), "load_factor")


@_query
def model_info(spark, sf_dir):
    return _rounded(models_op.model_info(_metadata(spark, sf_dir), "words-64"), "load_factor")


@_query
def model_options(spark, sf_dir):
    options = models_op.model_options(_metadata(spark, sf_dir))
    return options.select("option", models_op.chosen_model("option").alias("model_name"))


def _points(spark, sf_dir) -> DataFrame:
    corpus = t.vectors(spark, sf_dir).join(t.documents(spark, sf_dir), "row_id", "left")
    return maps_op.map_points(corpus, t.vector_index(spark, sf_dir), dim=DIM)


@_query
def map_points(spark, sf_dir):
    return _rounded(_points(spark, sf_dir), "x", "y", "z")


@_query
def stored_map_points(spark, sf_dir):
    """Points read from a file, and from one that is not there."""
    path = scratch_path(spark, "points")
    _points(spark, sf_dir).write.parquet(path)
    points = read_map_points(spark, path).unionByName(read_map_points(spark, path + "-missing"))
    return _rounded(points, "x", "y", "z")


def _map_points(spark, sf_dir) -> DataFrame:
    """Map points of all documents, which are encoded once: the index carries what the map shows."""
    stored = t.document_index(spark, sf_dir, carry=("embedding", "display_text"))
    return maps_op.map_points(stored, stored, dim=DIM)


@_query
def map_density(spark, sf_dir):
    points = _map_points(spark, sf_dir)
    return _rounded(maps_op.map_density(points), "avg_size", "pct_dense")


@_query
def map_density_sketch(spark, sf_dir):
    """The same from tiles of the map; the number of buckets within three standard errors."""
    tiles = maps_op.map_tiles(_map_points(spark, sf_dir))
    later = tiles.where("tile_x % 2 = 0"), tiles.where("tile_x % 2 <> 0")  # as if they had come apart
    found = _rounded(maps_op.density_of_tiles(later[0].unionByName(later[1])), "avg_size", "pct_dense")
    exact = t.document_index(spark, sf_dir).agg(F.count_distinct("bucket_id")).scalar()
    near = F.abs(F.col("unique_buckets") - exact) <= 3 * maps_op.sketch_error() * exact
    return found.withColumn("unique_buckets", near)


@_query
def probe_classes(spark, sf_dir):
    points = _map_points(spark, sf_dir)
    classes = maps_op.probe_classes(points, t.text_queries(spark, sf_dir), dim=DIM)
    return classes.select("query_id", "row_id", "probe_class")


# Streams


def _vector_stream(spark, sf_dir) -> DataFrame:
    schema = t.table(spark, sf_dir, "embeddings").schema
    # As a pattern, the path may be a file or a folder of files; a stream takes a plain path for a folder.
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.[p]arquet")
    return files.select(F.col("vec_id").alias("row_id"), "embedding")


@_query
def streamed_index(spark, sf_dir):
    """The index written by a stream, then read as a table."""
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    append_index(stream_index(_vector_stream(spark, sf_dir), DIM), path, state).awaitTermination()
    return read_index(spark, path).select("bucket_id", "hash", "row_id")


@_query
def stream_counts(spark, sf_dir):
    """Bucket sizes kept by a stream and written to files with every batch; the last batch has them all."""
    counts = stream_bucket_counts(stream_index(_vector_stream(spark, sf_dir), DIM))
    path, state = scratch_path(spark, "counts"), scratch_path(spark, "state")
    write_bucket_counts(counts, path, state).awaitTermination()
    return read_bucket_counts(spark, path)


# Reports


@_query
def model_report(spark, sf_dir):
    return reports_op.model_report(_metadata(spark, sf_dir))


@_query
def search_report(spark, sf_dir):
    index = t.document_index(spark, sf_dir)
    plan = search_op.search_strategy(t.text_queries(spark, sf_dir), index, dim=DIM)
    return reports_op.search_report(plan)


@_query
def probe_report(spark, sf_dir):
    stats = search_op.multi_probe_stats(
        t.text_queries(spark, sf_dir), t.document_index(spark, sf_dir), dim=DIM
    )
    return reports_op.probe_report(stats)


@_query
def map_report(spark, sf_dir):
    points = _map_points(spark, sf_dir)
    return reports_op.map_report(maps_op.map_density(points))
