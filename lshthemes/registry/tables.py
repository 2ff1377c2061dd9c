"""The given tables in the roles of the data model. Every role takes the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lshthemes.functions.encoders import TokenHashEncoder, encode
from lshthemes.operators.index import build_index
from lshthemes.sources.corpora import CorpusShape, canonical
from lshthemes.sources.indexes import read_index, write_index
from lshthemes.sources.manifest import read_manifest
from lshthemes.sources.scratch import scratch_path

DIM = 64

# Keywords that occur in the given documents, and parts of words that are common in them.
KEYWORDS_FOUND = (
    "license", "copyright", "@", "http", "phone", "email", "tel", "password", "key", "token", "secret",
)
WORD_PARTS = ("ight", "ough", "heit", "eaux", "ción", "keit", "able", "ment", "ness", "est")

# What a search shows of a document, with the vector it is found by.
SHOWN = ("embedding", "item_id", "title")

AS_TWEETS = CorpusShape(item_id="doc_id", body="text", row_id="doc_id")
AS_PAPERS = CorpusShape(
    item_id="doc_id",
    title="source",
    body="text",
    category="lang",
    preview_limit=500,
    row_id="doc_id",
)
AS_POSTS = CorpusShape(
    item_id="doc_id",
    title="source",
    body="text",
    category="lang",
    score="n_chars",
    author="source",
    row_id="doc_id",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given embeddings as ``(row_id, embedding)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding"
    )


def vector_index(spark: SparkSession, sf_dir: str, bits: int = 8) -> DataFrame:
    return build_index(vectors(spark, sf_dir), bits=bits, dim=DIM, file_path="embeddings")


def documents(
    spark: SparkSession, sf_dir: str, shape: CorpusShape = AS_TWEETS
) -> DataFrame:
    return canonical(table(spark, sf_dir, "documents"), shape)


def encoded_documents(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    texts = canonical(table(spark, sf_dir, "documents"), AS_TWEETS)
    return encode(texts, "body", TokenHashEncoder(dim))


def document_index(
    spark: SparkSession, sf_dir: str, dim: int = DIM, bits: int = 8, carry: tuple = ()
) -> DataFrame:
    """Every document filed under its own vector, in files: encoded once however often it is read."""
    corpus = encoded_documents(spark, sf_dir, dim)
    path = scratch_path(spark, "index")
    write_index(build_index(corpus, bits=bits, dim=dim, carry=carry, file_path="documents"), path)
    return read_index(spark, path)


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what a search shows, so that it needs no corpus beside it."""
    return document_index(spark, sf_dir, carry=SHOWN)


def documents_with_manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same, and its manifest."""
    path = scratch_path(spark, "index")
    index = build_index(encoded_documents(spark, sf_dir), bits=8, dim=DIM, carry=SHOWN, file_path="documents")
    write_index(index, path, manifest=True)
    return read_index(spark, path), read_manifest(spark, path)


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as ``(query_id, embedding)``."""
    passages = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return encode(passages, "text", TokenHashEncoder(DIM)).select("query_id", "embedding")
