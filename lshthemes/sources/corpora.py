"""Corpora: any dataset with one embedding per row, read into one shape.

Every corpus has ``row_id, item_id, title, body, display_text, preview, category, score, author,
embedding`` and, when several files are read, ``file_path``; together with ``row_id`` it names the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lshthemes.functions.text import headline, preview


@dataclass(frozen=True)
class CorpusShape:
    """Which columns of a dataset hold what. Without ``title`` the start of the body stands in."""

    item_id: str
    body: str
    title: str | None = None
    category: str | None = None
    score: str | None = None
    author: str | None = None
    preview_limit: int | None = None
    embedding: str | None = "embedding"
    row_id: str = "row_id"


# Column names of the three known kinds of dataset.
TWEETS = CorpusShape(item_id="tweet_id", body="text")
ABSTRACTS = CorpusShape(
    item_id="arxiv_id",
    title="title",
    body="abstract",
    category="category_name",
    preview_limit=500,
)
POSTS = CorpusShape(
    item_id="hn_id",
    title="title",
    body="text",
    category="category_name",
    score="score",
    author="by",
)


def shape_of(df: DataFrame) -> CorpusShape:
    """Recognise a dataset by the id column it has, in the order papers, posts, tweets."""
    for shape in (ABSTRACTS, POSTS, TWEETS):
        if shape.item_id in df.columns:
            return shape
    raise ValueError(f"none of the known id columns in {df.columns}")


def canonical(df: DataFrame, shape: CorpusShape | None = None) -> DataFrame:
    """Rename and derive the corpus columns. All of it is projection, so unread columns stay unread."""
    shape = shape or shape_of(df)

    def column(name: str | None, kind: str) -> Column:
        source = F.col(name) if name in df.columns else F.lit(None)
        return source.cast(kind)

    body = F.coalesce(column(shape.body, "string"), F.lit(""))
    if shape.title:
        title = column(shape.title, "string")
        display = headline(title, body)
    else:
        title = F.substring(body, 1, 100)
        display = body
    parts = {
        "row_id": F.col(shape.row_id).cast("bigint"),
        "item_id": column(shape.item_id, "string"),
        "title": title,
        "body": body,
        "display_text": display,
        "preview": preview(body, title, shape.preview_limit),
        "category": column(shape.category, "string"),
        "score": column(shape.score, "bigint"),
        "author": column(shape.author, "string"),
    }
    if shape.embedding in df.columns:
        parts["embedding"] = F.col(shape.embedding)
    if "file_path" in df.columns:
        parts["file_path"] = F.col("file_path")
    return df.select(*[value.alias(name) for name, value in parts.items()])


@dataclass(frozen=True)
class DatasetCatalog:
    """Dataset name to folder; each folder holds the files of all its models."""

    folders: dict[str, str]

    # Names of the files in a folder.
    corpus_file: str = "{model}_embeddings.parquet"
    index_file: str = "{model}_lsh_index.parquet"
    metadata_file: str = "models_metadata.parquet"
    map_file: str = "umap_3d_data_{model}.parquet"

    def folder(self, dataset: str) -> str:
        if dataset not in self.folders:
            raise ValueError(f"Unknown dataset: {dataset}")
        return self.folders[dataset].rstrip("/")

    def corpus_path(self, dataset: str, model: str) -> str:
        return f"{self.folder(dataset)}/{self.corpus_file.format(model=model)}"

    def index_path(self, dataset: str, model: str) -> str:
        return f"{self.folder(dataset)}/{self.index_file.format(model=model)}"

    def metadata_path(self, dataset: str) -> str:
        return f"{self.folder(dataset)}/{self.metadata_file}"

    def map_path(self, dataset: str, model: str) -> str:
        return f"{self.folder(dataset)}/{self.map_file.format(model=model)}"


def load_corpus(spark: SparkSession, path: str, shape: CorpusShape | None = None) -> DataFrame:
    """Read a corpus. Without a stored ``row_id`` a row is named by the path of its file and its position there."""
    df = spark.read.parquet(path)
    shape = shape or shape_of(df)
    if shape.row_id not in df.columns:
        df = df.withColumns(
            {
                shape.row_id: F.col("_metadata.row_index"),
                "file_path": F.col("_metadata.file_path"),
            }
        )
    return canonical(df, shape)

