"""Loading a model's files and writing them."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from lshthemes.functions.hashing import BASE_BITS, SEED
from lshthemes.operators.index import build_index, dense_buckets, index_stats
from lshthemes.sources.corpora import CorpusShape, DatasetCatalog, load_corpus
from lshthemes.sources.indexes import read_index, write_index
from lshthemes.sources.manifest import read_manifest


@dataclass(frozen=True)
class LoadedModel:
    corpus: DataFrame
    index: DataFrame
    stats: DataFrame
    dense: DataFrame
    manifest: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give up what was persisted; the tables stay readable."""
        for table in self.held:
            table.unpersist()


def load_model(
    spark: SparkSession,
    catalog: DatasetCatalog,
    dataset: str,
    model: str,
    shape: CorpusShape | None = None,
    min_count: int = 5,
    persist: bool = False,
    with_manifest: bool = False,
) -> LoadedModel:
    """Corpus, index, index statistics and dense buckets of one model on one dataset.

    Nothing is read until the tables are used. With ``persist`` corpus and index are then kept until ``release``. With
    ``with_manifest`` statistics and dense buckets come from the manifest of the index, which must be there.
    """
    path = catalog.index_path(dataset, model)
    index = read_index(spark, path)
    corpus = load_corpus(spark, catalog.corpus_path(dataset, model), shape)
    if persist:
        index, corpus = (table.persist(StorageLevel.MEMORY_AND_DISK) for table in (index, corpus))
    manifest = read_manifest(spark, path) if with_manifest else None
    counted = index if manifest is None else manifest
    return LoadedModel(
        corpus=corpus,
        index=index,
        stats=index_stats(counted),
        dense=dense_buckets(counted, min_count),
        manifest=manifest,
        held=(index, corpus) if persist else (),
    )


class LoadedModels:
    """Models of a catalog, each loaded once however often it is asked for. The block of ``with`` releases them."""

    def __init__(self, spark: SparkSession, catalog: DatasetCatalog, shape: CorpusShape | None = None, min_count: int = 5) -> None:
        self._load = functools.partial(load_model, spark, catalog, shape=shape, min_count=min_count, persist=True)
        self._loaded: dict[tuple[str, str], LoadedModel] = {}

    def get(self, dataset: str, model: str) -> LoadedModel:
        if (dataset, model) not in self._loaded:
            self._loaded[dataset, model] = self._load(dataset, model)
        return self._loaded[dataset, model]

    def release(self) -> None:
        for model in self._loaded.values():
            model.release()
        self._loaded.clear()

    def __enter__(self) -> LoadedModels:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def index_model(
    spark: SparkSession,
    catalog: DatasetCatalog,
    dataset: str,
    model: str,
    dim: int,
    bits: int = BASE_BITS,
    seed: int = SEED,
    carry: Sequence[str] = ("embedding", "item_id", "title"),
    shape: CorpusShape | None = None,
    mode: str = "errorifexists",
    manifest: bool = False,
) -> DataFrame:
    """Build and write the index of one model, and return it as stored."""
    corpus = load_corpus(spark, catalog.corpus_path(dataset, model), shape)
    path = catalog.index_path(dataset, model)
    write_index(build_index(corpus, bits, seed, dim, carry), path, mode, manifest)
    return read_index(spark, path)
