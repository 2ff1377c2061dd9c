"""Searching for texts, with a report of how each search went."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from lshthemes.functions.encoders import encode
from lshthemes.operators.search import density_search, search_strategy


@dataclass(frozen=True)
class SearchReport:
    """Results and strategy of a search. What was persisted for both is released on leaving a ``with`` block, or by
    ``release``; both tables stay readable and are then computed again."""

    results: DataFrame
    strategy: DataFrame
    held: DataFrame | None = None

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()

    def __enter__(self) -> SearchReport:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def search_by_density(
    queries: DataFrame,
    index: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 5,
    threshold: int = 10,
    dim: int | None = None,
    manifest: DataFrame | None = None,
) -> SearchReport:
    """Results of the density-aware search and the strategy it took, for queries that have vectors."""
    known = index if manifest is None else manifest
    return SearchReport(
        density_search(queries, index, corpus, k, threshold, dim=dim, manifest=manifest),
        search_strategy(queries, known, threshold, dim=dim),
    )


def search_text(
    texts: DataFrame,
    encoder,
    index: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 5,
    threshold: int = 10,
    persist: bool = False,
    manifest: DataFrame | None = None,
) -> SearchReport:
    """The same for ``(query_id, text)``, encoded with the model of the index. With ``persist`` they are encoded once for
    both tables, and the vectors are kept until the report is released."""
    queries = encode(texts, "text", encoder)
    if persist:
        queries = queries.persist(StorageLevel.MEMORY_AND_DISK)
    report = search_by_density(queries, index, corpus, k, threshold, encoder.dim, manifest)
    return replace(report, held=queries) if persist else report
