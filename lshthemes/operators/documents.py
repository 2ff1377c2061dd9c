"""From search results to the documents behind them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.text import preview
from lshthemes.operators.index import identity

def fetch_documents(
    results: DataFrame, corpus: DataFrame, preview_limit: int | None = None
) -> DataFrame:
    """Results with ``body`` and ``preview``. How the two tables meet is left to adaptive execution, which sees their
    sizes; repeat no search for it, but settle costly results first."""
    keys = identity(results, corpus)
    shown = F.col("preview") if "preview" in corpus.columns else preview("body", "title", preview_limit)
    texts = corpus.select(*keys, "body", shown.alias("preview"))
    return texts.join(results, keys).select(*results.columns, "body", "preview")


def documents_by_id(corpus: DataFrame, item_ids: Iterable[str] | DataFrame) -> DataFrame:
    """Documents with the given ids. A few ids become a filter that reaches the scan where the id is stored as text; any
    number of them come as a table with ``item_id``, and stay one."""
    if isinstance(item_ids, DataFrame):
        named = item_ids.select(F.col("item_id").cast("string").alias("item_id"))
        return corpus.join(named, "item_id", "left_semi").select(*corpus.columns)
    return corpus.where(F.col("item_id").isin([str(i) for i in item_ids]))
