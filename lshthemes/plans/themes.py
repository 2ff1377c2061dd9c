"""From an index to themes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lshthemes.operators.index import dense_buckets
from lshthemes.operators.items import present_entries, sample_bucket_items
from lshthemes.operators.labels import KEYWORDS, clean_labels, coalesce_labels, theme_labels
from lshthemes.operators.themes import merge_themes
from lshthemes.sources.scratch import use_checkpoints


@dataclass(frozen=True)
class Themes:
    buckets: DataFrame
    labels: DataFrame
    themes: DataFrame


def discover_themes(
    index: DataFrame,
    corpus: DataFrame,
    min_count: int = 5,
    top_n: int = 10,
    lexicon: Sequence[str] = KEYWORDS,
    sample: int = 10,
    threshold: float = 0.5,
    external: DataFrame | None = None,
) -> Themes:
    """Dense buckets, their labels and the merged themes.

    The ``top_n`` dense buckets and their labels are found once and kept. The ids then filter the scan of the index, only
    row ids are shuffled to see which entries exist, and only sampled rows fetch their text. ``external`` may
    bring labels ``(bucket_id, raw_label)``; buckets it leaves out are labelled by keywords.
    """
    use_checkpoints(index.sparkSession)
    buckets = dense_buckets(index, min_count, top_n).checkpoint()
    ids = [row["bucket_id"] for row in buckets.collect()]
    items = sample_bucket_items(index, corpus, ids, sample)
    labels = theme_labels(items, lexicon, sample)
    if external is not None:
        labels = coalesce_labels(clean_labels(external), labels)
    labels = labels.checkpoint()
    present = present_entries(index, corpus, ids)
    return Themes(buckets, labels, merge_themes(buckets, labels, present, threshold, top_n))
