"""Operators on indexes, items, queries, labels, themes, maps and models. All take and give DataFrames."""

from lshthemes.operators.documents import documents_by_id, fetch_documents
from lshthemes.operators.index import (
    bucket_size_histogram,
    bucket_sizes,
    build_index,
    dangling_entries,
    dense_buckets,
    density_stats,
    index_health,
    index_stats,
    inverted_lists,
)
from lshthemes.operators.items import (
    bucket_items,
    present_entries,
    sample_bucket_items,
    sample_items,
)
from lshthemes.operators.labels import (
    KEYWORDS,
    clean_labels,
    coalesce_labels,
    group_labels,
    keyword_counts,
    label_buckets,
    label_samples,
    similar_labels,
    theme_labels,
)
from lshthemes.operators.maps import density_of_tiles, map_density, map_points, map_tiles, principal_axes, probe_classes
from lshthemes.operators.models import (
    ModelIndex,
    build_metadata,
    chosen_model,
    compare_models,
    corpus_profile,
    model_info,
    model_options,
)
from lshthemes.operators.ranking import rank_rows, top_k
from lshthemes.operators.reports import map_report, model_report, probe_report, search_report
from lshthemes.operators.search import (
    candidates,
    density_search,
    hash_queries,
    lsh_search,
    multi_probe_candidates,
    multi_probe_search,
    multi_probe_stats,
    recall_at_k,
    refine_candidates,
    search_exact,
    search_strategy,
)
from lshthemes.operators.themes import bucket_summary, merge_themes, theme_buckets, theme_samples

__all__ = [
    "KEYWORDS",
    "ModelIndex",
    "bucket_items",
    "bucket_size_histogram",
    "bucket_sizes",
    "bucket_summary",
    "build_index",
    "build_metadata",
    "candidates",
    "chosen_model",
    "clean_labels",
    "coalesce_labels",
    "compare_models",
    "corpus_profile",
    "dangling_entries",
    "dense_buckets",
    "density_of_tiles",
    "density_search",
    "density_stats",
    "documents_by_id",
    "fetch_documents",
    "group_labels",
    "hash_queries",
    "index_health",
    "index_stats",
    "inverted_lists",
    "keyword_counts",
    "label_buckets",
    "label_samples",
    "lsh_search",
    "map_density",
    "map_points",
    "map_tiles",
    "map_report",
    "merge_themes",
    "model_info",
    "model_options",
    "model_report",
    "multi_probe_candidates",
    "multi_probe_search",
    "multi_probe_stats",
    "present_entries",
    "principal_axes",
    "probe_classes",
    "probe_report",
    "rank_rows",
    "recall_at_k",
    "refine_candidates",
    "sample_bucket_items",
    "sample_items",
    "search_exact",
    "search_report",
    "search_strategy",
    "similar_labels",
    "theme_buckets",
    "theme_labels",
    "theme_samples",
    "top_k",
]
