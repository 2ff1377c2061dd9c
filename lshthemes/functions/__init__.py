"""Column-level functions: hashing, vectors, text and encoders."""

from lshthemes.functions.encoders import TokenHashEncoder, encode
from lshthemes.functions.hashing import (
    bucket_hex,
    hash_vectors,
    hyperplanes,
    probe_buckets,
    probe_masks,
    with_buckets,
)
from lshthemes.functions.text import (
    best_label,
    clean_label,
    jaccard,
    label_tokens,
    preview,
    substring_count,
    title_case,
)
from lshthemes.functions.vectors import cosine, project

__all__ = [
    "TokenHashEncoder",
    "best_label",
    "bucket_hex",
    "clean_label",
    "cosine",
    "encode",
    "hash_vectors",
    "hyperplanes",
    "jaccard",
    "label_tokens",
    "preview",
    "probe_buckets",
    "probe_masks",
    "project",
    "substring_count",
    "title_case",
    "with_buckets",
]
