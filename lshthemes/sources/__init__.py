"""Readers and writers: corpora, indexes, model metadata and map points."""

from lshthemes.sources.corpora import (
    ABSTRACTS,
    POSTS,
    TWEETS,
    CorpusShape,
    DatasetCatalog,
    canonical,
    load_corpus,
    shape_of,
)
from lshthemes.sources.indexes import merge_indexes, read_index, write_index, write_partitions
from lshthemes.sources.manifest import read_manifest, write_manifest
from lshthemes.sources.scratch import scratch_path
from lshthemes.sources.tables import read_map_points, read_metadata, write_metadata

__all__ = [
    "ABSTRACTS",
    "POSTS",
    "TWEETS",
    "CorpusShape",
    "DatasetCatalog",
    "canonical",
    "load_corpus",
    "merge_indexes",
    "read_index",
    "read_manifest",
    "read_map_points",
    "read_metadata",
    "scratch_path",
    "shape_of",
    "write_index",
    "write_manifest",
    "write_metadata",
    "write_partitions",
]
