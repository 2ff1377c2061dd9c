"""The index fed by a stream."""

from lshthemes.streaming.index_stream import (
    append_index,
    compact_bucket_counts,
    read_bucket_counts,
    stream_bucket_counts,
    stream_index,
    write_bucket_counts,
)

__all__ = [
    "append_index",
    "compact_bucket_counts",
    "read_bucket_counts",
    "stream_bucket_counts",
    "stream_index",
    "write_bucket_counts",
]
