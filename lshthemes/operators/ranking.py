"""Top-k scoring of many queries in one pass over the rows.

The queries of one pass are bounded in bytes and sent to every task; the rows are never shuffled and no
(query, row) pair leaves a task unless it is among the best ``k`` of that task. More queries than fit in
one pass lie in files by block; a task goes through the blocks for each chunk of its rows, in the same job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lshthemes.functions.vectors import batch_matrix
from lshthemes.sources.files import locate
from lshthemes.sources.scratch import scratch_path

# Bytes of query vectors that one pass may send to every task.
QUERY_BYTES = 32 << 20

# Similarities are compared at this many digits, so float noise cannot order true ties.
RANK_DIGITS = 9

# Wide enough that no pair equal in the digits that rank is sorted out.
MARGIN = 1e-8

# A pair whose similarity is undefined ranks below every cosine.
UNDEFINED = -2.0

# Scores held at once inside a task.
TILE = 1 << 21

# Rows a task holds while it goes through several blocks of queries.
CHUNK_BYTES = 64 << 20


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and the lengths; NaN marks a row without direction."""
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(matrix, axis=1)
        norms[~np.isfinite(norms) | (norms == 0)] = np.nan
        units = matrix / norms[:, None]
    units[np.isnan(norms)] = 0.0
    return units, norms


class QueryBlock:
    """The queries of one pass inside a task: vectors, and which row groups each one looks at."""

    def __init__(
        self, vectors: np.ndarray, routes: dict[int, np.ndarray] | None, levels: np.ndarray
    ):
        self.vectors, self.routes, self.levels = vectors, routes, levels
        self.units, self.norms = unit_rows(vectors)


def packed_queries(rows: Sequence[Row]) -> tuple:
    """What every task needs of the queries, as plain arrays: vectors, routes, levels and ids."""
    vectors = np.array([r["embedding"] for r in rows], dtype=np.float64)
    routes: dict[int, list[int]] | None = None
    if "buckets" in rows[0]:
        routes = {}
        for i, row in enumerate(rows):
            for bucket in row["buckets"]:
                routes.setdefault(bucket, []).append(i)
    levels = [r["only_level"] if "only_level" in r else None for r in rows]
    return (
        vectors,
        routes and {b: np.array(q) for b, q in routes.items()},
        np.array([-1 if v is None else v for v in levels], dtype=np.int64),
        [r["query_id"] for r in rows],
    )


class Best:
    """Running top-k of every query inside one task."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.cut = np.full(n_queries, -np.inf)
        self.rows: pa.Table | None = None

    def offer(self, found: pa.Table) -> None:
        """``found`` has the columns query, similarity, row_id (and file_path), then what is carried."""
        table = found if self.rows is None else pa.concat_tables([self.rows, found])
        query = table["query"].to_numpy()
        key = np.round(table["similarity"].to_numpy(), RANK_DIGITS)
        ties = [table["row_id"].to_numpy()]
        if "file_path" in table.column_names:
            paths = table["file_path"].to_pandas().fillna("")
            ties.append(np.unique(paths, return_inverse=True)[1])
        order = np.lexsort((*ties, -key, query))
        starts = np.searchsorted(query[order], query[order], side="left")
        place = np.arange(len(order)) - starts
        self.rows = table.take(order[place < self.k]).combine_chunks()
        last = order[place == self.k - 1]
        self.cut[query[last]] = key[last]


def _groups(
    batch: pa.RecordBatch, fits: np.ndarray, block: QueryBlock
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of one batch with the queries that look at them."""
    if block.routes is None:
        return [(np.arange(fits.sum()), np.arange(len(block.vectors)))]
    bucket = batch.column("bucket_id").to_numpy(zero_copy_only=False)[fits]
    order = np.argsort(bucket, kind="stable")
    ids, starts = np.unique(bucket[order], return_index=True)
    members = np.split(order, starts[1:])
    return [(m, block.routes[b]) for b, m in zip(ids, members) if b in block.routes]


def _pairs(
    batch: pa.RecordBatch, dim: int, block: QueryBlock, best: Best
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, query and score of the pairs of one batch that may still be among the best.

    Unit vectors sort out the pairs, with a margin over the digits that rank; only those left are scored.
    """
    x, fits = batch_matrix(batch.column("embedding"), dim)
    if not len(x):
        return
    position = np.flatnonzero(fits)
    units, norms = unit_rows(x)
    level = None
    if "level1" in batch.schema.names:
        level = batch.column("level1").to_numpy(zero_copy_only=False)[fits]
    for rows, queries in _groups(batch, fits, block):
        step = max(1, TILE // len(rows))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            near = block.units[q] @ units[rows].T
            near[:, np.isnan(norms[rows])] = UNDEFINED
            near[np.isnan(block.norms[q])] = UNDEFINED
            if level is not None:
                wanted = block.levels[q][:, None]
                near[(wanted >= 0) & (wanted != level[rows][None, :])] = -np.inf
            hits = near >= best.cut[q][:, None] - MARGIN
            if len(rows) > best.k and np.count_nonzero(hits) > 4 * best.k * len(q):
                nth = len(rows) - best.k
                hits &= near >= np.partition(near, nth, axis=1)[:, nth][:, None] - MARGIN
            j, i = np.nonzero(hits & (near > -np.inf))
            i, j = rows[i], q[j]
            with np.errstate(all="ignore"):
                scores = np.einsum("ij,ij->i", x[i], block.vectors[j]) / (norms[i] * block.norms[j])
            yield position[i], j, np.where(np.isfinite(scores), scores, UNDEFINED)


def _rank_partition(
    batches: Iterator[pa.RecordBatch],
    dim: int,
    k: int,
    block: QueryBlock,
    ids: pa.Array,
    kept: list[str],
) -> Iterator[pa.RecordBatch]:
    best = Best(len(ids), k)
    for batch in batches:
        held, size = [], 0
        for found in _pairs(batch, dim, block, best):
            held.append(found)
            size += len(found[0])
            if size >= TILE:
                best.offer(_table(batch, kept, held))
                held, size = [], 0
        if size:
            best.offer(_table(batch, kept, held))
    if best.rows is None:
        return
    rows = best.rows
    similarity = rows["similarity"].to_numpy()
    columns = {
        "query_id": ids.take(pa.array(rows["query"].to_numpy())),
        "similarity": pa.array(similarity, mask=similarity <= UNDEFINED),
        **{c: rows[c] for c in kept},
    }
    yield from pa.table(columns).to_batches()


def _table(batch: pa.RecordBatch, kept: list[str], held: list[tuple]) -> pa.Table:
    rows, queries, scores = (np.concatenate(part) for part in zip(*held))
    columns = {"query": pa.array(queries, pa.int64()), "similarity": pa.array(scores)}
    taken = pa.Table.from_batches([batch.select(kept)]).take(rows)
    return pa.table(columns | {c: taken[c] for c in kept})


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of every query by ``similarity``, in ``rank``; undefined ones come last."""
    ties = [c for c in ("file_path", "row_id") if c in scored.columns]
    order = Window.partitionBy("query_id").orderBy(
        F.round("similarity", RANK_DIGITS).desc_nulls_last(), *ties
    )
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def _found_schema(rows: DataFrame, id_type: T.DataType, kept: list[str]) -> T.StructType:
    fields = [T.StructField("query_id", id_type), T.StructField("similarity", T.DoubleType())]
    return T.StructType([*fields, *[rows.schema[c] for c in kept]])


def _one_pass(
    rows: DataFrame,
    block: Sequence[Row],
    id_type: T.DataType,
    dim: int,
    k: int,
    kept: list[str],
    stored_bits: int | None,
) -> DataFrame:
    """Scores one block of queries against the rows."""
    spark = rows.sparkSession
    needed = [c for c in ("embedding", "bucket_id", "level1") if c in rows.columns]
    schema = _found_schema(rows, id_type, kept)
    if not block:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(packed_queries(block))
    id_arrow = pa.string() if isinstance(id_type, T.StringType) else pa.int64()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *queries, ids = shared.value
        return _rank_partition(batches, dim, k, QueryBlock(*queries), pa.array(ids, id_arrow), kept)

    routed = rows
    if "bucket_id" in needed and "buckets" in block[0]:
        buckets = sorted({b for r in block for b in r["buckets"]})
        if stored_bits is not None:
            # On stored columns only, so it reaches the scan and skips row groups of other buckets.
            stored = F.col("stored_bucket").between(buckets[0], buckets[-1])
            routed = routed.where((F.col("bits") != stored_bits) | stored)
        # No more ids than the block's queries probe, and the block is bounded.
        probed = spark.createDataFrame(pa.table({"bucket_id": pa.array(buckets, pa.int64())}))
        routed = routed.join(F.broadcast(probed), "bucket_id", "left_semi")
    return routed.select(*dict.fromkeys([*needed, *kept])).mapInArrow(rank, schema)


def rank_rows(
    rows: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int,
    payload: Sequence[str] = ("item_id", "title"),
    query_bytes: int = QUERY_BYTES,
    stored_bits: int | None = None,
) -> DataFrame:
    """The ``k`` most similar rows of every query.

    ``queries`` has ``query_id`` (unique, else this raises), ``embedding`` and optionally ``buckets``, the ids whose rows the
    query looks at, and ``only_level``, the ``level1`` those rows must have. ``rows`` has ``row_id``,
    ``embedding`` and the matching ``bucket_id`` and ``level1``. With ``stored_bits`` they also have ``bits``
    and ``stored_bucket`` as the index stores them, which equals ``bucket_id`` where the bits agree.
    """
    if isinstance(queries.schema["query_id"].dataType, T.StringType):
        id_type = T.StringType()
    else:
        id_type = T.LongType()
        queries = queries.withColumn("query_id", F.col("query_id").cast("bigint"))
    carried = ["row_id", *[c for c in ("file_path",) if c in rows.columns]]
    carried += [c for c in payload if c in rows.columns and c not in carried]
    usable = queries.where(F.size("embedding") == dim)
    probes = F.size("buckets") if "buckets" in queries.columns else F.lit(0)
    found = _in_blocks(rows, usable.withColumn("_bytes", 8 * (dim + probes)), id_type, dim, k, carried, stored_bits, query_bytes)
    ranked = top_k(found, k)
    return ranked.select("query_id", "rank", *carried, "similarity")


def _in_blocks(
    rows: DataFrame,
    queries: DataFrame,
    id_type: T.DataType,
    dim: int,
    k: int,
    carried: list[str],
    stored_bits: int | None,
    limit: int,
) -> DataFrame:
    """All queries, however many, in blocks of at most about ``limit`` bytes of vectors and probed ids: a single block is
    sent to every task, several lie in files that tasks read one after the other."""
    spark = rows.sparkSession
    stored = scratch_path(spark, "queries")
    # The encoder and the routing run once, not once per block.
    queries.write.parquet(stored)
    queries = spark.read.parquet(stored)
    if not queries.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("query_id must be unique")
    total = queries.agg(F.sum("_bytes")).first()[0] or 0
    if total <= limit:
        return _one_pass(rows, queries.drop("_bytes").collect(), id_type, dim, k, carried, stored_bits)
    n_blocks = -(-total * 5 // (4 * limit))
    number = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    blocks, results = scratch_path(spark, "query-blocks"), scratch_path(spark, "results")
    parted = queries.drop("_bytes").withColumn("_block", number).repartition("_block")
    parted.write.partitionBy("_block").parquet(blocks)
    _grid(rows, blocks, n_blocks, id_type, dim, k, carried).write.parquet(results)
    return spark.read.parquet(results)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    chunk, size = [], 0
    for batch in batches:
        chunk.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _read_block(folder: str, number: int) -> tuple | None:
    """One block of queries, as every task needs it; none where the block is empty."""
    where, path = locate(f"{folder}/_block={number}")
    listed = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = sorted(f.path for f in listed if f.path.endswith(".parquet"))
    rows = []
    for name in names:
        with where.open_input_file(name) as file:
            rows += pq.read_table(file).to_pylist()
    return packed_queries(rows) if rows else None


def _grid(
    rows: DataFrame, blocks: str, n_blocks: int, id_type: T.DataType, dim: int, k: int, kept: list[str]
) -> DataFrame:
    """Every block of queries against every chunk of rows, in one job: tasks read their rows once, a chunk at a time, and
    the blocks from their files for each chunk. A cell of that grid hands on its best ``k`` rows per query; the top-k
    lists merge in the task and once more where they meet."""
    needed = [c for c in ("embedding", "bucket_id", "level1") if c in rows.columns]
    schema = _found_schema(rows, id_type, kept)
    id_arrow = pa.string() if isinstance(id_type, T.StringType) else pa.int64()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK_BYTES):
            for number in range(n_blocks):
                packed = _read_block(blocks, number)
                if packed is not None:
                    *queries, ids = packed
                    yield from _rank_partition(iter(chunk), dim, k, QueryBlock(*queries), pa.array(ids, id_arrow), kept)

    found = rows.select(*dict.fromkeys([*needed, *kept])).mapInArrow(rank, schema)
    return top_k(found, k).drop("rank")
