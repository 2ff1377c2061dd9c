"""Batch nearest-neighbour search: exact, by bucket, by density and by probing near buckets.

The queries are a table ``(query_id, embedding)``. An index that carries ``embedding`` and the columns to
show needs no corpus. Otherwise the entries of the searched buckets are joined to ``corpus``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lshthemes.functions.hashing import (
    BASE_BITS,
    HASH_BITS,
    REFINE_BITS,
    SEED,
    hash_vectors,
    hyperplanes,
    keyed_by_bucket,
    level_one,
    low_bits,
    probe_buckets,
    probe_list,
    with_buckets,
)
from lshthemes.functions.vectors import infer_dim
from lshthemes.operators.index import bucket_sizes, count_entries, identity
from lshthemes.operators.ranking import QUERY_BYTES, rank_rows
from lshthemes.operators.skew import HOT_ROWS, every_block, hot_keys, own_block, with_blocks
from lshthemes.sources.indexes import SETTINGS, settings_of
from lshthemes.sources.scratch import use_checkpoints

PAYLOAD = ("item_id", "title")


def check_settings(
    index: DataFrame, bits: int, dim: int | None = None, seed: int = SEED, index_bits: int | None = None
) -> None:
    """Raises where an index cannot answer: other seed or width than the queries', rows that differ in their settings,
    or more bits asked for than it stores. One small aggregate over the settings of all rows.

    An index without settings of its own (ids alone) needs ``index_bits``, the width of its ids."""
    if "hash" not in index.columns:
        if index_bits is None:
            raise ValueError("the index does not say how wide its ids are, so index_bits must be given")
        if bits > index_bits:
            raise ValueError(f"{bits} bits are asked for and the index has {index_bits}")
        return
    stored = settings_of(index) if set(SETTINGS) <= set(index.columns) else None
    if stored is None:
        if bits > HASH_BITS:
            raise ValueError(f"{bits} bits are asked for, and the index is not known to store more than {HASH_BITS}")
        return
    if stored["seed"] != seed:
        raise ValueError(f"the index was built with seed {stored['seed']}, not {seed}")
    if dim is not None and stored["dim"] != dim:
        raise ValueError(f"the index holds vectors of {stored['dim']} components, not {dim}")
    if bits > max(stored["bits"], HASH_BITS):
        raise ValueError(f"{bits} bits are asked for and the index stores {max(stored['bits'], HASH_BITS)}")


def hash_queries(
    queries: DataFrame,
    dim: int | None = None,
    base_bits: int = BASE_BITS,
    refine_bits: int = REFINE_BITS,
    seed: int = SEED,
    keep_unfit: bool = False,
) -> DataFrame:
    """Queries with ``hash``, ``bucket_id`` and ``level1``. Vectors that do not fit are left out, or kept with nulls."""
    dim = dim or infer_dim(queries)
    bits = max(HASH_BITS, base_bits + refine_bits)
    hashed = hash_vectors(queries, hyperplanes(dim, bits, seed))
    return with_buckets(hashed if keep_unfit else hashed.where(F.col("hash").isNotNull()), base_bits, refine_bits)


def index_at(index: DataFrame, base_bits: int, refine_bits: int = 0) -> DataFrame:
    """The index with ``bucket_id`` at ``base_bits`` and, if asked for, ``level1``; ``check_settings`` says whether it
    stores as many. The id as stored stays in ``stored_bucket``. Ids without a hash are cut."""
    if "hash" not in index.columns:
        if refine_bits:
            raise ValueError("the index stores no hash, so its buckets cannot be refined without the corpus")
        return index.withColumn("bucket_id", low_bits("bucket_id", base_bits))
    cut = {"bucket_id": low_bits("hash", base_bits), "stored_bucket": F.col("bucket_id")}
    if refine_bits:
        cut["level1"] = level_one("hash", base_bits, refine_bits)
    return index.withColumns(cut)


def hashed_index(
    index: DataFrame,
    corpus: DataFrame | None,
    hashed_queries: DataFrame,
    dim: int,
    base_bits: int,
    refine_bits: int,
    seed: int,
    payload: Sequence[str] = (),
) -> DataFrame:
    """An index of ids alone with the hashes of the entries that the queries can meet: those in their buckets are found
    in the corpus and hashed."""
    if "hash" in index.columns:
        return index
    if corpus is None:
        raise ValueError("the index stores no hash, so its buckets cannot be refined without the corpus")
    wanted = keyed_by_bucket(hashed_queries.select("bucket_id").distinct(), base_bits)
    entries = index_at(index, base_bits).join(wanted, "bucket_id", "left_semi")
    keys = identity(entries, corpus)
    shown = [c for c in payload if c in corpus.columns and c not in keys]
    vectors = entries.join(corpus.select(*keys, "embedding", *shown), keys)
    bits = max(HASH_BITS, base_bits + refine_bits)
    return hash_vectors(vectors, hyperplanes(dim, bits, seed)).where(F.col("hash").isNotNull())


def _rows(
    index: DataFrame,
    corpus: DataFrame | None,
    payload: Sequence[str],
    base_bits: int,
    refine_bits: int = 0,
) -> DataFrame:
    """Index entries with vectors, straight from the index where it carries them."""
    entries = index_at(index, base_bits, refine_bits)
    if "embedding" in entries.columns:
        return entries
    if corpus is None:
        raise ValueError("the index carries no vectors, so the corpus is needed")
    keys = identity(entries, corpus)
    shown = [c for c in payload if c in corpus.columns and c not in keys]
    return entries.join(corpus.select(*keys, "embedding", *shown), keys)


def _ranked(
    routed: DataFrame, rows: DataFrame, dim: int, k: int, payload: Sequence[str], base_bits: int, **kw
) -> DataFrame:
    stored = base_bits if {"bits", "stored_bucket"} <= set(rows.columns) else None
    return rank_rows(rows, routed, dim, k, payload, stored_bits=stored, **kw)


def search_exact(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    dim: int | None = None,
    payload: Sequence[str] = PAYLOAD,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Compare every query with every row."""
    dim = dim or infer_dim(corpus)
    rows = corpus.drop("bucket_id", "level1")
    plain = queries.select("query_id", "embedding")
    return rank_rows(rows, plain, dim, k, payload, query_bytes)


def lsh_search(
    queries: DataFrame,
    index: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 10,
    base_bits: int = BASE_BITS,
    dim: int | None = None,
    payload: Sequence[str] = PAYLOAD,
    seed: int = SEED,
    query_bytes: int = QUERY_BYTES,
    index_bits: int | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Rank the rows of the query's own bucket."""
    dim = dim or infer_dim(queries)
    check_settings(index if manifest is None else manifest, base_bits, dim, seed, index_bits)
    routed = hash_queries(queries, dim, base_bits, seed=seed).select(
        "query_id", "embedding", F.array("bucket_id").alias("buckets")
    )
    rows = _rows(index, corpus, payload, base_bits)
    return _ranked(routed, rows, dim, k, payload, base_bits, query_bytes=query_bytes)


def _strategy(
    hashed: DataFrame, index: DataFrame, threshold: int, base_bits: int, refine_bits: int
) -> DataFrame:
    """Hashed queries with the outcome of the density rule.

    It is decided on one row per bucket: its size and the sizes of its ``level1`` parts, of which the hash
    allows ``2 ** refine_bits``. No candidate row is looked at.
    """
    part = F.struct("level1", "part_size")
    sizes = (
        index_at(index, base_bits, refine_bits)
        .groupBy("bucket_id", "level1")
        .agg(count_entries(index).alias("part_size"))
        .groupBy("bucket_id")
        .agg(
            F.sum("part_size").alias("bucket_size"),
            F.map_from_entries(F.collect_list(part)).alias("parts"),
        )
    )
    joined = hashed.join(keyed_by_bucket(sizes, base_bits + refine_bits), "bucket_id", "left")
    joined = joined.withColumn("part_size", F.try_element_at("parts", F.col("level1")))
    status = (
        F.when(F.col("hash").isNull(), "unfit")
        .when(F.col("bucket_size").isNull(), "empty")
        .when(F.col("bucket_size") >= threshold, "refined")
        .otherwise("sparse")
    )
    refined = F.when(F.col("status") == "refined", F.coalesce("part_size", F.lit(0)))
    fell_back = F.coalesce(F.col("refined_candidates") == 0, F.lit(False))
    return (
        joined.withColumn("status", status)
        .withColumn("refined_candidates", refined.cast("bigint"))
        .withColumn("fell_back", fell_back)
    )


def search_strategy(
    queries: DataFrame,
    index: DataFrame,
    threshold: int = 10,
    base_bits: int = BASE_BITS,
    refine_bits: int = REFINE_BITS,
    dim: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """How ``density_search`` treats each query: empty, sparse or refined, and over how many rows; ``unfit`` where the
    vector does not fit."""
    dim = dim or infer_dim(queries)
    check_settings(index, base_bits + refine_bits, dim, seed)
    hashed = hash_queries(queries, dim, base_bits, refine_bits, seed, keep_unfit=True)
    plan = _strategy(hashed, index, threshold, base_bits, refine_bits)
    refined = F.col("status") == "refined"
    kept = F.col("refined_candidates")
    return plan.select(
        "query_id",
        "bucket_id",
        "status",
        "bucket_size",
        F.col("bucket_size").alias("original_candidates"),
        F.when(refined, F.col("level1")).alias("level_1_hash"),
        "refined_candidates",
        F.when(refined & ~F.col("fell_back"), kept)
        .otherwise(F.col("bucket_size"))
        .alias("final_candidates"),
        "fell_back",
        F.when(refined, (1 - kept / F.col("bucket_size")) * 100).alias("reduction_pct"),
    )


def _only_level() -> Column:
    return F.when((F.col("status") == "refined") & ~F.col("fell_back"), F.col("level1"))


def density_search(
    queries: DataFrame,
    index: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 5,
    threshold: int = 10,
    base_bits: int = BASE_BITS,
    refine_bits: int = REFINE_BITS,
    dim: int | None = None,
    payload: Sequence[str] = PAYLOAD,
    seed: int = SEED,
    query_bytes: int = QUERY_BYTES,
    index_bits: int | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Rank the query's bucket; in a dense one only the rows that share ``level1``, if there are any.

    With the ``manifest`` of the index, settings and densities are taken from that and the index is read for its
    candidates alone."""
    dim = dim or infer_dim(queries)
    refined_bits = 0 if "hash" not in index.columns else refine_bits
    known = index if manifest is None else manifest
    check_settings(known, base_bits + refined_bits, dim, seed, index_bits)
    hashed = hash_queries(queries, dim, base_bits, refine_bits, seed)
    index = hashed_index(index, corpus, hashed, dim, base_bits, refine_bits, seed, payload)
    routed = _strategy(hashed, index if manifest is None else manifest, threshold, base_bits, refine_bits).select(
        "query_id",
        "embedding",
        F.array("bucket_id").alias("buckets"),
        _only_level().alias("only_level"),
    )
    rows = _rows(index, corpus, payload, base_bits, refine_bits)
    return _ranked(routed, rows, dim, k, payload, base_bits, query_bytes=query_bytes)


def multi_probe_search(
    queries: DataFrame,
    index: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 5,
    bits: int = BASE_BITS,
    radius: int = 2,
    dim: int | None = None,
    payload: Sequence[str] = PAYLOAD,
    seed: int = SEED,
    query_bytes: int = QUERY_BYTES,
    index_bits: int | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Rank the rows of all buckets within ``radius`` flipped bits of the query's."""
    dim = dim or infer_dim(queries)
    check_settings(index if manifest is None else manifest, bits, dim, seed, index_bits)
    routed = hash_queries(queries, dim, bits, seed=seed).select(
        "query_id", "embedding", probe_list("bucket_id", bits, radius).alias("buckets")
    )
    rows = _rows(index, corpus, payload, bits)
    return _ranked(routed, rows, dim, k, payload, bits, query_bytes=query_bytes)


def bucket_join(
    keyed: DataFrame, rows: DataFrame, sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Queries ``(query_id, bucket_id, ..)`` to rows ``(bucket_id, row_id, ..)`` of the same bucket.

    Only a hot bucket is cut into blocks, as many as its size asks for, and only its queries are copied to them.
    ``sizes`` of the buckets are counted from the rows unless they are known. Adaptive execution sends the queries to
    the rows where they are few.
    """
    sizes = rows.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("size")) if sizes is None else sizes
    hot = hot_keys(sizes, ["bucket_id"], hot_rows)
    cut = with_blocks(rows, hot, ["bucket_id"]).withColumn("block", own_block(*_identity(rows))).drop("blocks")
    spread = with_blocks(keyed, hot, ["bucket_id"]).withColumn("block", every_block()).drop("blocks")
    return cut.join(spread, ["bucket_id", "block"]).drop("block")


def _identity(index: DataFrame) -> list[str]:
    return [c for c in ("file_path", "row_id") if c in index.columns]


def candidates(
    queries: DataFrame,
    index: DataFrame,
    base_bits: int = BASE_BITS,
    dim: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Entries of the query's own bucket."""
    check_settings(index, base_bits, dim, seed)
    keyed = hash_queries(queries, dim, base_bits, seed=seed).select("query_id", "bucket_id")
    entries = index_at(index, base_bits)
    ids = _identity(entries)
    return bucket_join(keyed, entries.select("bucket_id", *ids)).select("query_id", *ids)


def refine_candidates(
    queries: DataFrame,
    index: DataFrame,
    threshold: int = 10,
    base_bits: int = BASE_BITS,
    refine_bits: int = REFINE_BITS,
    dim: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Candidates left by the density rule."""
    check_settings(index, base_bits + refine_bits, dim, seed)
    hashed = hash_queries(queries, dim, base_bits, refine_bits, seed)
    keyed = _strategy(hashed, index, threshold, base_bits, refine_bits).select(
        "query_id", "bucket_id", _only_level().alias("only_level")
    )
    entries = index_at(index, base_bits, refine_bits)
    ids = _identity(entries)
    return (
        bucket_join(keyed, entries.select("bucket_id", "level1", *ids))
        .where(F.col("only_level").isNull() | (F.col("only_level") == F.col("level1")))
        .select("query_id", *ids)
    )


def multi_probe_candidates(
    queries: DataFrame,
    index: DataFrame,
    bits: int = BASE_BITS,
    radius: int = 2,
    dim: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Entries of all probed buckets; an entry is in one bucket, so no pair comes twice."""
    check_settings(index, bits, dim, seed)
    hashed = hash_queries(queries, dim, bits, seed=seed)
    keyed = probe_buckets(hashed, bits, radius).select(
        "query_id", F.col("probe_bucket").alias("bucket_id")
    )
    entries = index_at(index, bits)
    ids = _identity(entries)
    return bucket_join(keyed, entries.select("bucket_id", *ids)).select("query_id", *ids)


def multi_probe_stats(
    queries: DataFrame,
    index: DataFrame,
    bits: int = BASE_BITS,
    radius: int = 2,
    dim: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """How much of the corpus the probes of each query cover, from bucket sizes alone. A query whose vector does not fit
    probes nothing."""
    check_settings(index, bits, dim, seed)
    hashed = hash_queries(queries, dim, bits, seed=seed, keep_unfit=True)
    probes = probe_buckets(hashed.select("query_id", "bucket_id"), bits, radius)
    sizes = bucket_sizes(index_at(index, bits)).withColumnRenamed("bucket_id", "probe_bucket")
    # Used twice, and small: one row per bucket.
    use_checkpoints(index.sparkSession)
    sizes = sizes.checkpoint()
    n_rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    own = F.when(F.col("probe_bucket") == F.col("bucket_id"), F.col("size"))
    zero = F.lit(0).cast("bigint")
    per_query = (
        probes.join(keyed_by_bucket(sizes, bits), "probe_bucket", "left")
        .groupBy("query_id")
        .agg(
            F.coalesce(F.max(own), zero).alias("query_bucket_size"),
            F.count("probe_bucket").alias("num_probes"),
            F.coalesce(F.sum("size"), zero).alias("total_candidates"),
        )
        .withColumn("n_rows", n_rows)
    )
    total = F.col("total_candidates")
    return per_query.select(
        "query_id",
        "query_bucket_size",
        "num_probes",
        "total_candidates",
        F.try_divide(100 * total, "n_rows").alias("pct_candidates"),
        (F.col("n_rows") / F.greatest(total, F.lit(1))).alias("speedup"),
    )


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top ``k`` that the approximate top ``k`` found, per query."""
    keys = ["query_id", *[c for c in _identity(exact) if c in approx.columns]]
    found = approx.where(F.col("rank") <= k).select(*keys).distinct()
    return (
        exact.where(F.col("rank") <= k)
        .join(found.withColumn("found", F.lit(1.0)), keys, "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("found", F.lit(0.0))).alias("recall"))
    )
