"""Themes: dense buckets whose labels are alike, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lshthemes.functions.hashing import bucket_hex
from lshthemes.functions.text import best_label
from lshthemes.operators.index import identity
from lshthemes.operators.labels import GROUP_BLOCK, group_labels, label_buckets
from lshthemes.sources.scratch import use_checkpoints


def bucket_summary(buckets: Column | str) -> Column:
    """Short text for a theme's ``ARRAY<STRUCT<bucket_id, count>>``."""
    column = F.col(buckets) if isinstance(buckets, str) else buckets
    ids = F.transform(column, lambda b: bucket_hex(b["bucket_id"]))
    n = F.size(column)
    several = F.concat(n.cast("string"), F.lit(" buckets: "), F.array_join(F.slice(ids, 1, 3), ", "))
    more = F.when(n > 3, F.concat(F.lit(", +"), (n - 3).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n > 1, F.concat(several, more)).otherwise(F.concat(F.lit("bucket "), F.get(ids, F.lit(0))))


def theme_buckets(
    buckets: DataFrame, labels: DataFrame, threshold: float = 0.5, top_n: int | None = 10
) -> DataFrame:
    """Every bucket with its own label and the label of the theme it belongs to.

    The labels are read twice, for the groups and for the result; settle them first where they are costly.
    """
    if top_n is not None:
        buckets = buckets.orderBy(F.desc("count"), "bucket_id").limit(top_n)
    labelled = label_buckets(buckets, labels)
    # Labels take the place of their first bucket: the largest, then the lowest id.
    ranked = labelled.groupBy("label").agg(
        F.min(F.struct((-F.col("count")).alias("order"), "bucket_id")).alias("rank")
    )
    small = True if top_n is not None and top_n <= GROUP_BLOCK else None
    groups = group_labels(ranked, threshold, small)
    names = groups.groupBy("leader").agg(best_label("label").alias("theme"))
    merged = groups.join(names, "leader").select("label", "theme")
    return labelled.join(merged, "label")


def merge_themes(
    buckets: DataFrame,
    labels: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    top_n: int | None = 10,
) -> DataFrame:
    """Themes of the ``top_n`` largest buckets, the largest theme first.

    ``items`` is only counted: one partial sum per bucket and task leaves the scan. ``total_count`` adds the
    sizes of the buckets and ``n_items`` the items found, which differ where index entries dangle.
    """
    # One row per bucket, used for the counts and for the themes: the labels behind it are made once.
    use_checkpoints(buckets.sparkSession)
    assigned = theme_buckets(buckets, labels, threshold, top_n).checkpoint()
    wanted = assigned.select("bucket_id")
    present = (
        items.join(wanted, "bucket_id", "left_semi")
        .groupBy("bucket_id")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
    counted = assigned.join(present, "bucket_id", "left")
    entry = F.struct((-F.col("count")).alias("order"), "bucket_id", "count")
    ordered = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda b: F.struct(b["bucket_id"].alias("bucket_id"), b["count"].alias("count")),
    )
    zero = F.lit(0).cast("bigint")
    return (
        counted.groupBy(F.col("theme").alias("label"))
        .agg(
            F.sort_array(F.collect_set(F.col("label"))).alias("original_labels"),
            ordered.alias("buckets"),
            F.sum("count").alias("total_count"),
            F.coalesce(F.sum("n_items"), zero).alias("n_items"),
        )
        .withColumn("is_merged", F.size("original_labels") > 1)
        .withColumn("bucket_summary", bucket_summary("buckets"))
        .orderBy(F.desc("total_count"), "label")
    )


def theme_samples(
    themes: DataFrame,
    items: DataFrame,
    n: int = 8,
    corpus: DataFrame | None = None,
) -> DataFrame:
    """The first ``n`` items of every theme, bucket after bucket, and how many more there are.

    The rank filter also runs before the shuffle, so each task sends at most ``n`` items per theme. With a
    ``corpus``, ``items`` may be bare index entries; the text is then fetched for the sampled ones alone.
    """
    members = themes.select(
        "label", "n_items", F.posexplode("buckets").alias("bucket_pos", "b")
    ).select("label", "n_items", "bucket_pos", F.col("b.bucket_id").alias("bucket_id"))
    place = [c for c in ("file_path", "row_id") if c in items.columns]
    first = Window.partitionBy("label").orderBy("bucket_pos", *place)
    more = F.greatest(F.col("n_items") - n, F.lit(0).cast("bigint"))
    sampled = (
        items.join(members, "bucket_id")
        .withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= n)
        .withColumns({"pos": F.col("pos").cast("bigint"), "more_items": more})
    )
    if corpus is not None:
        keys = identity(items, corpus)
        ranked = sampled.select("label", "pos", "bucket_id", *place, "more_items")
        texts = corpus.select(*keys, "item_id", "display_text")
        sampled = texts.join(ranked, keys)
    return sampled.select("label", "pos", "bucket_id", *place, "item_id", "display_text", "more_items")
