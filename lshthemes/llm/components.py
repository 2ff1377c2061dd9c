"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lshthemes.sources.scratch import scratch_path

#: Rows that ask for the same label are spread over so many tasks.
SALTS = 8


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _look_up(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of the node in ``key``. A key that most rows share is salted: its label is copied."""
    salted = labels.select(
        F.col("node").alias(key), "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(SALTS)).cast("int")).join(
        salted, [key, "salt"]
    ).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links(a, b)``: the label is the smallest node that can be reached.

    Each round hooks the label of each node to the smallest label beside it, then lets labels point to the labels of
    labels. Only a count comes back to the driver; tables are written between rounds."""
    links = _stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = _stored(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        ends = _look_up(_look_up(links, "a", labels).withColumnRenamed("label", "la"), "b", labels).withColumnRenamed("label", "lb")
        crossing = ends.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct()
        links = _stored(crossing, "links")  # links between labels; those inside one are done
        hooks = links.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to"))
        if links.isEmpty():
            return labels
        # labels are nodes themselves: hook roots, then jump until every hook points to a root
        hooks = _stored(hooks.select(F.col("root").alias("node"), F.col("to").alias("label")), "hooks")
        while True:
            jumped = _look_up(hooks.select(F.col("node").alias("n"), F.col("label").alias("via")), "via", hooks)
            if jumped.isEmpty():
                break
            onward = jumped.select(F.col("n").alias("node"), "label")
            kept = hooks.join(onward.select("node"), "node", "left_anti")
            hooks = _stored(kept.unionByName(onward), "hooks")
        moved = labels.select(F.col("node").alias("n"), F.col("label").alias("via"))
        fresh = _look_up(moved, "via", hooks).select(F.col("n").alias("node"), "label")
        labels = _stored(labels.join(fresh.select("node"), "node", "left_anti").unionByName(fresh), "labels")
