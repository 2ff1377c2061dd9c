"""Exact duplicates by a content sort.

Rows are range-partitioned by the first bytes of their normalised text (Spark samples the splitters), sorted within
partitions, and every row is compared in full with its neighbour. A text that many rows share would make one sorted run
as long as its group, so frequent texts are counted first (partial sums leave the map side) and their runs are cut by
a hash of the identifier; the first rows of the cuts are then brought together. Only DataFrame functions are used.

Edge cases: a null text counts as empty, and all empty texts are one group. A null identifier sorts after all others.
Rows repeated with their identifier form a group too; exactly one row of a group stays. No rows in, no rows out.
A very long text is one row, held and compared whole by the task that sorts it. Other columns may have any name: they travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lshthemes.sources.scratch import scratch_path

BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: Runs of a text are cut from this many rows on.
HOT_ROWS = 256
#: At most so many texts can be frequent, whatever the table: the least count grows with it.
MOST_HOT = 65_536
PREFIX_BYTES = 32


def normalised(text: Column) -> Column:
    """The text without ASCII white space; empty for null."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _frequent(docs: DataFrame, text: str, hot_rows: int) -> DataFrame:
    """``(h, cuts)`` of texts on many rows. Their count times the rows each has is at most the rows of the table, so
    there are at most ``MOST_HOT`` of them."""
    least = max(hot_rows, -(-docs.count() // MOST_HOT))
    return (
        docs.select(F.xxhash64(normalised(F.col(text))).alias("h"))
        .groupBy("h")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .select("h", (F.col("n") / least + 1).cast("int").alias("cuts"))
    )


def sorted_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row as ``(row, norm, chars, id, prefix, h, cut, hot, first, run)``: rows with the same
    ``(prefix, h, cut, run)`` have equal texts, and ``first`` marks the one of them that goes before the others."""
    norm = normalised(F.col(text))
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.substring(norm.cast("binary"), 1, PREFIX_BYTES).alias("prefix"),
        F.xxhash64(norm).alias("h"),
    )
    dealt = (
        keyed.join(F.broadcast(_frequent(docs, text, hot_rows)), "h", "left")
        .select(
            "row",
            "prefix",
            "h",
            F.col("cuts").isNotNull().alias("hot"),
            F.coalesce(F.pmod(F.xxhash64(F.col("row")[id]), F.col("cuts")).cast("int"), F.lit(0)).alias("cut"),
        )
        .repartitionByRange("prefix", "h", "cut")
        .withColumns(
            {
                "norm": normalised(F.col("row")[text]),
                "chars": F.coalesce(F.char_length(F.col("row")[text]), F.lit(0)),
                "id": F.col("row")[id],
            }
        )
    )
    order = Window.partitionBy("prefix", "h", "cut").orderBy("norm", F.desc("chars"), F.asc_nulls_last("id"))
    before = F.lag("norm").over(order)
    return dealt.withColumn("first", before.isNull() | (before != F.col("norm"))).withColumn(
        "run", F.sum(F.col("first").cast("int")).over(order)
    )


def _better() -> Column:
    return F.struct((-F.col("chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: ``(id, keep_id, group_size, kept, text_sha256)``. The row with the longest text (in code
    points, as given) stays, of several the one with the smallest identifier."""
    runs = sorted_runs(docs, id, text, hot_rows)
    run = Window.partitionBy("prefix", "h", "cut", "run")
    slim = runs.select(
        "prefix", "h", "cut", "run", "hot", "first", "id", "chars",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.when(F.col("hot") & F.col("first"), F.col("norm")).alias("norm"),
    ).withColumns(
        {"n": F.count("*").over(run), "head": F.min(F.when(F.col("first"), F.struct("id"))).over(run)}
    ).drop("prefix")
    path = scratch_path(docs.sparkSession, "runs")
    slim.write.parquet(path)
    slim = docs.sparkSession.read.parquet(path)
    heads = slim.where(F.col("hot") & F.col("first"))
    whole = heads.groupBy("h", "norm").agg(
        F.min_by(F.struct("cut", "run", "id"), _better()).alias("best"),
        F.sum("n").alias("size"),
    )
    cuts = heads.join(whole, ["h", "norm"]).select("h", "cut", "run", "best", "size")
    best = F.col("best")
    return slim.join(cuts, ["h", "cut", "run"], "left").select(
        F.col("id").alias(id),
        F.when(best.isNotNull(), best["id"]).otherwise(F.col("head")["id"]).alias("keep_id"),
        F.coalesce("size", "n").alias("group_size"),
        (F.col("first") & F.coalesce((best["cut"] == F.col("cut")) & (best["run"] == F.col("run")), F.lit(True))).alias(
            "kept"
        ),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows that stay, as they came in. Texts are shuffled once."""
    runs = sorted_runs(docs, id, text, hot_rows).where("first")
    heads = runs.where("hot")
    best = heads.groupBy("h", "norm").agg(F.min_by(F.struct("row", "cut"), _better()).alias("best"))
    rows = runs.where(~F.col("hot")).select("row").unionByName(best.select(F.col("best")["row"].alias("row")))
    return rows.select("row.*")
