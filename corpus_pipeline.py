"""A corpus run: from the documents table to token ids, stage by stage.

Every stage takes the rows its predecessor kept, with all their columns, and gives back those it keeps, unchanged; the last
one gives digests. Null texts count as empty and rows with a null identifier are rows like others. Where a stage keeps one of
several rows, its function says which. Texts of any length are read whole, and an empty table goes through empty. Columns
of other names than ``doc_id`` and ``text`` are carried, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lshthemes.llm.exact_dedup import drop_exact_copies
from lshthemes.llm.queries import bpe_digests, held_out
from lshthemes.llm.simhash import keep_one_of_each
from lshthemes.llm.templates import drop_contaminated
from lshthemes.llm.toxicity import THRESHOLD, toxicity, train_on
from lshthemes.sources.scratch import scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine doesn't reject. It is trained on the labels of the tables, as the query is."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    machine = train_on(docs, labels)
    return docs.where(toxicity(machine) < THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return drop_exact_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier: fingerprints of three-word shingles,
    linked at three differing bits or fewer. Texts without words are near copies of one another."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, as digests, and those of the texts they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("simhash near dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Toxicity and the near copies have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
