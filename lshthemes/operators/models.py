"""Embedding models side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelIndex:
    """One model: its name, a description, and the index of the corpus it embedded."""

    name: str
    description: str
    index: DataFrame


def build_metadata(
    models: Sequence[ModelIndex], min_count: int = 5, capacity: int | None = None
) -> DataFrame:
    """One row per model. The load is over ``2 ** bits`` buckets unless a ``capacity`` is given."""
    entries = reduce(
        DataFrame.unionByName,
        [
            m.index.select(
                F.lit(m.name).alias("model_name"),
                F.lit(m.description).alias("description"),
                F.col("dim").alias("dimension"),
                F.col("bits").alias("lsh_bits"),
                "bucket_id",
                "row_id",
            )
            for m in models
        ],
    )
    model = ["model_name", "description", "dimension", "lsh_bits"]
    room = F.lit(float(capacity)) if capacity else F.pow(F.lit(2.0), F.col("lsh_bits"))
    return (
        entries.groupBy(*model, "bucket_id")
        .agg(F.count("row_id").alias("size"))
        .groupBy(*model)
        .agg(
            F.count(F.lit(1)).alias("num_buckets"),
            F.count_if(F.col("size") >= min_count).alias("dense_buckets"),
        )
        .select(*model, "num_buckets", (F.col("num_buckets") / room).alias("load_factor"), "dense_buckets")
    )


def compare_models(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        "model_name", "dimension", "lsh_bits", "num_buckets", "load_factor", "dense_buckets"
    )


def model_info(metadata: DataFrame, model: str) -> DataFrame:
    return metadata.where(F.col("model_name") == model).limit(1)


def model_options(metadata: DataFrame) -> DataFrame:
    """Text to choose a model by: its name and the first part of its description."""
    short = F.split_part("description", F.lit(" - "), F.lit(1))
    return metadata.select(
        "model_name", F.concat("model_name", F.lit(": "), short).alias("option")
    )


def chosen_model(option: Column | str) -> Column:
    """The model name back from an option."""
    return F.substring_index(option, ":", 1)


def corpus_profile(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each dataset."""
    counts = [
        corpus.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows")
        for name, corpus in corpora.items()
    ]
    return reduce(DataFrame.unionByName, counts)
