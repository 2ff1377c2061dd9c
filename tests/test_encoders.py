"""The encoder holds a bounded number of words and texts, however long a task's input."""

import numpy as np
from pyspark.sql import functions as F

from lshthemes.functions.encoders import TokenHashEncoder, encode


class _AtMost:
    dim = 1

    def encode(self, texts):
        return np.full((len(texts), 1), len(texts))


def test_texts_reach_the_encoder_in_small_runs(spark):
    rows = spark.range(0, 3_000, 1, 1).withColumn("text", F.concat(F.lit("w"), F.col("id").cast("string")))
    most = encode(rows, "text", _AtMost()).agg(F.max(F.col("embedding")[0]), F.count("embedding")).first()
    assert most[0] <= 512 and most[1] == 3_000


def test_words_of_an_encoder_are_bounded():
    encoder, fresh = TokenHashEncoder(8), TokenHashEncoder(8)
    texts = [" ".join(f"w{i}" for i in range(k, k + 1_000)) for k in range(0, 200_000, 1_000)]
    got = encoder.encode(texts)
    assert len(encoder._slots) <= 1 << 17
    assert (got[-1] == fresh.encode(texts[-1:])[0]).all()
