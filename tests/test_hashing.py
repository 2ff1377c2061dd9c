import numpy as np
import pytest
from pyspark.sql import functions as F

from lshthemes.functions import (
    bucket_hex,
    cosine,
    hash_vectors,
    hyperplanes,
    probe_buckets,
    probe_masks,
    with_buckets,
)


def hashes(df, planes, **kw):
    return {r["row_id"]: r["hash"] for r in hash_vectors(df, planes, **kw).collect()}


def test_planes_are_fixed_and_short_hashes_are_prefixes():
    planes = hyperplanes(64)
    assert np.allclose(planes[0, :3], [-0.41475721, -0.33336867, 0.08109199])
    assert (hyperplanes(64, 8) == planes[:8]).all()


def test_edge_vectors(make_vectors):
    planes = np.array([[1.0, 0.0], [0.0, 1.0]])
    rows = [(0, [0, 0]), (1, [float("nan"), 1]), (2, [0, 1]), (3, [1, 1]), (4, [1]), (5, None), (6, [None, 1])]
    assert hashes(make_vectors(rows), planes) == {0: 0, 1: 0, 2: 2, 3: 3, 4: None, 5: None, 6: 0}


def test_strict_raises_on_ragged_vectors(make_vectors):
    with pytest.raises(Exception, match="do not have 2 components"):
        hashes(make_vectors([(0, [1, 1]), (1, [1])]), np.eye(2), strict=True)


def test_hash_equals_higher_order_sql(vectors):
    planes = hyperplanes(64)
    bits = [
        F.aggregate(
            F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in plane]), lambda a, b: a.cast("double") * b),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        for plane in planes
    ]
    weights = [F.when(dot > 0, 1 << i).otherwise(0).cast("bigint") for i, dot in enumerate(bits)]
    both = hash_vectors(vectors, planes).withColumn("sql", sum(weights[1:], weights[0]))
    assert both.where("hash <> sql").count() == 0


def test_buckets_are_slices_of_the_hash(spark):
    df = with_buckets(spark.createDataFrame([(0xABCD,)], "hash bigint"))
    assert df.first()[1:] == (0xCD, 0xB)


def test_probe_masks_reach_all_near_buckets(spark):
    masks = probe_masks()
    assert len(masks) == len(set(masks)) == 37 and masks[0] == 0
    assert all(m.bit_count() <= 2 for m in masks)
    assert sorted(probe_masks(8, 8)) == list(range(256))
    df = probe_buckets(spark.createDataFrame([(0b1010,)], "bucket_id bigint"))
    assert {r["probe_bucket"] for r in df.collect()} == {0b1010 ^ m for m in masks}


def test_bucket_hex(spark):
    df = spark.createDataFrame([(0x3FF,), (5,)], "b bigint")
    rows = df.select(bucket_hex("b"), bucket_hex("b", 2)).collect()
    assert [tuple(r) for r in rows] == [("0x3ff", "0x3ff"), ("0x5", "0x05")]


def test_cosine_is_null_where_undefined(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [None] * 4


def test_hash_is_evaluated_once(vectors):
    """A filter on the bucket must not repeat the hash below it."""
    hashed = with_buckets(hash_vectors(vectors, hyperplanes(64))).where("bucket_id = 3 and hash is not null")
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashed(") == 1
