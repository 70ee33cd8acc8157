"""Costs of cosines in whole runs: one number a candidate moves, not its vector."""
import math
import random

from pyspark.sql import functions as F

from rankforge.functions.vectors import cosine_to, cosines_to
from rankforge.operators.vectors import hashing_encoder
from rankforge.session import scratch_path
from rankforge.sources import store


def test_batched_cosines_are_the_same_bits(spark):
    r = random.Random(3)
    odd = [None, [], [0.0] * 7, [1.0], [1.0, None, 2.0], [1.0] * 9, [math.nan, 1.0], [-0.0] * 7, [1e30] * 7]
    rows = [(i, v) for i, v in enumerate(odd + [[r.uniform(-1, 1) for _ in range(7)] for _ in range(3000)])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for target in ([r.uniform(-1, 1) for _ in range(7)], [0.0] * 7):
        got = df.select(cosine_to(F.col("v"), target).alias("a"), cosines_to(F.col("v"), target).alias("b"))
        assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_even_batches_are_the_same_bits(spark):
    r = random.Random(4)
    df = spark.createDataFrame([([r.uniform(-1, 1) for _ in range(5)],) for _ in range(2500)], "v array<float>")
    target = [0.3, -2.0, 0.0, 1.5, 0.1]
    assert df.filter(cosine_to(F.col("v"), target) != cosines_to(F.col("v"), target)).count() == 0


def test_refresh_reads_a_value_in_place_of_vectors(spark):
    path = scratch_path(spark, "t-value")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (3, None)], "id int, text string")
    target = [1.0] * 8
    for encoded in (3, 0):
        new, near = store.refresh(df, "id", "text", path, "m", hashing_encoder(8), cosine_to(F.col("vec"), target).alias("near"))
        assert new.count() == encoded
        assert near.columns == ["id", "text_sha", "text", "near"]
        rows = near.select("id", F.round("near", 6)).collect()
        assert sorted(map(tuple, rows)) == [("1", 0.5), ("1", 0.5), ("2", 0.353553), ("3", 0.0)]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join" in line)
    assert "vec" not in joined
