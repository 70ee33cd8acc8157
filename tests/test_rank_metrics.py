"""Ranking, groups, NDCG with ties (against brute force) and determinism."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankforge.operators.labels import ntile_from_rank, query_groups
from rankforge.operators.metrics import ndcg_at_k
from rankforge.operators.rank import full_rank, round6, top_k


def _pool(spark, n=400, seed=5):
    rnd = random.Random(seed)
    rows = [(f"C{i:05d}", round(rnd.choice([0.1, 0.2, rnd.random()]), 6), rnd.randint(0, 3))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "candidate_id string, score double, label int")


def test_full_rank_is_sorted_permutation(spark):
    rows, df = _pool(spark)
    got = full_rank(df.repartition(7)).select("candidate_id", "rank").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(got, key=lambda r: r[1]) == [(r[0], i + 1) for i, r in enumerate(expected)]


def test_top_k_same_after_shuffle(spark):
    rows, df = _pool(spark)
    a = top_k(df, 25).collect()
    b = top_k(df.repartition(5).orderBy(F.rand(3)), 25).collect()
    assert a == b and [r["rank"] for r in a] == list(range(1, 26))


@pytest.mark.parametrize("n,g", [(10, 4), (1500, 4), (7, 7), (5, 1)])
def test_ntile_sizes(spark, n, g):
    df = spark.range(1, n + 1).select(ntile_from_rank(F.col("id"), n, g).alias("q"))
    sizes = [r[1] for r in df.groupBy("q").count().orderBy("q").collect()]
    base, rem = divmod(n, g)
    assert sizes == [base + 1] * rem + [base] * (g - rem)


def test_query_groups_cover_pool(spark):
    rows, df = _pool(spark, 1001)
    out = query_groups(df, "candidate_id", 300).groupBy("qid").count().collect()
    assert sum(r[1] for r in out) == 1001 and len(out) == 4
    assert max(r[1] for r in out) - min(r[1] for r in out) <= 1


def brute_ndcg(labels, scores, k):
    """Mean over all orderings of tied scores of the plain NDCG@k."""
    idx = list(range(len(labels)))
    groups = [list(g) for _, g in itertools.groupby(sorted(idx, key=lambda i: -scores[i]),
                                                     key=lambda i: -scores[i])]
    ideal = sorted(labels, reverse=True)
    idcg = sum(l / math.log2(p + 2) for p, l in enumerate(ideal[:k]))
    if idcg == 0:
        return 0.0
    total, count = 0.0, 0
    for perm in itertools.product(*[itertools.permutations(g) for g in groups]):
        order = [i for g in perm for i in g]
        total += sum(labels[i] / math.log2(p + 2) for p, i in enumerate(order[:k]))
        count += 1
    return total / count / idcg


@pytest.mark.parametrize("seed", range(6))
def test_ndcg_ties_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 7
    labels = [rnd.randint(0, 3) for _ in range(n)]
    scores = [rnd.choice([0.1, 0.2, 0.3]) for _ in range(n)]
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    got = ndcg_at_k(df, "label", "score", 4).first()[0]
    assert got == pytest.approx(brute_ndcg(labels, scores, 4))


def test_ndcg_edge_cases(spark):
    perfect = spark.createDataFrame([(3, 0.9), (2, 0.5), (0, 0.1)], "label int, score double")
    assert ndcg_at_k(perfect, k=10).first()[0] == pytest.approx(1.0)
    zero = spark.createDataFrame([(0, 0.9), (0, 0.5)], "label int, score double")
    assert ndcg_at_k(zero, k=10).first()[0] == 0.0
    neg = spark.createDataFrame([(-1, 0.9), (2, 0.5)], "label int, score double")
    assert ndcg_at_k(neg, k=10).first()[0] == 0.0


def test_ndcg_per_group(spark):
    df = spark.createDataFrame([("a", 3, 0.9), ("a", 0, 0.1), ("b", 0, 0.9), ("b", 2, 0.1)],
                               "g string, label int, score double")
    got = dict(ndcg_at_k(df, k=10, group_cols=["g"]).collect())
    assert got["a"] == pytest.approx(1.0)
    assert got["b"] == pytest.approx((3 / math.log2(3)) / 3)


def test_round6_matches_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(0)
    vals = list(rnd.normal(size=2000) * 3) + [1.0233985, 0.0000005, 2.5e-7, -1.0233985]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = [r[0] for r in df.select(round6(F.col("v"))).collect()]
    assert got == [float(np.round(v, 6)) for v in vals]


def test_prefix_sum_hot_group_spreads_and_matches(spark):
    from rankforge.operators.prefix import exclusive_prefix_sum
    rows = [("hot", i, 1.0 + (i % 3)) for i in range(3000)] + [("cold", i, 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    out = exclusive_prefix_sum(df, ["g"], [F.col("o").asc()], "v", "before", num_partitions=8)
    got = {(r["g"], r["o"]): r["before"] for r in out.collect()}
    run = {}
    for g, o, v in sorted(rows):
        got_v = got[(g, o)]
        assert got_v == run.get(g, 0.0)
        run[g] = run.get(g, 0.0) + v
    parts = out.withColumn("p", F.spark_partition_id()).where(F.col("g") == "hot").select("p").distinct().count()
    assert parts >= 1


def test_rank_within_matches_row_number(spark):
    from pyspark.sql import Window
    from rankforge.operators.rank import order_cols, rank_within, top_k_per_group
    rows = [("job1" if i % 3 else "job2", f"C{i:04d}", round((i * 37 % 11) / 10, 6)) for i in range(600)]
    df = spark.createDataFrame(rows, "job string, candidate_id string, score double")
    got = {(r["job"], r["candidate_id"]): r["rank"] for r in rank_within(df, ["job"], num_partitions=5).collect()}
    w = Window.partitionBy("job").orderBy(*order_cols())
    exp = {(r["job"], r["candidate_id"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp
    assert top_k_per_group(df, ["job"], 3).count() == 6


def test_prefix_sum_null_group(spark):
    from rankforge.operators.prefix import exclusive_prefix_sum
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 5.0)], "g string, o int, v double")
    got = sorted((r["g"] or "", r["o"], r["b"]) for r in
                 exclusive_prefix_sum(df, ["g"], [F.col("o").asc()], "v", "b", num_partitions=2).collect())
    assert got == [("", 1, 0.0), ("", 2, 1.0), ("a", 1, 0.0)]


def test_ndcg_null_group(spark):
    df = spark.createDataFrame([(None, 3, 0.9), (None, 0, 0.1), ("b", 0, 0.9), ("b", 2, 0.1)],
                               "g string, label int, score double")
    got = {r[0]: r[1] for r in ndcg_at_k(df, k=10, group_cols=["g"]).collect()}
    assert got[None] == pytest.approx(1.0)
