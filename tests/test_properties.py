"""SURVEY 5.1 properties: scaling range, no-change refresh, privacy, determinism."""
from pyspark.sql import functions as F

from rankforge.operators import stats as S
from rankforge.operators.features import apply_intent, fit_intent
from rankforge.operators.vectors import hashing_encoder
from rankforge.plans.bindings import Bindings
from rankforge.plans.slice import SLICE_COLS, slice_imputed
from rankforge.session import scratch_path
from rankforge.sources import store

SF = "/root/testdata/sf0.001"


def test_scaled_values_in_unit_interval_on_fit_batch(spark):
    imp = slice_imputed(Bindings(spark, SF))
    out = apply_intent(imp, fit_intent(imp, SLICE_COLS))
    row = out.agg(*[F.min(f"s_{c}").alias(f"a{i}") for i, c in enumerate(SLICE_COLS)],
                  *[F.max(f"s_{c}").alias(f"b{i}") for i, c in enumerate(SLICE_COLS)]).first()
    for i in range(len(SLICE_COLS)):
        assert 0.0 <= row[f"a{i}"] <= row[f"b{i}"] <= 1.0


def test_refresh_without_change_encodes_nothing(spark):
    docs = Bindings(spark, SF).t.documents.select("doc_id", "text")
    path = scratch_path(spark, "t-store")
    enc = hashing_encoder(32)
    first, vecs = store.refresh(docs, "doc_id", "text", path, "h32", enc)
    assert first.count() == docs.count()
    again, vecs2 = store.refresh(docs, "doc_id", "text", path, "h32", enc)
    assert again.count() == 0
    assert vecs2.where(F.col("vec").isNull()).count() == 0 and vecs2.count() == docs.count()
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.lit("new text")).otherwise(F.col("text")))
    third, _ = store.refresh(changed, "doc_id", "text", path, "h32", enc)
    assert [r[0] for r in third.select("id").collect()] == ["0"]


def test_blank_text_gives_zero_vector(spark):
    df = spark.createDataFrame([("a", "  "), ("b", "hello world")], "id string, text string")
    out = {r["id"]: r["vec"] for r in hashing_encoder(16, keep=("id",))(df).collect()}
    assert all(x == 0.0 for x in out["a"])
    assert abs(sum(x * x for x in out["b"]) - 1.0) < 1e-6


def test_medians_ignore_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert S.fit_medians(df, ["x"]) == {"x": 2.0}


def test_cosine_to_targets_matches_single_target(spark):
    from rankforge.operators.vectors import cosine_to_target, cosine_to_targets
    t = Bindings(spark, SF).t
    cands = t.embeddings.select(F.col("vec_id").alias("candidate_id"), "embedding")
    targets = t.embeddings.where(F.col("vec_id") < 3).select("vec_id", "embedding")
    multi = cosine_to_targets(cands, "embedding", targets, "vec_id", "embedding")
    assert multi.count() == cands.count() * 3
    one = targets.where(F.col("vec_id") == 1).first()["embedding"]
    single = {r[0]: r[1] for r in cosine_to_target(cands, "embedding", one).select(
        "candidate_id", "cosine_similarity").collect()}
    for r in multi.where(F.col("vec_id") == 1).select("candidate_id", "cosine_similarity").collect():
        assert abs(r[1] - single[r[0]]) < 1e-12


def test_hash_groups_are_stable_and_bounded(spark):
    from rankforge.operators.labels import hash_groups
    df = spark.range(2000).select(F.col("id").cast("string").alias("cid"))
    a = df.select("cid", hash_groups(F.col("cid"), 7).alias("g"))
    b = df.repartition(5).select("cid", hash_groups(F.col("cid"), 7).alias("g"))
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r[0] for r in a.select("g").distinct().collect()} == set(range(1, 8))
