"""Sinks (S8, S9, S11, S13) and the one-call ranking."""
import pytest
from pyspark.sql import functions as F

from rankforge.config import RankConfig
from rankforge.plans.bindings import Bindings
from rankforge.plans.pipeline import rank_candidates
from rankforge.plans.slice import SLICE_COLS, slice_imputed
from rankforge.session import scratch_path
from rankforge.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cands(spark):
    b = Bindings(spark, SF)
    return b, slice_imputed(b).join(b.capvec(), "c_custkey", "left")


def test_zero_shot_scores_are_cosine(spark, cands):
    b, df = cands
    res = rank_candidates(df, b.job_vector(0), vec_col="embedding", intent_cols=SLICE_COLS,
                          cfg=RankConfig(top_k=20))
    rows = res.ranked.select("score", "cosine_similarity").collect()
    assert all(r[0] == r[1] for r in rows)
    assert res.shortlist.count() == 20
    nd = res.ndcg.first()[0]
    has_negative = any(r[1] < 0 for r in rows)
    assert nd == (0.0 if has_negative else pytest.approx(1.0))


def test_labelled_ranking_and_sinks(spark, cands):
    b, df = cands
    df = df.withColumn("label", (F.col("years_of_experience") > 20).cast("int") + (F.col("n_click") > 5).cast("int"))
    cfg = RankConfig(top_k=10, rounds=2)
    res = rank_candidates(df, b.job_vector(0), vec_col="embedding", intent_cols=SLICE_COLS,
                          label_col="label", cfg=cfg)
    short = res.shortlist
    path = scratch_path(spark, "t-short")
    sinks.write_shortlist(short, path, k=10)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert back.columns == ["candidate_id", "rank", "score", "reasoning"]
    checks = sinks.contract(back, 10, df.count())
    assert all(checks.values()), checks
    reasons = back.select("candidate_id", F.concat(F.lit("new: "), "candidate_id").alias("reasoning"))
    out = scratch_path(spark, "t-short2")
    sinks.rewrite_reasons(path, reasons, out)
    again = spark.read.option("header", True).csv(out)
    assert again.where(~F.col("reasoning").startswith("new: ")).count() == 0
    with pytest.raises(ValueError):
        sinks.rewrite_reasons(path, reasons, path)
    ex = scratch_path(spark, "t-explained")
    sinks.write_explained(res.ranked.drop("embedding"), ex)
    assert spark.read.parquet(ex).count() == df.count()


def test_explain_shortlist_defaults_and_enrichment(spark):
    from rankforge.operators.explain import explain_shortlist
    short = spark.createDataFrame([("A", 1, 3.0), ("B", 2, 0.1)], "candidate_id string, rank int, score double")
    enriched = spark.createDataFrame([("A", 0.5, 1.0, 9.0), ("C", 0.1, 2.0, 1.0)],
                                     "candidate_id string, promotion_velocity double, "
                                     "avg_tenure_per_role double, total_career_duration double")
    out = {r["candidate_id"]: r["rationale"] for r in explain_shortlist(short, enriched).collect()}
    assert set(out) == {"A", "B"}
    from rankforge.functions import reasons as R
    a = out["A"]
    assert any(p in a for p in R.VEL_HIGH_POOL) and any(p in a for p in R.DUR_LONG_POOL)
    assert any(p in a for p in R.CONCLUSION_POOLS["ELITE"])
    assert any(p in out["B"] for p in R.SIM_POOLS["LOW"])
    assert not any(p in out["B"] for p in R.VEL_HIGH_POOL + R.VEL_LOW_POOL)
