"""The minimal ranking slice over the driver tables.

customer + events + embeddings -> exact-median imputation -> min-max
scaling -> intent mean -> cosine to the target vector -> 0.7/0.3 score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions.vectors import cosine_to
from ..operators import stats as S
from ..operators.features import apply_intent
from ..session import cut_lineage
from .bindings import EVENT_TYPES, Bindings

SLICE_COLS = ("years_of_experience", *[f"n_{t}" for t in EVENT_TYPES], "avg_value",
              "days_since_last_active", "days_since_signup")


def slice_raw(b: Bindings) -> DataFrame:
    cand = b.cand().select("candidate_id", "c_custkey", "years_of_experience")
    return cand.join(b.sig_features(), "c_custkey", "left")


def slice_imputed(b: Bindings, cfg: RankConfig = RankConfig()) -> DataFrame:
    raw = slice_raw(b)
    med = S.fit_medians(raw, SLICE_COLS)
    return S.apply_medians(raw, med)


def slice_scored(spark, sf_dir: str, cfg: RankConfig = RankConfig()) -> DataFrame:
    """candidate_id, c_custkey, cosine_similarity, intent_score, score (unrounded),
    plus the scaled columns ``s_*``.

    The assembled frame is materialised once in the checkpoint folder: the
    statistics pass, the median pass and the scoring pass all read it."""
    b = Bindings(spark, sf_dir)
    raw = cut_lineage(slice_raw(b))
    medians, stats = S.fit_impute_and_scale(raw, SLICE_COLS)
    scored = apply_intent(S.apply_medians(raw, medians), stats)
    with_vec = scored.join(b.capvec(), "c_custkey", "left")
    cos = cosine_to(F.col("embedding"), b.job_vector(0))
    return (with_vec.withColumn("cosine_similarity", cos)
                    .drop("embedding")
                    .withColumn("score", F.lit(cfg.cosine_weight) * F.col("cosine_similarity")
                                + F.lit(cfg.intent_weight) * F.col("intent_score")))
