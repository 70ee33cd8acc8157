"""Explaining a ranked frame (M15 with J1).

Accepts either score column name, defaults missing signal columns to 0.0
and adds the trajectory clause only when trajectory columns are present.
Enrichment columns are joined after cutting the enrichment table to the
ranked ids with a semi-join (no broadcast is forced: Spark sizes it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions.reasons import rationale

TRAJ_COLS = ("promotion_velocity", "avg_tenure_per_role", "total_career_duration")


def explain_shortlist(ranked: DataFrame, enriched: DataFrame | None = None,
                      id_col: str = "candidate_id", sim_col: str = "cosine_similarity",
                      intent_col: str = "intent_score",
                      score_cols: Sequence[str] = ("alignment_score", "score"),
                      out_col: str = "rationale", cfg: RankConfig = RankConfig()) -> DataFrame:
    df = ranked
    if enriched is not None:
        extra = [c for c in TRAJ_COLS if c in enriched.columns and c not in df.columns]
        if extra:
            cut = (enriched.select(id_col, *extra)
                   .join(df.select(id_col), id_col, "left_semi")
                   .dropDuplicates([id_col]))
            df = df.join(cut, id_col, "left")

    def num(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    score_col = next((c for c in score_cols if c in df.columns), None)
    score = num(score_col) if score_col else F.lit(0.0)
    traj = [F.col(c).cast("double") if c in df.columns else None for c in TRAJ_COLS]
    return df.withColumn(out_col, rationale(F.col(id_col), num(sim_col), num(intent_col), score,
                                            *traj, sim_weight=cfg.sim_weight,
                                            int_weight=cfg.int_weight))
