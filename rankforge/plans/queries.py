"""Driver queries: each reads the given tables and returns a DataFrame.

The oracle SQL next to each query is an independent DuckDB formulation of
the same result (column names aliased identically).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RankConfig
from ..operators.rank import round6, top_k
from . import oracle_sql as O
from .registry import query
from .slice import slice_scored

CFG = RankConfig()

# ---------------------------------------------------------------------------
# minimal slice
# ---------------------------------------------------------------------------

MINIMAL_SLICE_SQL = f"""
WITH {O.slice_scored_sql()}
SELECT candidate_id,
       CAST(row_number() OVER (ORDER BY round_even(score, 6) DESC, candidate_id) AS BIGINT) AS rank,
       round_even(score, 6) AS score,
       round_even(cosine_similarity, 6) AS cosine_similarity,
       round_even(intent_score, 6) AS intent_score
FROM scored
ORDER BY rank LIMIT 100
"""


def rounded_slice(spark, sf_dir):
    s = slice_scored(spark, sf_dir, CFG)
    return s.select("candidate_id", "c_custkey", round6(F.col("score")).alias("score"),
                    round6(F.col("cosine_similarity")).alias("cosine_similarity"),
                    round6(F.col("intent_score")).alias("intent_score"))


@query("minimal_slice", MINIMAL_SLICE_SQL)
def minimal_slice(spark, sf_dir):
    s = rounded_slice(spark, sf_dir)
    return top_k(s, CFG.top_k).select("candidate_id", "rank", "score", "cosine_similarity",
                                      "intent_score")
