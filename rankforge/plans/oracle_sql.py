"""DuckDB SQL building blocks for the oracle side of every driver query.

These are written independently of the Spark code (plain SQL over the
pre-registered driver views) so the comparison checks two implementations.
"""

from __future__ import annotations

from ..config import REF_DATE

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")
SLICE_COLS = ("years_of_experience", "n_click", "n_view", "n_purchase", "n_signup", "n_error",
              "avg_value", "days_since_last_active", "days_since_signup")

CAND = """cand AS (
  SELECT 'CAND_' || lpad(CAST(c.c_custkey AS VARCHAR), 7, '0') AS candidate_id,
         c.c_custkey, c.c_name AS anonymized_name,
         c.c_acctbal / 150.0 AS years_of_experience,
         n.n_name AS country, c.c_mktsegment AS headline
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_counts = ",\n    ".join(
    f"CAST(count_if(event_type = '{t}') AS DOUBLE) AS n_{t}" for t in EVENT_TYPES)

SIGF = f"""sigf AS (
  SELECT user_id AS c_custkey,
    {_counts},
    avg(value) AS avg_value,
    (epoch_us(TIMESTAMP '{REF_DATE}') - epoch_us(max(ts))) / 86400e6 AS days_since_last_active,
    (epoch_us(TIMESTAMP '{REF_DATE}') - epoch_us(min(ts))) / 86400e6 AS days_since_signup
  FROM events GROUP BY user_id)"""

CAREER = """career AS (
  SELECT o_custkey AS c_custkey, o_orderkey,
    strftime(o_orderdate, '%Y-%m-%d') AS start_date,
    CASE WHEN o_orderstatus = 'O' THEN 'present'
         WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 18 MONTH, '%Y-%m')
         ELSE NULL END AS end_date,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
         ELSE CAST(floor(o_totalprice / 10000.0) AS DOUBLE) END AS duration_months,
    o_orderpriority AS description,
    o_orderstatus = 'O' AS is_current
  FROM orders)"""

JOB = """job AS (
  SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS jv FROM embeddings WHERE vec_id = 0)"""


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two DOUBLE lists; NULL or zero norm -> 0."""
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 "
            f"WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE {dot} / ({na} * {nb}) END")


def dbl_list(col: str) -> str:
    return f"list_transform({col}, lambda x: CAST(x AS DOUBLE))"


def median_impute_ctes(src: str, cols, out: str = "imp", key_cols=("candidate_id", "c_custkey")):
    """CTEs ``med`` and ``<out>``: exact median per column (NaN ignored, none -> 0)."""
    meds = ",\n    ".join(
        f"coalesce(median(CASE WHEN isnan({c}) THEN NULL ELSE {c} END), 0.0) AS m_{c}" for c in cols)
    fills = ",\n    ".join(
        f"coalesce(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, m_{c}) AS {c}" for c in cols)
    keys = ", ".join(key_cols)
    return (f"med AS (SELECT {meds} FROM {src}),\n"
            f"{out} AS (SELECT {keys}, {fills} FROM {src}, med)")


def minmax_ctes(src: str, cols, out: str = "scaled", key_cols=("candidate_id", "c_custkey"),
                extra=()):
    """CTEs ``mm`` and ``<out>``: (x - min) / range, range 0 -> 1, NULL -> 0 first."""
    aggs = ",\n    ".join(
        f"min(coalesce({c}, 0.0)) AS mn_{c}, max(coalesce({c}, 0.0)) AS mx_{c}" for c in cols)
    scaled = ",\n    ".join(
        f"(coalesce({c}, 0.0) - mn_{c}) / (CASE WHEN mx_{c} - mn_{c} = 0 THEN 1.0 "
        f"ELSE mx_{c} - mn_{c} END) AS s_{c}" for c in cols)
    keys = ", ".join(list(key_cols) + list(extra))
    mean = "(" + " + ".join(f"s_{c}" for c in cols) + f") / {float(len(cols))}"
    return (f"mm AS (SELECT {aggs} FROM {src}),\n"
            f"{out} AS (SELECT {keys}, {scaled} FROM {src}, mm),\n"
            f"{out}_i AS (SELECT *, {mean} AS intent_score FROM {out})")


def slice_scored_sql(cols=SLICE_COLS) -> str:
    """WITH-clause body producing ``scored`` (candidate_id, c_custkey,
    cosine_similarity, intent_score, score) for the minimal slice; unrounded."""
    sel = ", ".join(f"s.{c}" for c in cols if c != "years_of_experience")
    return ",\n".join([
        CAND, SIGF,
        f"raw AS (SELECT cand.candidate_id, cand.c_custkey, cand.years_of_experience, {sel} "
        f"FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey)",
        median_impute_ctes("raw", cols),
        minmax_ctes("imp", cols),
        JOB,
        "cosv AS (SELECT i.candidate_id, i.c_custkey, i.intent_score, "
        f"{cosine_sql(dbl_list('e.embedding'), 'job.jv')} AS cosine_similarity "
        "FROM scaled_i i LEFT JOIN embeddings e ON e.vec_id = i.c_custkey, job)",
        "scored AS (SELECT candidate_id, c_custkey, cosine_similarity, intent_score, "
        "0.7 * cosine_similarity + 0.3 * intent_score AS score FROM cosv)",
    ])
