"""Driver queries for scoring-side operators: scaling, cosine, labels,
groups, ranking, NDCG, health checks and reasons (A5-A11, M3-M10, M12-M15,
W1-W3, T7-T13, J1, J2, S8, S11, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SUBMISSION_COLUMNS, RankConfig
from ..functions import reasons as R
from ..functions.vectors import blank_to_zero_vector, cosine, cosine_to, literal_vector, norm, zero_vector
from ..operators import stats as S
from ..operators.career import trajectory_by_role
from ..operators.features import (apply_intent, composite_from_signals, composite_vector, fit_intent, of_length,
                                  ranker_features, signal_matrix)
from ..operators.labels import query_groups as make_groups
from ..operators.labels import weak_labels as make_labels
from ..operators.metrics import ndcg_at_k as ndcg_op
from ..operators.metrics import null_counts, vector_health as vhealth
from ..operators.rank import full_rank as rank_all
from ..operators.rank import round6, top_k as take_top
from ..operators.vectors import top_matches
from ..session import cut_lineage
from ..sources.sinks import contract
from . import oracle_sql as O
from .bindings import Bindings
from .q_prep import CAREER_FULL_SQL
from .registry import query
from .slice import SLICE_COLS, slice_imputed, slice_raw, slice_scored

CFG = RankConfig()

SCORED_R6 = f"""{O.slice_scored_sql()},
r AS (SELECT candidate_id, c_custkey, round_even(score, 6) AS score,
  round_even(cosine_similarity, 6) AS cosine_similarity,
  round_even(intent_score, 6) AS intent_score FROM scored)"""


def scored_r6(spark, sf_dir):
    s = slice_scored(spark, sf_dir, CFG)
    return s.select("candidate_id", "c_custkey", round6(F.col("score")).alias("score"),
                    round6(F.col("cosine_similarity")).alias("cosine_similarity"),
                    round6(F.col("intent_score")).alias("intent_score"))


def shortlist_r6(spark, sf_dir, k=CFG.top_k):
    return take_top(scored_r6(spark, sf_dir), k)


SHORT_SQL = f"""{SCORED_R6},
short AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, candidate_id) AS BIGINT) AS rank
  FROM r ORDER BY rank LIMIT {CFG.top_k})"""


def fmt_sql(x: str, d: int) -> str:
    return f"printf('%.{d}f', {x})"


# ---------------------------------------------------------------------------
# A5 / M5 / M7 scaling, A6 intent
# ---------------------------------------------------------------------------

@query("minmax_scale", f"""
WITH {O.CAND}, {O.SIGF},
raw AS (SELECT cand.candidate_id, cand.c_custkey, cand.years_of_experience,
  {", ".join(f"s.{c}" for c in SLICE_COLS[1:])}
  FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey),
{O.median_impute_ctes("raw", SLICE_COLS)},
{O.minmax_ctes("imp", SLICE_COLS)}
SELECT candidate_id, {", ".join(f"round_even(s_{c}, 6) AS s_{c}" for c in SLICE_COLS)} FROM scaled
""")
def minmax_scale(spark, sf_dir):
    imp = slice_imputed(Bindings(spark, sf_dir), CFG)
    st = fit_intent(imp, SLICE_COLS)
    out = apply_intent(imp, st)
    return out.select("candidate_id", *[round6(F.col(f"s_{c}")).alias(f"s_{c}") for c in SLICE_COLS])


@query("minmax_constant", f"""
WITH {O.CAND},
f AS (SELECT candidate_id, years_of_experience, floor(years_of_experience / 1e9) AS bucket FROM cand),
mm AS (SELECT min(years_of_experience) a, max(years_of_experience) b, min(bucket) c, max(bucket) d FROM f)
SELECT candidate_id,
  round_even((years_of_experience - a) / CASE WHEN b - a = 0 THEN 1.0 ELSE b - a END, 6) AS s_years,
  round_even((bucket - c) / CASE WHEN d - c = 0 THEN 1.0 ELSE d - c END, 6) AS s_bucket
FROM f, mm
""")
def minmax_constant(spark, sf_dir):
    c = Bindings(spark, sf_dir).cand().select(
        "candidate_id", "years_of_experience",
        F.floor(F.col("years_of_experience") / F.lit(1e9)).cast("double").alias("bucket"))
    st = S.fit_minmax(c, ["years_of_experience", "bucket"])
    return c.select("candidate_id",
                    round6(S.minmax_expr("years_of_experience", st["years_of_experience"])).alias("s_years"),
                    round6(S.minmax_expr("bucket", st["bucket"])).alias("s_bucket"))


FIT_BATCH = "('AUTOMOBILE', 'BUILDING', 'FURNITURE')"


@query("frozen_scale", f"""
WITH {O.CAND}, {O.SIGF},
raw AS (SELECT cand.candidate_id, cand.c_custkey, c.c_mktsegment, cand.years_of_experience,
  {", ".join(f"s.{c}" for c in SLICE_COLS[1:])}
  FROM cand JOIN customer c ON c.c_custkey = cand.c_custkey
  LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey),
fitb AS (SELECT * FROM raw WHERE c_mktsegment IN {FIT_BATCH}),
mm AS (SELECT {", ".join(f"min(coalesce({c}, 0.0)) AS mn_{c}, max(coalesce({c}, 0.0)) AS mx_{c}" for c in SLICE_COLS)} FROM fitb)
SELECT candidate_id, {", ".join(
    f"round_even((coalesce({c}, 0.0) - mn_{c}) / CASE WHEN mx_{c} - mn_{c} = 0 THEN 1.0 ELSE mx_{c} - mn_{c} END, 6) AS s_{c}"
    for c in SLICE_COLS)}
FROM raw, mm
""")
def frozen_scale(spark, sf_dir):
    """M7: statistics fitted on one batch are applied unchanged to all rows."""
    b = Bindings(spark, sf_dir)
    raw = slice_raw(b).join(b.t.customer.select(F.col("c_custkey"), "c_mktsegment"), "c_custkey")
    fit_batch = raw.where(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE"))
    st = fit_intent(fit_batch, SLICE_COLS)
    out = apply_intent(raw, st)
    return out.select("candidate_id", *[round6(F.col(f"s_{c}")).alias(f"s_{c}") for c in SLICE_COLS])


@query("intent_score", f"""
WITH {SCORED_R6}
SELECT candidate_id, intent_score FROM r
""")
def intent_score(spark, sf_dir):
    return scored_r6(spark, sf_dir).select("candidate_id", "intent_score")


# ---------------------------------------------------------------------------
# M6: eleven raw signals from JSON, bool -> 0/1, bad -> 0, own scaler
# ---------------------------------------------------------------------------

SIG11 = ("profile_completeness_score", "open_to_work_flag", "profile_views_received_30d",
         "applications_submitted_30d", "recruiter_response_rate", "avg_response_time_hours",
         "connection_count", "notice_period_days", "github_activity_score",
         "interview_completion_rate", "offer_acceptance_rate")


def _signals_json(s):
    total = F.col("n_click") + F.col("n_view") + F.col("n_purchase") + F.col("n_signup") + F.col("n_error")
    doc = F.to_json(F.struct(
        (F.col("n_view") / total).alias("profile_completeness_score"),
        (F.col("n_signup") > 0).alias("open_to_work_flag"),
        F.col("n_view").cast("bigint").alias("profile_views_received_30d"),
        F.col("n_purchase").cast("string").alias("applications_submitted_30d"),
        F.lit("NaN").alias("recruiter_response_rate"),
        F.col("avg_value").alias("avg_response_time_hours"),
        F.col("n_click").cast("bigint").alias("connection_count"),
        F.lit("oops").alias("notice_period_days"),
        F.lit(None).cast("double").alias("github_activity_score"),
        (F.col("n_error") / total).alias("interview_completion_rate")))
    return s.select("c_custkey", F.try_parse_json(doc).alias("signals"))


@query("signals_11", f"""
WITH {O.SIGF},
v AS (SELECT c_custkey,
  n_view / (n_click + n_view + n_purchase + n_signup + n_error) AS profile_completeness_score,
  CASE WHEN n_signup > 0 THEN 1.0 ELSE 0.0 END AS open_to_work_flag,
  n_view AS profile_views_received_30d, n_purchase AS applications_submitted_30d,
  0.0 AS recruiter_response_rate, avg_value AS avg_response_time_hours,
  n_click AS connection_count, 0.0 AS notice_period_days, 0.0 AS github_activity_score,
  n_error / (n_click + n_view + n_purchase + n_signup + n_error) AS interview_completion_rate,
  0.0 AS offer_acceptance_rate FROM sigf),
mm AS (SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in SIG11)} FROM v)
SELECT c_custkey, {", ".join(
    f"round_even((CAST({c} AS DOUBLE) - mn_{c}) / CASE WHEN mx_{c} - mn_{c} = 0 THEN 1.0 ELSE mx_{c} - mn_{c} END, 6) AS {c}"
    for c in SIG11)}
FROM v, mm
""")
def signals_11(spark, sf_dir):
    j = _signals_json(Bindings(spark, sf_dir).sig())
    m = signal_matrix(j, "signals")
    st = S.fit_minmax(m, SIG11)
    return m.select("c_custkey", *[round6(S.minmax_expr(c, st[c])).alias(c) for c in SIG11])


# ---------------------------------------------------------------------------
# M3 / M4 / J4 cosine, M8 / M9 composite
# ---------------------------------------------------------------------------

@query("cosine_to_job", f"""
WITH {SCORED_R6}
SELECT candidate_id, cosine_similarity FROM r
""")
def cosine_to_job(spark, sf_dir):
    return scored_r6(spark, sf_dir).select("candidate_id", "cosine_similarity")


@query("cosine_zero", f"""
WITH {O.CAND}, {O.JOB},
t AS (SELECT cand.candidate_id,
  CASE WHEN trim(coalesce(d.text, '')) = '' THEN list_transform(range(64), lambda i: CAST(0 AS DOUBLE))
       ELSE {O.dbl_list('e.embedding')} END AS v
  FROM cand LEFT JOIN documents d ON d.doc_id = cand.c_custkey
  LEFT JOIN embeddings e ON e.vec_id = cand.c_custkey)
SELECT candidate_id, round_even({O.cosine_sql('t.v', 'job.jv')}, 6) AS cosine_similarity,
  (t.v IS NOT NULL AND list_sum(list_transform(t.v, lambda x: abs(x))) = 0) AS is_zero_vector
FROM t, job
""")
def cosine_zero(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    job = literal_vector(b.job_vector(0))
    f = (b.cand().select("candidate_id", "c_custkey")
         .join(b.captext().select("c_custkey", "text"), "c_custkey", "left")
         .join(b.capvec(), "c_custkey", "left"))
    v = blank_to_zero_vector(F.col("text"), F.col("embedding"), 64)
    f = f.withColumn("v", v)
    return f.select("candidate_id", round6(cosine(F.col("v"), job)).alias("cosine_similarity"),
                    (F.col("v").isNotNull()
                     & (F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)) == 0)).alias("is_zero_vector"))


@query("composite_vector", f"""
WITH {O.slice_scored_sql()},
comp AS (SELECT i.candidate_id,
  list_concat(CASE WHEN e.embedding IS NULL THEN list_transform(range(64), lambda i: CAST(0 AS DOUBLE))
    ELSE {O.dbl_list('e.embedding')} END, [{", ".join(f"i.s_{c}" for c in SLICE_COLS)}]) AS v,
  [c.cosine_similarity, {", ".join(f"i.s_{c}" for c in SLICE_COLS)}] AS feats
  FROM scaled_i i LEFT JOIN embeddings e ON e.vec_id = i.c_custkey JOIN cosv c ON c.candidate_id = i.candidate_id)
SELECT candidate_id, CAST(len(v) AS INTEGER) AS dim,
  round_even(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
  round_even(list_sum(v), 6) AS total, round_even(list_sum(feats), 6) AS feature_sum
FROM comp
""")
def composite_vector_q(spark, sf_dir):
    """M8 (J3: vectors joined to every candidate's intent on the id; a missing
    vector counts as zeros, a wrong length is an error) and M9 features."""
    b = Bindings(spark, sf_dir)
    imp = slice_imputed(b, CFG)
    st = fit_intent(imp, SLICE_COLS)
    sc = apply_intent(imp, st)
    target = b.job_vector(0)
    j = sc.join(b.capvec(), "c_custkey", "left")
    j = j.withColumn("embedding", of_length(F.coalesce("embedding", zero_vector(len(target))), len(target)))
    scaled = [f"s_{c}" for c in SLICE_COLS]
    j = j.withColumn("cos", cosine_to(F.col("embedding"), target))
    comp = composite_vector("embedding", scaled)
    feats = ranker_features("cos", scaled)
    return j.select("candidate_id", F.size(comp).alias("dim"), round6(norm(comp)).alias("norm"),
                    round6(F.aggregate(comp, F.lit(0.0), lambda a, x: a + x)).alias("total"),
                    round6(F.aggregate(feats, F.lit(0.0), lambda a, x: a + x)).alias("feature_sum"))


@query("jobs_top10", f"""
WITH job AS (SELECT b.item_id, {O.dbl_list('e.embedding')} AS jv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
cand AS (SELECT vec_id, {O.dbl_list('embedding')} AS v FROM embeddings),
scored AS (SELECT item_id, vec_id, round_even(coalesce(list_dot_product(v, jv) /
    nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(jv, jv)), 0), 0.0), 6) AS cosine_similarity FROM job, cand)
SELECT item_id, rank, vec_id, cosine_similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine_similarity DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""")
def jobs_top10(spark, sf_dir):
    """J4 for many jobs: every benchmark item as a job, its ten nearest candidates."""
    b = Bindings(spark, sf_dir)
    vecs = b.capvec().withColumnRenamed("c_custkey", "vec_id")
    jobs = b.t.benchmark.select("item_id").join(vecs, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    # small blocks, so that the jobs take several
    return top_matches(vecs, "vec_id", "embedding", jobs, "item_id", "embedding", k=10, block_bytes=1 << 14)


@query("composite_signals", f"""
WITH {O.SIGF},
v AS (SELECT c_custkey,
  n_view / (n_click + n_view + n_purchase + n_signup + n_error) AS profile_completeness_score,
  CASE WHEN n_signup > 0 THEN 1.0 ELSE 0.0 END AS open_to_work_flag,
  n_view AS profile_views_received_30d, n_purchase AS applications_submitted_30d,
  0.0 AS recruiter_response_rate, avg_value AS avg_response_time_hours,
  n_click AS connection_count, 0.0 AS notice_period_days, 0.0 AS github_activity_score,
  n_error / (n_click + n_view + n_purchase + n_signup + n_error) AS interview_completion_rate,
  0.0 AS offer_acceptance_rate FROM sigf),
mm AS (SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in SIG11)} FROM v)
SELECT c_custkey, {O.dbl_list('e.embedding')}[1] AS first_value, CAST(len(e.embedding) AS INTEGER) AS boundary,
  CAST(len(e.embedding) + 11 AS INTEGER) AS dim, round_even({" + ".join(
    f"(CAST({c} AS DOUBLE) - mn_{c}) / CASE WHEN mx_{c} - mn_{c} = 0 THEN 1.0 ELSE mx_{c} - mn_{c} END" for c in SIG11)}, 6) AS intent_total
FROM v JOIN mm ON TRUE JOIN embeddings e ON e.vec_id = c_custkey
""")
def composite_signals(spark, sf_dir):
    """M8 from raw signal objects: texts and signals meet on the key; the
    vectoriser here looks the stored vector of a candidate up."""
    b = Bindings(spark, sf_dir)
    vecs = cut_lineage(b.capvec())
    signals = _signals_json(b.sig()).join(vecs.select("c_custkey"), "c_custkey", "left_semi")
    texts = signals.select("c_custkey", F.lit("profile").alias("text"))
    look_up = lambda df: df.join(vecs.select("c_custkey", F.col("embedding").alias("vec")), "c_custkey", "left")
    out = composite_from_signals(texts, signals, "c_custkey", "text", "signals", look_up)
    return out.select("c_custkey", F.col("composite")[0].alias("first_value"), "boundary", F.size("composite").alias("dim"),
                      round6(F.aggregate(F.slice("composite", F.col("boundary") + 1, 11), F.lit(0.0), lambda a, x: a + x)).alias("intent_total"))


# ---------------------------------------------------------------------------
# A7 / A8 / M10 labels, W3 groups
# ---------------------------------------------------------------------------

@query("weak_labels", f"""
WITH {O.slice_scored_sql()},
c AS (SELECT candidate_id, 0.7 * cosine_similarity + 0.3 * intent_score AS combined FROM scored),
q AS (SELECT quantile_cont(combined, [0.25, 0.5, 0.75]) AS qs FROM c)
SELECT candidate_id, round_even(combined, 6) AS combined_signal,
  CAST((combined >= qs[1])::INT + (combined >= qs[2])::INT + (combined >= qs[3])::INT AS INTEGER) AS label
FROM c, q
""")
def weak_labels(spark, sf_dir):
    s = slice_scored(spark, sf_dir, CFG)
    lab, _ = make_labels(s, probs=CFG.label_quantiles)
    return lab.select("candidate_id", round6(F.col("combined_signal")).alias("combined_signal"), "label")


GROUP_CAP = 400  # small cap so the test data spans several groups


@query("query_groups", f"""
WITH {O.CAND}
SELECT candidate_id, CAST(ntile(CAST(ceil((SELECT count(*) FROM cand) / {GROUP_CAP}.0) AS BIGINT))
  OVER (ORDER BY candidate_id) AS BIGINT) AS qid
FROM cand
""")
def query_groups(spark, sf_dir):
    c = Bindings(spark, sf_dir).cand().select("candidate_id")
    return make_groups(c, "candidate_id", GROUP_CAP)


# ---------------------------------------------------------------------------
# W1 / W2 / P14 / S8 ranking and shortlist, M14 zero-shot, S11 contract
# ---------------------------------------------------------------------------

@query("full_rank", f"""
WITH {SCORED_R6}
SELECT candidate_id, score,
  CAST(row_number() OVER (ORDER BY score DESC, candidate_id) AS BIGINT) AS rank FROM r
""")
def full_rank(spark, sf_dir):
    return rank_all(scored_r6(spark, sf_dir).select("candidate_id", "score"))


def _reason_sql(cos, intent, score):
    return (f"CASE WHEN {score} >= 0.40 THEN 'Top match' WHEN {score} >= 0.30 THEN 'Strong match' "
            f"WHEN {score} >= 0.20 THEN 'Reasonable match' ELSE 'Developing match' END "
            f"|| '. Profile text shows ' || CASE WHEN {cos} >= 0.35 THEN 'strong' "
            f"WHEN {cos} >= 0.25 THEN 'fair' ELSE 'limited' END "
            f"|| ' overlap with the role (cosine ' || {fmt_sql(cos, 4)} "
            f"|| '); activity on the platform is ' || CASE WHEN {intent} >= 0.55 THEN 'high' "
            f"WHEN {intent} >= 0.35 THEN 'steady' ELSE 'light' END "
            f"|| ' (intent ' || {fmt_sql(intent, 4)} || '). Overall score ' || {fmt_sql(score, 4)} || '.'")


@query("top_k", f"""
WITH {SHORT_SQL}
SELECT candidate_id, rank, score, {_reason_sql('cosine_similarity', 'intent_score', 'score')} AS reasoning
FROM short
""")
def top_k(spark, sf_dir):
    s = shortlist_r6(spark, sf_dir)
    return s.select("candidate_id", "rank", "score",
                    R.reason_sentence(F.col("cosine_similarity"), F.col("intent_score"),
                                      F.col("score")).alias("reasoning"))


@query("reason_tiers", f"""
WITH {SCORED_R6}
SELECT candidate_id, {_reason_sql('cosine_similarity', 'intent_score', 'score')} AS reasoning FROM r
""")
def reason_tiers(spark, sf_dir):
    s = scored_r6(spark, sf_dir)
    return s.select("candidate_id", R.reason_sentence(F.col("cosine_similarity"), F.col("intent_score"),
                                                      F.col("score")).alias("reasoning"))


@query("zero_shot", f"""
WITH {SCORED_R6}
SELECT candidate_id, cosine_similarity AS score,
  CAST(row_number() OVER (ORDER BY cosine_similarity DESC, candidate_id) AS BIGINT) AS rank
FROM r ORDER BY rank LIMIT {CFG.top_k}
""")
def zero_shot(spark, sf_dir):
    """M14/M12 through the one-call ranking: without labels there is no
    model and the score is the cosine."""
    from .pipeline import rank_candidates
    b = Bindings(spark, sf_dir)
    cands = slice_imputed(b, CFG).join(b.capvec(), "c_custkey", "left")
    res = rank_candidates(cands, b.job_vector(0), vec_col="embedding", intent_cols=SLICE_COLS,
                          label_col=None, cfg=CFG)
    return res.shortlist.select("candidate_id", "score", "rank")


@query("contract_check", f"""
WITH {SHORT_SQL}
SELECT count(*) AS n_rows, least({CFG.top_k}, (SELECT count(*) FROM r)) AS expected_rows,
  count(DISTINCT candidate_id) = count(*) AS ids_unique,
  min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS ranks_ok,
  (SELECT count(*) FROM r) AS pool_rows, count(*) = least({CFG.top_k}, (SELECT count(*) FROM r)) AS rows_ok,
  TRUE AS columns_ok, TRUE AS groups_ok
FROM short
""")
def contract_check(spark, sf_dir):
    """The checks of the library on a shortlist: row count = min(k, N),
    columns, ranks a permutation of 1..n, unique ids, group sizes summing to N."""
    pool = cut_lineage(scored_r6(spark, sf_dir).select("candidate_id", "score"))  # scored once, read often
    short = cut_lineage(take_top(pool, CFG.top_k).withColumn("reasoning", F.lit("")).select(*SUBMISSION_COLUMNS))
    n = pool.count()
    sizes = make_groups(pool, "candidate_id", 400).groupBy("qid").count()
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    checks = contract(short, CFG.top_k, n, group_sizes_total=total)
    row = short.agg(F.count(F.lit(1)).alias("n_rows"))
    facts = {"expected_rows": min(CFG.top_k, n), "pool_rows": n}
    return row.select("n_rows", *[F.lit(v).cast("bigint").alias(k) for k, v in facts.items()],
                      F.lit(checks["ids_unique"]).alias("ids_unique"), F.lit(checks["ranks"]).alias("ranks_ok"),
                      F.lit(checks["rows"]).alias("rows_ok"), F.lit(checks["columns"]).alias("columns_ok"),
                      F.lit(checks["groups"]).alias("groups_ok"))


# ---------------------------------------------------------------------------
# A9 NDCG, A10 / A11 health
# ---------------------------------------------------------------------------

def _doc_scores(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    job = b.job_vector(0)
    d = b.t.documents.select("doc_id", "lang").join(b.t.labels.select("doc_id", "quality"), "doc_id")
    d = d.join(b.t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return d.select("doc_id", "lang", F.col("quality").alias("label"),
                    round6(cosine_to(F.col("embedding"), job)).alias("score"))


def _ndcg_sql(group: bool) -> str:
    g = "lang" if group else "'all'"
    return f"""
WITH {O.JOB},
base AS (SELECT {g} AS grp, CAST(l.quality AS DOUBLE) AS lab,
  round_even({O.cosine_sql(O.dbl_list('e.embedding'), 'job.jv')}, 6) AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id, job),
ties AS (SELECT grp, score, count(*) AS n, sum(lab) AS g FROM base GROUP BY grp, score),
pos AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY grp ORDER BY score DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS st FROM ties),
dcg AS (SELECT grp, sum(g / n * list_sum(list_transform(range(st, least(st + n - 1, 10) + 1),
  lambda p: 1.0 / log2(p + 1)))) AS dcg FROM pos WHERE st <= 10 GROUP BY grp),
ideal AS (SELECT grp, lab, row_number() OVER (PARTITION BY grp ORDER BY lab DESC) AS p FROM base),
idcg AS (SELECT grp, sum(lab / log2(p + 1)) AS idcg FROM ideal WHERE p <= 10 GROUP BY grp),
grps AS (SELECT grp, min(lab) AS minlab FROM base GROUP BY grp)
SELECT {"grps.grp AS lang, " if group else ""}round_even(CASE WHEN minlab < 0 THEN 0.0
  WHEN coalesce(idcg, 0) = 0 THEN 0.0 ELSE coalesce(dcg, 0) / idcg END, 6) AS ndcg
FROM grps LEFT JOIN dcg ON dcg.grp = grps.grp LEFT JOIN idcg ON idcg.grp = grps.grp
"""


@query("ndcg_at_k", _ndcg_sql(False))
def ndcg_at_k(spark, sf_dir):
    r = ndcg_op(_doc_scores(spark, sf_dir), "label", "score", CFG.ndcg_k)
    return r.select(round6(F.col("ndcg")).alias("ndcg"))


@query("ndcg_per_group", _ndcg_sql(True))
def ndcg_per_group(spark, sf_dir):
    r = ndcg_op(_doc_scores(spark, sf_dir), "label", "score", CFG.ndcg_k, group_cols=["lang"])
    return r.select("lang", round6(F.col("ndcg")).alias("ndcg"))


NULL_COLS = ("candidate_id", "years_of_experience", *SLICE_COLS[1:])


@query("null_profile", f"""
WITH {O.CAND}, {O.SIGF},
raw AS (SELECT cand.candidate_id, cand.years_of_experience, {", ".join(f"s.{c}" for c in SLICE_COLS[1:])}
  FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey)
{" UNION ALL ".join(
    f"SELECT count(*) AS n_rows, '{c}' AS column_name, count_if({c} IS NULL"
    + ("" if c == "candidate_id" else f" OR isnan({c})") + ") AS n_null FROM raw" for c in NULL_COLS)}
""")
def null_profile(spark, sf_dir):
    raw = slice_raw(Bindings(spark, sf_dir)).select(*NULL_COLS)
    return null_counts(raw)


@query("vector_health", """
WITH v AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT count(*) AS n_vectors, CAST(min(len(e)) AS INTEGER) AS min_dim, CAST(max(len(e)) AS INTEGER) AS max_dim,
  round_even(min(sqrt(list_sum(list_transform(e, lambda x: x * x)))), 6) AS min_norm,
  round_even(max(sqrt(list_sum(list_transform(e, lambda x: x * x)))), 6) AS max_norm,
  CAST(sum(len(list_filter(e, lambda x: isnan(x)))) AS BIGINT) AS nan_count,
  round_even(min(list_min(e)), 6) AS min_value, round_even(max(list_max(e)), 6) AS max_value
FROM v
""")
def vector_health(spark, sf_dir):
    h = vhealth(Bindings(spark, sf_dir).t.embeddings, "embedding")
    return h.select("n_vectors", "min_dim", "max_dim", round6(F.col("min_norm")).alias("min_norm"),
                    round6(F.col("max_norm")).alias("max_norm"), F.col("nan_count").cast("bigint"),
                    round6(F.col("min_value")).alias("min_value"),
                    round6(F.col("max_value")).alias("max_value"))


# ---------------------------------------------------------------------------
# T8 / J2 / S12 metadata reason; T9 stable pick; T10-T13 / J1 / M15
# ---------------------------------------------------------------------------

def metadata_lookup(b: Bindings, wanted):
    """One metadata record per event, keyed by candidate; the last
    record (highest event id) of an id wins.  Events are cut to the wanted
    candidates first (k ids, a bounded broadcast); ``max_by`` is combined
    map-side, so a hot id costs one partial row per task."""
    ids = wanted.select(F.col("c_custkey").alias("user_id"))
    e = b.t.events.join(F.broadcast(ids), "user_id", "left_semi").select("event_id", "user_id", "event_type", "value",
                          F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    rec = F.struct(F.concat(F.initcap("event_type"), F.lit(" Specialist")).alias("title"),
                   (F.col("value") / F.lit(10.0)).alias("years"), F.col("k").alias("n_skills"),
                   (F.col("value") / F.lit(100.0)).alias("response_rate"))
    last = e.groupBy("user_id").agg(F.max_by(rec, F.col("event_id")).alias("m"))
    return last.select(F.concat(F.lit("CAND_"), F.lpad(F.col("user_id").cast("string"), 7, "0"))
                       .alias("candidate_id"), "m.*")


@query("metadata_reason", f"""
WITH {SHORT_SQL},
lk AS (SELECT 'CAND_' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS candidate_id,
  arg_max(upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' Specialist', event_id) AS title,
  arg_max(value / 10.0, event_id) AS years,
  arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS n_skills,
  arg_max(value / 100.0, event_id) AS response_rate
  FROM events GROUP BY user_id)
SELECT short.candidate_id, short.rank,
  CASE WHEN lk.candidate_id IS NULL THEN 'Data Scientist with 5.0 yrs; 8 AI core skills; response rate 0.80.'
  ELSE coalesce(title, 'Software Engineer') || ' with ' || {fmt_sql('coalesce(years, 0.0)', 1)} || ' yrs; '
       || CAST(coalesce(n_skills, 0) AS VARCHAR) || ' AI core skills; response rate '
       || {fmt_sql('coalesce(response_rate, 0.0)', 2)} || '.' END AS reasoning
FROM short LEFT JOIN lk ON lk.candidate_id = short.candidate_id
""")
def metadata_reason(spark, sf_dir):
    """T8 + J2: the shortlist (k rows) joined with the metadata lookup."""
    b = Bindings(spark, sf_dir)
    short = cut_lineage(shortlist_r6(spark, sf_dir).select("candidate_id", "c_custkey", "rank"))
    lk = metadata_lookup(b, short).withColumn("_known", F.lit(True))
    j = short.join(lk, "candidate_id", "left")
    return j.select("candidate_id", "rank",
                    R.metadata_sentence(F.coalesce(F.col("_known"), F.lit(False)), F.col("title"),
                                        F.col("years"), F.col("n_skills"),
                                        F.col("response_rate")).alias("reasoning"))


def md5_mod_sql(key: str, n: int) -> str:
    acc = "0"
    for i in range(4):
        chunk = f"CAST(('0x' || substr(md5({key}), {1 + 8 * i}, 8)) AS BIGINT)"
        acc = f"(({acc}) * 4294967296 + {chunk}) % {n}"
    return acc


@query("stable_pick", f"""
SELECT 'CAND_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS candidate_id,
  {md5_mod_sql("'CAND_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'sim'", 3)} AS pick3,
  {md5_mod_sql("'CAND_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'ten'", 2)} AS pick2,
  {md5_mod_sql("c_name", 1000003)} AS pick_big
FROM customer
""")
def stable_pick(spark, sf_dir):
    c = Bindings(spark, sf_dir).cand()
    return c.select("candidate_id",
                    R.md5_mod(F.concat(F.col("candidate_id"), F.lit("sim")), 3).alias("pick3"),
                    R.md5_mod(F.concat(F.col("candidate_id"), F.lit("ten")), 2).alias("pick2"),
                    R.md5_mod(F.col("anonymized_name"), 1000003).alias("pick_big"))


def _band_sql(x, cuts):
    e, h, m = cuts
    return (f"CASE WHEN {x} >= {e} THEN 'ELITE' WHEN {x} >= {h} THEN 'HIGH' "
            f"WHEN {x} >= {m} THEN 'MEDIUM' ELSE 'LOW' END")


@query("bands", f"""
WITH {SCORED_R6}
SELECT candidate_id, {_band_sql('cosine_similarity', (0.75, 0.50, 0.25))} AS sim_band,
  {_band_sql('intent_score', (0.75, 0.50, 0.30))} AS intent_band,
  {_band_sql('score', (2.5, 0.5, -0.5))} AS score_band
FROM r
""")
def bands(spark, sf_dir):
    s = scored_r6(spark, sf_dir)
    return s.select("candidate_id", R.sim_band(F.col("cosine_similarity")).alias("sim_band"),
                    R.intent_band(F.col("intent_score")).alias("intent_band"),
                    R.score_band(F.col("score")).alias("score_band"))


def _shares_sql(sim, intent):
    a, b = f"({sim} * 0.6)", f"({intent} * 0.4)"
    sim_pct = f"(CASE WHEN {a} + {b} < 1e-9 THEN 50.0 ELSE {a} / ({a} + {b}) * 100.0 END)"
    int_pct = f"(CASE WHEN {a} + {b} < 1e-9 THEN 50.0 ELSE 100.0 - {sim_pct} END)"
    return sim_pct, int_pct


def _attribution_sql(sim, intent):
    sp, ip = _shares_sql(sim, intent)
    fs, fi = f"printf('%.0f', {sp})", f"printf('%.0f', {ip})"
    bal, simd, intd = (R.ATTRIBUTION[k][0] for k in ("balanced", "sim", "int"))

    def fill(t):
        return "'" + t.replace("{sim}", f"' || {fs} || '").replace("{int}", f"' || {fi} || '") + "'"

    return (f"CASE WHEN abs({sp} - {ip}) <= 15.0 THEN {fill(bal)} "
            f"WHEN {sp} > {ip} THEN {fill(simd)} ELSE {fill(intd)} END")


@query("attribution", f"""
WITH {SCORED_R6}
SELECT candidate_id, round_even({_shares_sql('cosine_similarity', 'intent_score')[0]}, 6) AS sim_pct,
  round_even({_shares_sql('cosine_similarity', 'intent_score')[1]}, 6) AS int_pct,
  {_attribution_sql('cosine_similarity', 'intent_score')} AS attribution
FROM r
""")
def attribution(spark, sf_dir):
    s = scored_r6(spark, sf_dir)
    sp, ip = R.shares(F.col("cosine_similarity"), F.col("intent_score"), CFG.sim_weight, CFG.int_weight)
    return s.select("candidate_id", round6(sp).alias("sim_pct"), round6(ip).alias("int_pct"),
                    R.attribution(F.col("cosine_similarity"), F.col("intent_score"),
                                  CFG.sim_weight, CFG.int_weight).alias("attribution"))


def _pick_sql(pool, key):
    n = len(pool)
    arms = " ".join("WHEN {} THEN '{}'".format(i, p.replace("'", "''")) for i, p in enumerate(pool))
    return f"(CASE {md5_mod_sql(key, n)} {arms} END)"


def _pooled_sql(band_expr, pools, key):
    arms = " ".join(f"WHEN {band_expr} = '{bnd}' THEN {_pick_sql(pools[bnd], key)}" for bnd in R.BANDS)
    return f"(CASE {arms} END)"


def _traj_sql(cid, vel, ten, dur):
    v = (f"CASE WHEN {vel} >= 0.40 THEN {_pick_sql(R.VEL_HIGH_POOL, cid + ' || ' + repr('vel'))} "
         f"WHEN {vel} > 0 THEN {_pick_sql(R.VEL_LOW_POOL, cid + ' || ' + repr('vel'))} END")
    t = f"CASE WHEN {ten} > 0 AND {ten} < 1.5 THEN {_pick_sql(R.TEN_SHORT_POOL, cid + ' || ' + repr('ten'))} END"
    d = f"CASE WHEN {dur} >= 8.0 THEN {_pick_sql(R.DUR_LONG_POOL, cid + ' || ' + repr('dur'))} END"
    return f"nullif(concat_ws(' ', {v}, {t}, {d}), '')"


def _shortlist_with_traj(spark, sf_dir):
    """The shortlist left-joined with trajectory features.  Roles are cut
    to the shortlisted ids first (semi-join with the k-row shortlist, a
    bounded broadcast), then aggregated."""
    b = Bindings(spark, sf_dir)
    short = shortlist_r6(spark, sf_dir)
    short = cut_lineage(short)  # k rows, read twice below
    keys = short.select("c_custkey")
    roles = b.career().join(F.broadcast(keys), "c_custkey", "left_semi")
    traj = trajectory_by_role(roles, "c_custkey", ref_date=CFG.ref_date)
    return short.join(traj, "c_custkey", "left")


TRAJ_SHORT_SQL = f"""{SHORT_SQL}, {CAREER_FULL_SQL},
st AS (SELECT short.*, CASE WHEN coalesce(total, 0) > 0 THEN round_even(n / (total / 12.0), 4)
    WHEN traj.c_custkey IS NULL THEN NULL ELSE 0.0 END AS promotion_velocity,
  total / 12.0 AS total_career_duration, a / 12.0 AS avg_tenure_per_role
  FROM short LEFT JOIN traj ON traj.c_custkey = short.c_custkey)"""


@query("trajectory_note", f"""
WITH {TRAJ_SHORT_SQL}
SELECT candidate_id, {_traj_sql('candidate_id', 'promotion_velocity', 'avg_tenure_per_role', 'total_career_duration')} AS note
FROM st
""")
def trajectory_note(spark, sf_dir):
    j = _shortlist_with_traj(spark, sf_dir)
    return j.select("candidate_id", R.trajectory_note(F.col("candidate_id"), F.col("promotion_velocity"),
                                                      F.col("avg_tenure_per_role"),
                                                      F.col("total_career_duration")).alias("note"))


@query("rationale", f"""
WITH {TRAJ_SHORT_SQL}
SELECT candidate_id, rank, concat_ws(' ',
  {_pooled_sql(_band_sql('cosine_similarity', (0.75, 0.50, 0.25)), R.SIM_POOLS, "candidate_id || 'sim'")},
  {_attribution_sql('cosine_similarity', 'intent_score')},
  {_pooled_sql(_band_sql('intent_score', (0.75, 0.50, 0.30)), R.INTENT_POOLS, "candidate_id || 'int'")},
  {_traj_sql('candidate_id', 'promotion_velocity', 'avg_tenure_per_role', 'total_career_duration')},
  {_pooled_sql(_band_sql('score', (2.5, 0.5, -0.5)), R.CONCLUSION_POOLS, "candidate_id || 'aln'")}) AS rationale
FROM st
""")
def rationale(spark, sf_dir):
    """Explain the ranked shortlist (J1 + T13)."""
    j = _shortlist_with_traj(spark, sf_dir)
    return j.select("candidate_id", "rank", R.rationale(
        F.col("candidate_id"), F.col("cosine_similarity"), F.col("intent_score"), F.col("score"),
        F.col("promotion_velocity"), F.col("avg_tenure_per_role"), F.col("total_career_duration"),
        CFG.sim_weight, CFG.int_weight).alias("rationale"))
