"""Driver queries for ingestion-side operators: imputation, filters,
shredding, text, career (A1-A4, F1-F6, P1-P13, T1-T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PII_COLUMNS, RankConfig
from ..functions import variant as V
from ..functions.text import month_diff, parse_partial_date
from ..operators import clean, stats as S
from ..operators.career import trajectory_basic_by_role, trajectory_by_role
from ..operators.features import add_missing_columns, numeric_feature_columns
from ..operators.privacy import drop_pii
from ..operators.rank import round6
from ..operators.taxonomy import fold, merge_text, normalize_text_columns
from . import oracle_sql as O
from .bindings import EVENT_TYPES, Bindings
from .registry import query
from .slice import SLICE_COLS, slice_imputed, slice_raw

CFG = RankConfig()


def _r6(df, cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


def _sql_r6(cols, prefix=""):
    return ", ".join(f"round_even({prefix}{c}, 6) AS {c}" for c in cols)


# ---------------------------------------------------------------------------
# A1 median_impute
# ---------------------------------------------------------------------------

@query("median_impute", f"""
WITH {O.CAND}, {O.SIGF},
raw AS (SELECT cand.candidate_id, cand.c_custkey, cand.years_of_experience,
  {", ".join(f"s.{c}" for c in SLICE_COLS[1:])}
  FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey),
{O.median_impute_ctes("raw", SLICE_COLS)}
SELECT candidate_id, {_sql_r6(SLICE_COLS)} FROM imp
""")
def median_impute(spark, sf_dir):
    imp = slice_imputed(Bindings(spark, sf_dir), CFG)
    return _r6(imp.select("candidate_id", *SLICE_COLS), SLICE_COLS)


# ---------------------------------------------------------------------------
# A2 impute_all_columns: numerics from the schema -> median, text -> ''
# ---------------------------------------------------------------------------

A2_NUM = ("c_custkey", "years_of_experience", *SLICE_COLS[1:])
A2_TXT = ("candidate_id", "anonymized_name", "country", "headline", "text", "lang")


def _a2_frame(b):
    return (slice_raw(b).join(b.cand().select("c_custkey", "anonymized_name", "country", "headline"),
                              "c_custkey")
            .join(b.captext(), "c_custkey", "left"))


@query("impute_all_columns", f"""
WITH {O.CAND}, {O.SIGF},
raw AS (SELECT cand.*, {", ".join(f"s.{c}" for c in SLICE_COLS[1:])}, d.text, d.lang
  FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey
  LEFT JOIN documents d ON d.doc_id = cand.c_custkey),
med AS (SELECT {", ".join(f"coalesce(median({c}), 0.0) AS m_{c}" for c in A2_NUM)} FROM raw)
SELECT {", ".join(f"round_even(coalesce({c}, m_{c}), 6) AS {c}" for c in A2_NUM)},
       {", ".join(f"coalesce({c}, '') AS {c}" for c in A2_TXT)}
FROM raw, med
""")
def impute_all_columns(spark, sf_dir):
    frame = _a2_frame(Bindings(spark, sf_dir))
    filled, _ = clean.impute(frame)
    out = filled.select(*A2_NUM, *A2_TXT)
    return _r6(out.withColumn("c_custkey", F.col("c_custkey").cast("double")), A2_NUM)


# ---------------------------------------------------------------------------
# F1-F6 filters
# ---------------------------------------------------------------------------

KW = clean.keyword_pattern()


@query("keyword_flag", f"""
SELECT 'part' AS kind, p_partkey AS key, regexp_matches(lower(p_name), '{KW}') AS is_bogus FROM part
UNION ALL
SELECT 'customer', c_custkey, regexp_matches(lower(c_name), '{KW}') FROM customer
UNION ALL
SELECT 'document', doc_id, regexp_matches(lower(text), '{KW}') FROM documents
""")
def keyword_flag(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    parts = b.t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"),
                            clean.has_bogus_keyword(F.col("p_name")).alias("is_bogus"))
    cust = b.t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"),
                               clean.has_bogus_keyword(F.col("c_name")).alias("is_bogus"))
    docs = b.t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"),
                                clean.has_bogus_keyword(F.col("text")).alias("is_bogus"))
    return parts.unionByName(cust).unionByName(docs)


@query("experience_range", f"""
WITH {O.CAND}
SELECT candidate_id, round_even(years_of_experience, 6) AS years_of_experience,
  coalesce(years_of_experience IS NULL OR isnan(years_of_experience)
           OR years_of_experience < 0 OR years_of_experience > 60, true) AS out_of_range
FROM cand
""")
def experience_range(spark, sf_dir):
    c = Bindings(spark, sf_dir).cand()
    return c.select("candidate_id", round6(F.col("years_of_experience")).alias("years_of_experience"),
                    clean.experience_out_of_range(F.col("years_of_experience")).alias("out_of_range"))


SKILLS_SQL = """skills AS (
  SELECT c_custkey, string_agg(skill, ', ' ORDER BY skill) AS skills_raw
  FROM (SELECT DISTINCT o.o_custkey AS c_custkey, p.p_name AS skill
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON l.l_partkey = p.p_partkey) GROUP BY c_custkey)"""


def skills_table(b: Bindings):
    """c_custkey, skills_raw: sorted distinct skill names joined by ', '.

    ``collect_set`` de-duplicates map-side, so one shuffle carries at most
    one partial set per customer and task, even for a customer holding a
    third of all line items."""
    return (b.skill_pairs().groupBy("c_custkey")
             .agg(F.array_join(F.array_sort(F.collect_set("skill")), ", ").alias("skills_raw")))


def _profile_frame(b: Bindings):
    """Candidates with skills and text; every 7th text and every 14th skill
    list is white space only (tabs and line ends, not just blanks)."""
    key = F.col("c_custkey")
    return (b.cand().join(skills_table(b), "c_custkey", "left")
             .join(b.captext().select("c_custkey", F.col("text").alias("experience_text")),
                   "c_custkey", "left")
             .withColumn("skills_raw", F.when(key % 14 == 0, F.lit("\t ")).otherwise(F.col("skills_raw")))
             .withColumn("experience_text", F.when(key % 7 == 0, F.lit("\t\n ")).otherwise(F.col("experience_text"))))


def _blank_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[\\s\\x1c-\\x1f]+', '', 'g') = ''"


BLANK_SQL = f"({_blank_sql('skills_raw')} AND {_blank_sql('experience_text')})"

PROFILE_SQL = f"""{O.CAND}, {SKILLS_SQL},
prof AS (SELECT cand.*, CASE WHEN cand.c_custkey % 14 = 0 THEN chr(9) || ' ' ELSE s.skills_raw END AS skills_raw,
  CASE WHEN cand.c_custkey % 7 = 0 THEN chr(9) || chr(10) || ' ' ELSE d.text END AS experience_text FROM cand
  LEFT JOIN skills s ON s.c_custkey = cand.c_custkey
  LEFT JOIN documents d ON d.doc_id = cand.c_custkey)"""


@query("empty_profile", f"""
WITH {PROFILE_SQL}
SELECT candidate_id,
  {BLANK_SQL} AS is_empty
FROM prof
""")
def empty_profile(spark, sf_dir):
    p = _profile_frame(Bindings(spark, sf_dir))
    return p.select("candidate_id",
                    clean.empty_profile(F.col("skills_raw"), F.col("experience_text")).alias("is_empty"))


@query("sweep", f"""
WITH {PROFILE_SQL}
SELECT candidate_id, round_even(years_of_experience, 6) AS years_of_experience
FROM prof
WHERE NOT (regexp_matches(lower(candidate_id), '{KW}') OR regexp_matches(lower(anonymized_name), '{KW}')
  OR years_of_experience < 0 OR years_of_experience > 60 OR years_of_experience IS NULL
  OR ({BLANK_SQL}))
""")
def sweep(spark, sf_dir):
    p = _profile_frame(Bindings(spark, sf_dir))
    p = S.apply_medians(p, {}, ["skills_raw", "experience_text"])
    kept = clean.sweep(p, skills_col="skills_raw", text_col="experience_text")
    return kept.select("candidate_id", round6(F.col("years_of_experience")).alias("years_of_experience"))


@query("inert_profile", f"""
WITH {O.CAND}, {O.SIGF}
SELECT cand.candidate_id,
  coalesce(s.n_purchase, 0) = 0 AND coalesce(s.n_click, 0) = 0 AND coalesce(s.n_signup, 0) = 0 AS is_inert
FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey
""")
def inert_profile(spark, sf_dir):
    r = slice_raw(Bindings(spark, sf_dir))
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("n_purchase", "n_click", "n_signup")}
    return r.select("candidate_id", clean.inert_profile(z["n_purchase"], z["n_click"], z["n_signup"])
                    .alias("is_inert"))


@query("zero_signals", f"""
WITH {O.CAND}, {O.SIGF}
SELECT cand.candidate_id,
  {" AND ".join(f"coalesce(s.n_{t}, 0) = 0" for t in EVENT_TYPES)} AS all_zero
FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey
""")
def zero_signals(spark, sf_dir):
    r = slice_raw(Bindings(spark, sf_dir))
    cols = [f"n_{t}" for t in EVENT_TYPES]
    r = r.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})
    return r.select("candidate_id", clean.zero_signals(cols).alias("all_zero"))


# ---------------------------------------------------------------------------
# Tolerant shredding of JSON text through VARIANT
# ---------------------------------------------------------------------------

@query("profile_shred", """
SELECT event_id,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) = 0 THEN ''
       ELSE coalesce(json_extract_string(props, '$.k'), '') END AS k_text,
  '' AS missing_text
FROM events
""")
def profile_shred(spark, sf_dir):
    e = Bindings(spark, sf_dir).t.events.select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", V.tolerant_double(F.col("v"), "$.k").alias("k"),
                    V.text_field(F.col("v"), "$.k").alias("k_text"),
                    V.text_field(F.col("v"), "$.profile.missing").alias("missing_text"))


def _flag_json():
    """One JSON document per event whose flag takes every polymorphic shape."""
    shape = (F.when(F.col("event_type") == "click", F.lit('"TRUE"'))
              .when(F.col("event_type") == "view", F.lit('"yes"'))
              .when(F.col("event_type") == "purchase",
                    F.when(F.col("value") > 50, F.lit("1")).otherwise(F.lit("0")))
              .when(F.col("event_type") == "signup",
                    F.when(F.col("value") > 50, F.lit("true")).otherwise(F.lit('"1"')))
              .otherwise(F.lit("null")))
    return F.concat(F.lit('{"signals": {"open_to_work_flag": '), shape, F.lit("}}"))


@query("open_flag", """
SELECT event_id,
  CAST(CASE WHEN event_type = 'click' THEN 1
       WHEN event_type = 'view' THEN 0
       WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 1 ELSE 0 END
       WHEN event_type = 'signup' THEN 1
       ELSE 0 END AS DOUBLE) AS open_to_work_flag
FROM events
""")
def open_flag(spark, sf_dir):
    e = Bindings(spark, sf_dir).t.events
    v = F.try_parse_json(_flag_json())
    return e.select("event_id", V.tolerant_flag(v, "$.signals.open_to_work_flag").alias("open_to_work_flag"))


@query("assessment_mean", """
SELECT event_id, round_even(CASE
  WHEN event_type = 'click' THEN (value + CAST(json_extract(props, '$.k') AS DOUBLE)) / 2
  WHEN event_type = 'view' THEN (value + CAST(json_extract(props, '$.k') AS DOUBLE)) / 2
  WHEN event_type = 'purchase' THEN value
  ELSE NULL END, 6) AS skill_assessment_scores
FROM events
""")
def assessment_mean(spark, sf_dir):
    e = Bindings(spark, sf_dir).t.events
    k = F.get_json_object("props", "$.k")
    val = F.col("value").cast("string")
    doc = (F.when(F.col("event_type") == "click",
                  F.concat(F.lit('{"s": {"python": '), val, F.lit(', "sql": '), k, F.lit("}}")))
            .when(F.col("event_type") == "view",
                  F.concat(F.lit('{"s": ['), val, F.lit(', "n/a", '), k, F.lit("]}")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit('{"s": '), val, F.lit("}")))
            .when(F.col("event_type") == "signup", F.lit('{"s": "oops"}'))
            .otherwise(F.lit('{"s": null}')))
    v = F.try_parse_json(doc)
    return e.select("event_id", round6(V.mean_of_numbers(v, "$.s")).alias("skill_assessment_scores"))


# ---------------------------------------------------------------------------
# P4 skills_join: polymorphic skills list -> sorted ', '-joined text
# ---------------------------------------------------------------------------

@query("skills_join", f"""
WITH {SKILLS_SQL}
SELECT 'CAND_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS candidate_id, skills_raw FROM skills
""")
def skills_join(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    rows = b.skill_rows()   # de-duplicated (customer, skill) pairs
    # each skill becomes a string, an object with a name, or a padded string;
    # the list per customer is that customer's distinct skills (the output)
    item = (F.when(F.length("skill") % 2 == 0, F.to_json(F.struct(F.col("skill").alias("name"))))
             .otherwise(F.concat(F.lit('" '), F.col("skill"), F.lit(' "'))))
    docs = (rows.groupBy("c_custkey")
                .agg(F.array_sort(F.collect_list(F.struct("skill", item.alias("js")))).alias("items"))
                .select("c_custkey", F.concat(F.lit('{"skills": ['),
                                              F.array_join(F.transform("items", lambda s: s["js"]), ", "),
                                              F.lit("]}")).alias("doc")))
    v = F.try_parse_json(F.col("doc"))
    return docs.select(F.concat(F.lit("CAND_"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
                       .alias("candidate_id"), V.skills_text(v).alias("skills_raw"))


# ---------------------------------------------------------------------------
# P5 / P6 / P15 capability text
# ---------------------------------------------------------------------------

def py_strip(x):
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


@query("capability_text", f"""
WITH {O.CAND},
parts AS (SELECT cand.candidate_id,
  list_filter([cand.headline, coalesce(d.text, ''), r.r_name], lambda x: x <> '') AS p
  FROM cand LEFT JOIN documents d ON d.doc_id = cand.c_custkey
  JOIN customer c ON c.c_custkey = cand.c_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT candidate_id,
  array_to_string(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ') AS experience_text,
  concat_ws(' ', p[1], p[2], p[3]) AS signal_text
FROM parts
""")
def capability_text(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    c = b.t.customer.select("c_custkey", "c_nationkey")
    n = b.t.nation.select("n_nationkey", "n_regionkey")
    r = b.t.region.select("r_regionkey", "r_name")
    frame = (b.cand().join(b.captext().select("c_custkey", "text"), "c_custkey", "left")
             .join(c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
                   .select("c_custkey", "r_name"), "c_custkey"))
    parts = F.filter(F.array(F.col("headline"), F.coalesce(F.col("text"), F.lit("")), F.col("r_name")),
                     lambda x: x != "")
    exp_text = F.array_join(F.transform(parts, py_strip), " ")
    signal_text = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in
                                      (F.col("headline"), F.coalesce(F.col("text"), F.lit("")),
                                       F.col("r_name"))])
    return frame.select("candidate_id", exp_text.alias("experience_text"),
                        signal_text.alias("signal_text"))


# ---------------------------------------------------------------------------
# P8 / P9 days since, derived copies
# ---------------------------------------------------------------------------

@query("days_since", f"""
WITH {O.SIGF}
SELECT c_custkey,
  round_even(days_since_last_active, 6) AS days_since_last_active,
  round_even(days_since_signup, 6) AS days_since_signup,
  round_even(-days_since_last_active, 6) AS submission_timestamp_index,
  n_view AS profile_update_frequency, n_click AS interaction_history_index
FROM sigf
""")
def days_since(spark, sf_dir):
    s = Bindings(spark, sf_dir).sig_features(CFG.ref_date)
    return s.select("c_custkey", round6(F.col("days_since_last_active")).alias("days_since_last_active"),
                    round6(F.col("days_since_signup")).alias("days_since_signup"),
                    round6(-F.col("days_since_last_active")).alias("submission_timestamp_index"),
                    F.col("n_view").alias("profile_update_frequency"),
                    F.col("n_click").alias("interaction_history_index"))


# ---------------------------------------------------------------------------
# P10 privacy projection, P12 defaults, P13 numeric pick
# ---------------------------------------------------------------------------

@query("pii_drop", f"""
WITH {O.CAND}
SELECT candidate_id, c_custkey, years_of_experience, headline FROM cand
""")
def pii_drop(spark, sf_dir):
    c = Bindings(spark, sf_dir).cand()
    c = c.withColumns({" Email ": F.concat(F.col("anonymized_name"), F.lit("@example.org")),
                       "CITY": F.col("country"), "location": F.col("country")})
    out = drop_pii(c, PII_COLUMNS)
    return out.withColumn("years_of_experience", F.col("years_of_experience"))


@query("default_columns", f"""
WITH {O.CAND}
SELECT candidate_id, round_even(years_of_experience, 6) AS years_of_experience,
  CAST(0 AS DOUBLE) AS total_duration_months, CAST(0 AS BIGINT) AS num_transitions,
  CAST(0 AS DOUBLE) AS avg_tenure_months, CAST(0 AS DOUBLE) AS career_velocity_score
FROM cand
""")
def default_columns(spark, sf_dir):
    c = Bindings(spark, sf_dir).cand().select("candidate_id", "years_of_experience")
    c = add_missing_columns(c, {"years_of_experience": 1.0, "total_duration_months": 0.0,
                                "num_transitions": 0, "avg_tenure_months": 0.0,
                                "career_velocity_score": 0.0})
    return c.withColumn("years_of_experience", round6(F.col("years_of_experience"))) \
            .withColumn("num_transitions", F.col("num_transitions").cast("bigint"))


@query("numeric_pick", f"""
WITH {O.CAND}, {O.SIGF}
SELECT cand.c_custkey, s.n_view AS profile_update_frequency, round_even(cand.years_of_experience, 6) AS years_of_experience,
  s.n_click, s.n_view, round_even(s.avg_value, 6) AS avg_value
FROM cand LEFT JOIN sigf s ON s.c_custkey = cand.c_custkey
""")
def numeric_pick(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    s = b.sig_features().select("c_custkey", "n_click", "n_view", "avg_value")
    frame = (b.cand().select("candidate_id", "c_custkey", "anonymized_name", "years_of_experience")
             .join(s, "c_custkey", "left")
             .withColumn("profile_update_frequency", F.col("n_view"))
             .withColumn("user_id", F.col("c_custkey")))
    cols = numeric_feature_columns(frame)
    out = frame.select(*cols)
    return out.withColumns({"years_of_experience": round6(F.col("years_of_experience")),
                            "avg_value": round6(F.col("avg_value"))})


# ---------------------------------------------------------------------------
# T1 / T2 normalisation, T3 taxonomy, T4 merge
# ---------------------------------------------------------------------------

@query("normalize_text", r"""
SELECT doc_id, lang,
  trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM documents
""")
def normalize_text_q(spark, sf_dir):
    d = Bindings(spark, sf_dir).t.documents.select("doc_id", "lang", "text")
    return normalize_text_columns(d)


# Fixture taxonomy over the part-name vocabulary: one phrase nested in
# another, a chained pair, and a duplicated phrase (last value wins).
FIXTURE_TAXONOMY = (
    ("hot plate", "Cooktop"),
    ("plate", "Sheet Metal"),
    ("blue bolt", "Fastener"),
    ("fastener", "Hardware Fastener"),
    ("large widget", "Module"),
    ("module", "System Module"),
    ("red ring", "Seal"),
    ("cold rod", "Chilled Shaft"),
    ("rod", "Shaft"),
    ("red ring", "O-Ring"),
)


def _fold_sql(expr: str, taxonomy=FIXTURE_TAXONOMY) -> str:
    table: dict = {}
    for p, r in taxonomy:
        table[p] = r
    ordered = sorted(table.items(), key=lambda kv: len(kv[0]), reverse=True)
    out = expr
    for p, r in ordered:
        out = f"regexp_replace({out}, '\\b{p}\\b', '{r}', 'gi')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("taxonomy_fold", f"""
SELECT p_partkey, p_name, {_fold_sql("p_name")} AS folded FROM part
""")
def taxonomy_fold(spark, sf_dir):
    p = Bindings(spark, sf_dir).t.part.select("p_partkey", "p_name")
    return p.withColumn("folded", fold(F.col("p_name"), FIXTURE_TAXONOMY))


@query("text_merge", f"""
WITH {PROFILE_SQL},
t AS (SELECT candidate_id, coalesce(experience_text, '') AS e,
  {_fold_sql("coalesce(skills_raw, '')")} AS s, {_fold_sql("headline")} AS h FROM prof)
SELECT candidate_id, s AS skills_clean,
  array_to_string(list_filter([e, s, h], lambda x: regexp_matches(x, '\\S')), ' ') AS text_normalized
FROM t
""")
def text_merge(spark, sf_dir):
    p = _profile_frame(Bindings(spark, sf_dir))
    p = p.withColumn("skills_clean", fold(F.col("skills_raw"), FIXTURE_TAXONOMY))
    merged = merge_text(F.col("experience_text"), F.col("skills_clean"),
                        fold(F.col("headline"), FIXTURE_TAXONOMY))
    return p.select("candidate_id", "skills_clean", merged.alias("text_normalized"))


# ---------------------------------------------------------------------------
# T5 / T6 partial dates; A3 / A4 career features
# ---------------------------------------------------------------------------

@query("partial_dates", f"""
WITH {O.CAREER},
p AS (SELECT o_orderkey,
  coalesce(try_strptime(start_date, '%Y-%m'), TRY_CAST(start_date AS TIMESTAMP)) AS s,
  coalesce(try_strptime(end_date, '%Y-%m'), TRY_CAST(end_date AS TIMESTAMP)) AS e FROM career)
SELECT o_orderkey, s AS start_ts, e AS end_ts,
  CASE WHEN s IS NULL OR e IS NULL THEN NULL
       ELSE greatest(0, (year(e) - year(s)) * 12 + month(e) - month(s)) END AS months
FROM p
""")
def partial_dates(spark, sf_dir):
    c = Bindings(spark, sf_dir).career()
    s, e = parse_partial_date(F.col("start_date")), parse_partial_date(F.col("end_date"))
    return c.select("o_orderkey", s.cast("timestamp_ntz").alias("start_ts"),
                    e.cast("timestamp_ntz").alias("end_ts"),
                    F.when(s.isNull() | e.isNull(), F.lit(None)).otherwise(month_diff(s, e))
                    .cast("bigint").alias("months"))


#: Forms of a date for the query below, by order key: day, month or year given.
_FORMS = (("yyyy-MM-dd", "day"), ("MMM yyyy", "month"), ("MMMM yyyy", "month"), ("yyyy/MM", "month"), ("M/d/yyyy", "day"),
          ("d.M.yyyy", "day"), ("d MMMM yyyy", "day"), ("MMM d, yyyy", "day"), ("yyyy", "year"), ("MM-yyyy", "month"))


@query("free_dates", f"""
SELECT o_orderkey, CASE o_orderkey % {len(_FORMS) + 2}
  {" ".join(f"WHEN {i} THEN date_trunc('{unit}', o_orderdate)" for i, (_, unit) in enumerate(_FORMS))} ELSE NULL END::TIMESTAMP AS ts
FROM orders
""")
def free_dates(spark, sf_dir):
    """T5 on free forms ("Jan 2023", "2023/01", "3.1.2023") and junk."""
    o = Bindings(spark, sf_dir).t.orders
    which, told = F.pmod("o_orderkey", F.lit(len(_FORMS) + 2)), F.lit("13/45/2020")
    for i, (form, _) in enumerate(_FORMS):
        text = F.date_format("o_orderdate", form)
        told = F.when(which == i, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.upper(text))).otherwise(text)).otherwise(told)
    told = F.when(which == len(_FORMS), "present").otherwise(told)
    return (o.select("o_orderkey", told.alias("told"))
            .select("o_orderkey", parse_partial_date(F.col("told")).cast("timestamp_ntz").alias("ts")))


CAREER_FULL_SQL = f"""{O.CAREER},
roles AS (SELECT c_custkey,
  CASE WHEN duration_months IS NOT NULL THEN duration_months
       WHEN coalesce(try_strptime(start_date, '%Y-%m'), TRY_CAST(start_date AS TIMESTAMP)) IS NULL THEN NULL
       ELSE CAST(greatest(0,
         (year(e) - year(coalesce(try_strptime(start_date, '%Y-%m'), TRY_CAST(start_date AS TIMESTAMP)))) * 12
         + month(e) - month(coalesce(try_strptime(start_date, '%Y-%m'), TRY_CAST(start_date AS TIMESTAMP)))) AS DOUBLE)
  END AS m
  FROM (SELECT *, CASE WHEN is_current OR lower(trim(coalesce(end_date, 'none'))) IN ('present','current','','none','null')
                       THEN TIMESTAMP '2026-06-04'
                       ELSE coalesce(try_strptime(end_date, '%Y-%m'), TRY_CAST(end_date AS TIMESTAMP), TIMESTAMP '2026-06-04')
                  END AS e FROM career)),
traj AS (SELECT c_custkey, coalesce(sum(m), 0.0) AS total, count(m) AS n, coalesce(avg(m), 0.0) AS a
  FROM roles GROUP BY c_custkey)"""


@query("career_full", f"""
WITH {O.CAND}, {CAREER_FULL_SQL}
SELECT cand.candidate_id,
  round_even(coalesce(total, 0.0), 6) AS total_duration_months,
  coalesce(n, 0) AS num_transitions,
  round_even(coalesce(a, 0.0), 6) AS avg_tenure_months,
  CASE WHEN coalesce(total, 0) > 0 THEN round_even(n / (total / 12.0), 4) ELSE 0.0 END AS career_velocity_score,
  round_even(coalesce(total, 0.0) / 12.0, 6) AS total_career_duration,
  round_even(coalesce(a, 0.0) / 12.0, 6) AS avg_tenure_per_role
FROM cand LEFT JOIN traj ON traj.c_custkey = cand.c_custkey
""")
def career_full(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    traj = trajectory_by_role(b.career(), "c_custkey", ref_date=CFG.ref_date)
    out = b.cand().select("candidate_id", "c_custkey").join(traj, "c_custkey", "left")
    cols = ("total_duration_months", "avg_tenure_months", "total_career_duration", "avg_tenure_per_role")
    out = out.select("candidate_id",
                     *[round6(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols],
                     F.coalesce(F.col("num_transitions"), F.lit(0)).cast("bigint").alias("num_transitions"),
                     F.coalesce(F.col("career_velocity_score"), F.lit(0.0)).alias("career_velocity_score"))
    return out


@query("career_basic", f"""
WITH {O.CAND}, {O.CAREER},
t AS (SELECT c_custkey, sum(duration_months) AS s, count(duration_months) AS n, avg(duration_months) AS a
      FROM career GROUP BY c_custkey)
SELECT cand.candidate_id,
  CASE WHEN coalesce(n, 0) > 0 THEN round_even(s / 12.0, 6) ELSE 0.0 END AS total_career_duration,
  CASE WHEN coalesce(n, 0) > 0 THEN round_even(a / 12.0, 6) ELSE 0.0 END AS avg_tenure_per_role,
  CASE WHEN coalesce(n, 0) > 0 AND s / 12.0 > 0 THEN round_even(n / (s / 12.0), 6) ELSE 0.0 END AS promotion_velocity
FROM cand LEFT JOIN t ON t.c_custkey = cand.c_custkey
""")
def career_basic(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    t = trajectory_basic_by_role(b.career(), "c_custkey")
    out = b.cand().select("candidate_id", "c_custkey").join(t, "c_custkey", "left")
    cols = ("total_career_duration", "avg_tenure_per_role", "promotion_velocity")
    return out.select("candidate_id", *[round6(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols])


@query("sweep_report", f"""
WITH {PROFILE_SQL},
f AS (SELECT regexp_matches(lower(candidate_id), '{KW}') OR regexp_matches(lower(anonymized_name), '{KW}') AS f1,
  coalesce(years_of_experience IS NULL OR isnan(years_of_experience) OR years_of_experience < 0
           OR years_of_experience > 60, true) AS f2,
  {BLANK_SQL} AS f3 FROM prof)
SELECT count(*) AS rows_in, count_if(f1 OR f2 OR f3) AS rows_removed,
  count_if(f1) AS keyword_hits, count_if(f2) AS experience_out_of_range, count_if(f3) AS empty_profiles
FROM f
""")
def sweep_report(spark, sf_dir):
    """F4 report: rows in, rows removed, and the hits of each rule (one
    aggregate pass; the sweep itself reports through an Observation)."""
    p = _profile_frame(Bindings(spark, sf_dir))
    f1 = clean.has_bogus_keyword(F.col("candidate_id"), F.col("anonymized_name"))
    f2 = clean.experience_out_of_range(F.col("years_of_experience"))
    f3 = clean.empty_profile(F.col("skills_raw"), F.col("experience_text"))
    bad = clean.sweep_predicate(p, skills_col="skills_raw", text_col="experience_text")
    return p.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("rows_removed"),
                 F.count_if(f1).alias("keyword_hits"), F.count_if(f2).alias("experience_out_of_range"),
                 F.count_if(f3).alias("empty_profiles"))
