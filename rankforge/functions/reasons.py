"""Plain-language reasons as built-in expressions.

Sentence wording is this project's own; the behaviour kept from the
reproduced job is the tiering, the cut-offs, the per-dimension salts of the
stable pick and the number formats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (ATTRIBUTION_BALANCE_POINTS, BAND_INTENT, BAND_SCORE, BAND_SIM,
                      META_DEFAULT_TITLE, META_UNKNOWN_SENTENCE, REASON_COSINE_TIERS,
                      REASON_INTENT_TIERS, REASON_SCORE_TIERS, TRAJ_DURATION_LONG,
                      TRAJ_TENURE_SHORT, TRAJ_VELOCITY_HIGH)
from .text import fixed

BANDS = ("ELITE", "HIGH", "MEDIUM", "LOW")

# ---------------------------------------------------------------------------
# Stable pick
# ---------------------------------------------------------------------------


def md5_mod(key: Column, n: int) -> Column:
    """int(md5(key), 16) % n, by Horner's rule over four 32-bit hex chunks
    (exact for n < 2**31)."""
    h = F.md5(key.cast("string"))
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        chunk = F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * F.lit(4294967296) + chunk, F.lit(n))
    return acc


def stable_pick(pool: Sequence[str], key: Column) -> Column:
    """One element of ``pool`` chosen by the md5 of ``key``."""
    arr = F.array(*[F.lit(p) for p in pool])
    return F.element_at(arr, (md5_mod(key, len(pool)) + 1).cast("int"))


# ---------------------------------------------------------------------------
# Tiered reason of the ranker
# ---------------------------------------------------------------------------


def reason_sentence(cos: Column, intent: Column, score: Column) -> Column:
    c_hi, c_mid = REASON_COSINE_TIERS
    i_hi, i_mid = REASON_INTENT_TIERS
    s1, s2, s3 = REASON_SCORE_TIERS
    sem = (F.when(cos >= c_hi, "strong").when(cos >= c_mid, "fair").otherwise("limited"))
    beh = (F.when(intent >= i_hi, "high").when(intent >= i_mid, "steady").otherwise("light"))
    overall = (F.when(score >= s1, "Top match").when(score >= s2, "Strong match")
                .when(score >= s3, "Reasonable match").otherwise("Developing match"))
    return F.concat(overall, F.lit(". Profile text shows "), sem,
                    F.lit(" overlap with the role (cosine "), fixed(cos, 4),
                    F.lit("); activity on the platform is "), beh,
                    F.lit(" (intent "), fixed(intent, 4), F.lit("). Overall score "),
                    fixed(score, 4), F.lit("."))


# ---------------------------------------------------------------------------
# Metadata reason (the sentence format is a fixed value)
# ---------------------------------------------------------------------------


def metadata_sentence(known: Column, title: Column, years: Column, n_skills: Column,
                      response_rate: Column) -> Column:
    """'<title> with <years, 1 dp> yrs; <n> AI core skills; response rate <2 dp>.'"""
    t = F.coalesce(title, F.lit(META_DEFAULT_TITLE))
    y = fixed(F.coalesce(years.cast("double"), F.lit(0.0)), 1)
    n = F.coalesce(n_skills, F.lit(0)).cast("string")
    r = fixed(F.coalesce(response_rate.cast("double"), F.lit(0.0)), 2)
    s = F.concat(t, F.lit(" with "), y, F.lit(" yrs; "), n, F.lit(" AI core skills; response rate "),
                 r, F.lit("."))
    return F.when(known, s).otherwise(F.lit(META_UNKNOWN_SENTENCE))


# ---------------------------------------------------------------------------
# bands
# ---------------------------------------------------------------------------


def band(x: Column, cuts: Sequence[float]) -> Column:
    elite, high, medium = cuts
    return (F.when(x >= elite, "ELITE").when(x >= high, "HIGH").when(x >= medium, "MEDIUM")
             .otherwise("LOW"))


def sim_band(x: Column) -> Column:
    return band(x, BAND_SIM)


def intent_band(x: Column) -> Column:
    return band(x, BAND_INTENT)


def score_band(x: Column) -> Column:
    return band(x, BAND_SCORE)


# ---------------------------------------------------------------------------
# phrase pools (own wording): three per band, two for tenure and duration
# ---------------------------------------------------------------------------

SIM_POOLS = {
    "ELITE": ("The profile text mirrors the role description almost point for point.",
              "Capabilities described in the profile line up closely with every core need of the role.",
              "Few profiles match the wording and substance of this role as tightly."),
    "HIGH": ("The profile covers most of what the role asks for.",
             "Skills and experience overlap well with the role description.",
             "A clear majority of the role's requirements appear in the profile."),
    "MEDIUM": ("The profile touches on several parts of the role.",
               "Some of the role's requirements show up in the profile text.",
               "There is partial overlap between the profile and the role."),
    "LOW": ("The profile text says little about this role's requirements.",
            "Overlap with the role description is thin.",
            "Only faint traces of the role's needs appear in the profile."),
}
INTENT_POOLS = {
    "ELITE": ("Platform activity is at the very top of the pool.",
              "Engagement signals are exceptionally strong.",
              "Recent activity and responsiveness stand out across the pool."),
    "HIGH": ("Activity on the platform is well above average.",
             "Engagement signals are solid.",
             "The candidate is visibly active and responsive."),
    "MEDIUM": ("Platform activity is moderate.",
               "Engagement signals are middling.",
               "Activity is present but not pronounced."),
    "LOW": ("Platform activity is sparse.",
            "Engagement signals are weak so far.",
            "Little recent activity is recorded."),
}
CONCLUSION_POOLS = {
    "ELITE": ("Recommended as a first call.",
              "Belongs at the front of the shortlist.",
              "A priority candidate for this role."),
    "HIGH": ("Worth an early conversation.",
             "A strong entry on the shortlist.",
             "Recommended for review."),
    "MEDIUM": ("A reasonable backup option.",
               "Worth keeping on the list.",
               "Could fit with some ramp-up."),
    "LOW": ("Unlikely to be a close fit.",
            "Consider only if the pool is thin.",
            "Not a priority for this role."),
}
VEL_HIGH_POOL = ("Role changes come at a brisk pace.",
                 "Career moves have been frequent.",
                 "The track record shows quick progression.")
VEL_LOW_POOL = ("Career moves have been measured.",
                "Progression has been gradual.",
                "Role changes are spaced out.")
TEN_SHORT_POOL = ("Average time per role is short.",
                  "Roles tend to be held briefly.")
DUR_LONG_POOL = ("The career spans many years.",
                 "Experience runs deep in years.")
ATTRIBUTION = {
    "balanced": ("Capability and activity weigh about the same ({sim}% / {int}%).",),
    "sim": ("Capability carries {sim}% of the weighted signal, activity {int}%.",),
    "int": ("Activity carries {int}% of the weighted signal, capability {sim}%.",),
}


def pooled(band_col: Column, pools: dict, key: Column) -> Column:
    out = None
    for b in BANDS:
        pick = stable_pick(pools[b], key)
        out = F.when(band_col == b, pick) if out is None else out.when(band_col == b, pick)
    return out


def _template(text: str, sim_pct: Column, int_pct: Column) -> Column:
    head, rest = text.split("{sim}") if text.index("{sim}") < text.index("{int}") else (None, None)
    if head is not None:
        mid, tail = rest.split("{int}")
        return F.concat(F.lit(head), fixed(sim_pct, 0), F.lit(mid), fixed(int_pct, 0), F.lit(tail))
    head, rest = text.split("{int}")
    mid, tail = rest.split("{sim}")
    return F.concat(F.lit(head), fixed(int_pct, 0), F.lit(mid), fixed(sim_pct, 0), F.lit(tail))


def shares(sim: Column, intent: Column, sim_weight: float, int_weight: float):
    """Weighted shares in percent (50/50 when the total is ~0)."""
    if abs(sim_weight + int_weight - 1.0) > 1e-6:
        raise ValueError("attribution weights must sum to 1")
    a = sim * F.lit(sim_weight)
    b = intent * F.lit(int_weight)
    total = a + b
    sim_pct = F.when(total < 1e-9, F.lit(50.0)).otherwise(a / total * F.lit(100.0))
    int_pct = F.when(total < 1e-9, F.lit(50.0)).otherwise(F.lit(100.0) - sim_pct)
    return sim_pct, int_pct


def attribution(sim: Column, intent: Column, sim_weight: float = 0.6,
                int_weight: float = 0.4) -> Column:
    sim_pct, int_pct = shares(sim, intent, sim_weight, int_weight)
    balanced = F.abs(sim_pct - int_pct) <= ATTRIBUTION_BALANCE_POINTS
    return (F.when(balanced, _template(ATTRIBUTION["balanced"][0], sim_pct, int_pct))
             .when(sim_pct > int_pct, _template(ATTRIBUTION["sim"][0], sim_pct, int_pct))
             .otherwise(_template(ATTRIBUTION["int"][0], sim_pct, int_pct)))


def attribution_kind(sim: Column, intent: Column, sim_weight: float = 0.6,
                     int_weight: float = 0.4) -> Column:
    sim_pct, int_pct = shares(sim, intent, sim_weight, int_weight)
    return (F.when(F.abs(sim_pct - int_pct) <= ATTRIBUTION_BALANCE_POINTS, "balanced")
             .when(sim_pct > int_pct, "sim").otherwise("int"))


def trajectory_note(cid: Column, velocity: Column | None, tenure: Column | None,
                    duration: Column | None) -> Column:
    """Space-joined comments; NULL inputs and no comment -> NULL."""
    key = cid.cast("string")
    parts = []
    if velocity is not None:
        parts.append(F.when(velocity >= TRAJ_VELOCITY_HIGH, stable_pick(VEL_HIGH_POOL, F.concat(key, F.lit("vel"))))
                      .when(velocity > 0, stable_pick(VEL_LOW_POOL, F.concat(key, F.lit("vel")))))
    if tenure is not None:
        parts.append(F.when((tenure > 0) & (tenure < TRAJ_TENURE_SHORT),
                            stable_pick(TEN_SHORT_POOL, F.concat(key, F.lit("ten")))))
    if duration is not None:
        parts.append(F.when(duration >= TRAJ_DURATION_LONG,
                            stable_pick(DUR_LONG_POOL, F.concat(key, F.lit("dur")))))
    if not parts:
        return F.lit(None).cast("string")
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", F.lit(None).cast("string")).otherwise(joined)


def rationale(cid: Column, sim: Column, intent: Column, score: Column,
              velocity: Column | None = None, tenure: Column | None = None,
              duration: Column | None = None, sim_weight: float = 0.6,
              int_weight: float = 0.4) -> Column:
    """Sim phrase, attribution, intent phrase, [trajectory], conclusion."""
    key = cid.cast("string")
    clause_sim = pooled(sim_band(sim), SIM_POOLS, F.concat(key, F.lit("sim")))
    clause_int = pooled(intent_band(intent), INTENT_POOLS, F.concat(key, F.lit("int")))
    clause_end = pooled(score_band(score), CONCLUSION_POOLS, F.concat(key, F.lit("aln")))
    traj = trajectory_note(cid, velocity, tenure, duration)
    return F.concat_ws(" ", clause_sim, attribution(sim, intent, sim_weight, int_weight),
                       clause_int, traj, clause_end)
