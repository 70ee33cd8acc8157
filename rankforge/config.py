"""Parameters and fixed values.

Everything a job may want to change is a field of ``RankConfig``.  The
module-level constants below are FIXED VALUES: they must equal the
behaviour being reproduced (column names, keyword lists, cut-offs), so
they are stated plainly, in natural order, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Columns dropped by the privacy projection (case-insensitive, trimmed match).
PII_COLUMNS = (
    "name", "full_name", "first_name", "last_name",
    "email", "email_address", "phone", "phone_number", "mobile",
    "gender", "sex", "dob", "date_of_birth", "age",
    "address", "city", "state", "country", "pincode", "zip_code",
    "photo", "photo_url", "linkedin_url", "github_url",
    "religion", "caste", "nationality", "marital_status",
    "anonymized_name", "location",
    "headline_raw", "summary_raw", "career_history_raw",
)

# Substrings that mark a bogus record in its id or display name (any case).
BOGUS_KEYWORDS = ("honeypot", "fake", "dummy", "spam", "test_user")

# Valid range of years of experience (inclusive).
YOE_MIN = 0.0
YOE_MAX = 60.0

# Reference date for recency features.
REF_DATE = "2026-06-04"

# End-date tokens meaning "still in this role".
OPEN_END_TOKENS = ("present", "current", "", "none", "null")

# The eleven raw behaviour signal keys, in order.
SIGNAL_KEYS = (
    "profile_completeness_score",
    "open_to_work_flag",
    "profile_views_received_30d",
    "applications_submitted_30d",
    "recruiter_response_rate",
    "avg_response_time_hours",
    "connection_count",
    "notice_period_days",
    "github_activity_score",
    "interview_completion_rate",
    "offer_acceptance_rate",
)

# Declared intent columns that always come first in the intent matrix.
DECLARED_INTENT_COLUMNS = (
    "profile_update_frequency",
    "submission_timestamp_index",
    "interaction_history_index",
)

# The 17 numeric columns of the flat candidate table, in order.
FLAT_NUMERIC_COLUMNS = (
    "years_of_experience", "total_career_duration", "avg_tenure_per_role",
    "promotion_velocity", "profile_completeness_score", "open_to_work_flag",
    "profile_views_received_30d", "applications_submitted_30d",
    "recruiter_response_rate", "avg_response_time_hours", "connection_count",
    "skill_assessment_scores", "days_since_last_active", "days_since_signup",
    "profile_update_frequency", "submission_timestamp_index",
    "interaction_history_index",
)

# Trajectory columns added by the career feature stage, in order.
TRAJECTORY_COLUMNS = (
    "total_duration_months", "num_transitions", "avg_tenure_months",
    "career_velocity_score",
)

# Text columns tried, in order, when choosing the text to vectorise.
TEXT_COLUMN_PREFERENCE = ("text_normalized", "skills_clean", "experience_text", "skills_raw")

# Name fragments that mark a column as free text for normalisation.
TEXT_COLUMN_HINTS = ("experience", "description", "profile", "text")

# Shortlist columns, in order.
SUBMISSION_COLUMNS = ("candidate_id", "rank", "score", "reasoning")

# Reason sentence tiers (ranker form): cosine, intent, overall score.
REASON_COSINE_TIERS = (0.35, 0.25)
REASON_INTENT_TIERS = (0.55, 0.35)
REASON_SCORE_TIERS = (0.40, 0.30, 0.20)

# Band cut-offs (explainer form), inclusive lower bounds ELITE / HIGH / MEDIUM.
BAND_SIM = (0.75, 0.50, 0.25)
BAND_INTENT = (0.75, 0.50, 0.30)
BAND_SCORE = (2.5, 0.5, -0.5)

# Trajectory comment cut-offs: velocity high, tenure short, duration long.
TRAJ_VELOCITY_HIGH = 0.40
TRAJ_TENURE_SHORT = 1.5
TRAJ_DURATION_LONG = 8.0

# Attribution: balanced when the two shares differ by at most this many points.
ATTRIBUTION_BALANCE_POINTS = 15.0

# Defaults of the metadata reason sentence when a field or the id is missing.
META_DEFAULT_TITLE = "Software Engineer"
META_UNKNOWN_SENTENCE = "Data Scientist with 5.0 yrs; 8 AI core skills; response rate 0.80."

# Group size cap for the learning-to-rank groups.
MAX_GROUP_SIZE = 10_000


@dataclass(frozen=True)
class RankConfig:
    """Run parameters (defaults follow the reproduced job)."""

    ref_date: str = REF_DATE
    top_k: int = 100
    ndcg_k: int = 10
    cosine_weight: float = 0.7
    intent_weight: float = 0.3
    label_quantiles: tuple = (0.25, 0.50, 0.75)
    max_group_size: int = MAX_GROUP_SIZE
    sim_weight: float = 0.6      # explainer attribution weights (must sum to 1)
    int_weight: float = 0.4
    # learning to rank
    rounds: int = 200
    learning_rate: float = 0.05
    max_depth: int = 6
    max_leaves: int = 31
    min_rows_per_leaf: int = 5
    max_bins: int = 255
    column_sample: float = 0.8
    # truncation level of the objective: pairs whose better-ranked member is
    # among the first so many positions; 0: all pairs of a group
    pair_top: int = 30
    seed: int = 42
    pii_columns: tuple = field(default=PII_COLUMNS)
