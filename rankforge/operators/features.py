"""Feature selection, intent scoring and composite vectors.

Column choices (P11, P13) are driver-side decisions over the schema, never
over rows.  Scaling uses frozen statistics from ``stats.fit_minmax`` so a
later batch or stream is scaled exactly like the fitting batch (M7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import DECLARED_INTENT_COLUMNS, SIGNAL_KEYS, TEXT_COLUMN_PREFERENCE
from ..functions.variant import tolerant_double
from ..session import cut_lineage
from . import stats as S


def pick_text_column(df: DataFrame, preference: Sequence[str] = TEXT_COLUMN_PREFERENCE) -> str:
    """The richest text column present; none -> error."""
    for c in preference:
        if c in df.columns:
            return c
    raise ValueError("no usable text column found in the profile table")


def add_missing_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add absent columns with a default literal."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def numeric_feature_columns(df: DataFrame,
                            declared: Sequence[str] = DECLARED_INTENT_COLUMNS) -> list[str]:
    """Declared columns first, then every other numeric column in frame
    order, skipping ``id`` and names ending in ``_id``."""
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, NumericType)
               and f.name.lower() != "id" and not f.name.lower().endswith("_id")]
    head = [c for c in declared if c in numeric]
    return head + [c for c in numeric if c not in head]


def mean_of(cols: Sequence[str]) -> F.Column:
    """Unweighted mean of columns (copies count twice, on purpose)."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return total / F.lit(float(len(cols)))


def fit_intent(df: DataFrame, cols: Sequence[str]) -> dict:
    """M5 fit: NULL -> 0 then min/max per column."""
    filled = df.select(*[F.coalesce(S.nan_to_null(F.col(c)), F.lit(0.0)).alias(c) for c in cols])
    return S.fit_minmax(filled, cols)


def apply_intent(df: DataFrame, stats: dict, prefix: str = "s_",
                 score_col: str = "intent_score") -> DataFrame:
    """M5/M7 apply: scaled columns ``s_<name>`` plus their mean."""
    scaled = {prefix + c: (F.coalesce(S.nan_to_null(F.col(c)), F.lit(0.0)) - F.lit(mn)) / F.lit(rng)
              for c, (mn, rng) in stats.items()}
    out = df.withColumns(scaled)
    return out.withColumn(score_col, mean_of(list(scaled)))


def intent_vector(stats: dict, prefix: str = "s_") -> F.Column:
    return F.array(*[F.col(prefix + c) for c in stats])


def signal_matrix(df: DataFrame, signals_col: str = "signals",
                  keys: Sequence[str] = SIGNAL_KEYS) -> DataFrame:
    """M6: the eleven raw signals from a VARIANT object; bool -> 0/1,
    missing / non-numeric / NaN / infinite -> 0."""
    cols = {}
    for k in keys:
        x = tolerant_double(F.col(signals_col), f"$.{k}")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        cols[k] = F.when(bad, F.lit(0.0)).otherwise(x)
    return df.withColumns(cols)


def composite_vector(vec_col: str, intent_cols: Sequence[str]) -> F.Column:
    """M8: capability vector followed by the intent values (boundary = size(vec))."""
    return F.concat(F.transform(F.col(vec_col), lambda x: x.cast("double")),
                    F.array(*[F.col(c).cast("double") for c in intent_cols]))


def _one_side(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Both inputs by key, each row once; a key that only one of them has, or
    that one of them has twice, fails the job and is named in the error."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_na"), F.first(F.struct("*")).alias("_a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_nb"), F.first(F.struct("*")).alias("_b"))
    both = a.join(b, key, "full")
    count = [F.coalesce(c, F.lit(0)) for c in ("_na", "_nb")]
    told = F.concat(F.lit("Mismatch: key "), F.coalesce(F.col(key).cast("string"), F.lit("null")),
                    *[x for n, c in zip(names, count) for x in (F.lit(f", {n}: "), c.cast("string"))])
    return both.withColumn("_a", F.when((count[0] == 1) & (count[1] == 1), F.col("_a")).otherwise(F.raise_error(told)))


def composite_from_signals(texts: DataFrame, signals: DataFrame, key: str, text_col: str, signals_col: str, encode,
                           keys: Sequence[str] = SIGNAL_KEYS) -> DataFrame:
    """M8 from raw signal objects: key, capability, intent, composite and
    boundary (where the intent part starts).

    ``texts`` and ``signals`` must hold the same keys, each once.  The eleven
    signals (M6) are min-max scaled over the whole input; ``encode`` is a
    vectoriser that keeps the column ``key`` (M1)."""
    a = texts.select(F.col(key), F.col(text_col).alias("text"))
    b = signals.select(F.col(key), F.col(signals_col).alias("_signals"))
    both = _one_side(a, b, key, ("texts", "signals"))
    raw = cut_lineage(signal_matrix(both.select(key, F.col("_a.text").alias("text"), F.col("_b._signals").alias("_signals")), "_signals", keys).drop("_signals"))
    st = S.fit_minmax(raw, keys)
    scaled = raw.withColumn("intent", F.array(*[S.minmax_expr(c, st[c]) for c in keys])).select(key, "text", "intent")
    vec = encode(scaled.select(key, "text", "intent"))
    return vec.select(key, F.col("vec").cast("array<double>").alias("capability"), "intent",
                      F.concat(F.col("vec").cast("array<double>"), F.col("intent")).alias("composite"), F.size("vec").alias("boundary"))


def of_length(vec: F.Column, dim: int) -> F.Column:
    """The vector itself; any other length than ``dim`` fails the job."""
    wrong = F.concat(F.lit(f"a vector of {dim} values is needed, found "), F.size(vec).cast("string"))
    return F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(wrong))


def ranker_features(cos_col: str, intent_cols: Sequence[str]) -> F.Column:
    """M9: [cosine, intent...] as an array (assembled to a Vector for Spark ML)."""
    return F.array(F.col(cos_col).cast("double"), *[F.col(c).cast("double") for c in intent_cols])
