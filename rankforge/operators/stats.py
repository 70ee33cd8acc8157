"""Column statistics that later stages apply as literals.

Fit functions run one distributed aggregate and return a small Python
dict (one value per column: a bounded, one-row result).  Apply functions
turn those values into literal expressions, so the apply side stays inside
whole-stage code generation and needs no join.

Exact quantiles
---------------
One path at every size.  The first scan makes a mergeable sketch (KLL) of
each column; its quantiles at the target rank +- `RANK_ERROR` bracket the
value sought.  The closing scan counts the values below each bracket and
those inside it one by one, which gives the exact value and proves the
bracket right; a bracket that missed is widened and closed again.  A bracket
that would hold more than `FINAL_VALUES` values is first narrowed by a sketch
of its inside, so that what reaches the driver is bounded whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_SIZE = 2048  #: rank error of about 0.2 % at 0.99 confidence
RANK_ERROR = 0.005  #: half width of a bracket, in ranks
FINAL_VALUES = 100_000  #: values of a bracket that the closing scan counts one by one
SLICES = 1000  #: quantiles asked of a bracket that is too wide


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL (Spark orders NaN above every number in percentiles)."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


# ---------------------------------------------------------------------------
# exact quantiles
# ---------------------------------------------------------------------------

def _interp(values_at: dict, n: int, p: float) -> float | None:
    if n == 0:
        return None
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    a, b = values_at[lo], values_at[hi]
    if lo == hi:
        return a
    return (hi - pos) * a + (pos - lo) * b


@dataclass
class _Column:
    """What the first scan knows of a column."""

    rows: int        # of the table
    n: int           # values, without null and NaN
    least: float | None
    most: float | None


@dataclass
class _Probe:
    """A bracket around the values of two neighbouring ranks of a column."""

    col: int
    ranks: tuple[int, int]
    low: float
    high: float
    inside: float    # about how many values the bracket holds
    error: float     # of a sketch, in ranks

    def widen(self, known: _Column) -> None:
        """After a miss: the whole column again, and a sketch is trusted less."""
        self.low, self.high, self.inside = known.least, known.most, known.n
        self.error = max(2 * self.error, 1.0 / SLICES)


def _sketch(x: Column) -> Column:
    return F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE))


def _around(p: float) -> list[float]:
    return [max(0.0, p - RANK_ERROR), min(1.0, p + RANK_ERROR)]


def _first_scan(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> tuple[list[_Column], list[_Probe]]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    at = F.array(*[F.lit(r) for p in probs for r in _around(p)])
    for i, c in enumerate(cols):
        x = nan_to_null(F.col(c))
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
        if probs:
            aggs.append(F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(_sketch(x), at)).alias(f"q{i}"))
    row = df.agg(*aggs).collect()[0]
    known, probes = [], []
    for i in range(len(cols)):
        n, least, most = row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"]
        known.append(_Column(row["rows"], n, least, most))
        for j, p in enumerate(probs):
            if n:
                q = row[f"q{i}"]
                pos = p * (n - 1)
                low, high = (least, most) if n <= SKETCH_SIZE else (q[2 * j], q[2 * j + 1])
                probes.append(_Probe(i, (math.floor(pos), math.ceil(pos)), low, high, min(n, 2 * RANK_ERROR * n + SKETCH_SIZE), RANK_ERROR))
    return known, probes


def _narrowed(df: DataFrame, cols: Sequence[str], known: list[_Column], probes: list[_Probe]) -> None:
    """One scan that shrinks wide brackets by a sketch of what lies inside."""
    aggs, at = [], F.array(*[F.lit(i / SLICES) for i in range(SLICES + 1)])
    for i, p in enumerate(probes):
        x = nan_to_null(F.col(cols[p.col]))
        held = F.when((x >= p.low) & (x <= p.high), x)
        aggs += [F.count_if(x < p.low).alias(f"b{i}"), F.count(held).alias(f"n{i}"),
                 F.when(F.count(held) > 0, F.kll_sketch_get_quantile_double(_sketch(held), at)).alias(f"q{i}")]
    row = df.agg(*aggs).collect()[0]
    for i, p in enumerate(probes):
        below, n = row[f"b{i}"], row[f"n{i}"]
        if not below <= p.ranks[0] <= p.ranks[1] < below + n:  # the bracket missed: start over from the whole column
            p.widen(known[p.col])
            continue
        first, last = ((r - below) / max(1, n - 1) for r in p.ranks)
        a = max(0, math.floor((first - p.error) * SLICES))
        b = min(SLICES, math.ceil((last + p.error) * SLICES))
        p.low, p.high, p.inside = row[f"q{i}"][a], row[f"q{i}"][b], n * (b - a) / SLICES


def _closed(df: DataFrame, cols: Sequence[str], known: list[_Column], probes: list[_Probe]) -> dict[int, dict[int, float]]:
    """Values at the ranks of the probes, from one exact counting scan each time."""
    values: dict[int, dict[int, float]] = {i: {} for i in range(len(cols))}
    while probes:
        wide = [p for p in probes if p.inside > FINAL_VALUES and p.low < p.high]
        if wide:
            _narrowed(df, cols, known, wide)
            continue
        # brackets are looked up by place: a literal beside every value would make code too long to compile
        low, high = (F.array(*[F.lit(float(getattr(p, k))) for p in probes])[F.col("p")] for k in ("low", "high"))
        entry = F.array(*[nan_to_null(F.col(cols[p.col])) for p in probes])
        counts = (df.select(F.posexplode(entry).alias("p", "v")).filter(F.col("v") <= high)
                  .groupBy("p", F.when(F.col("v") >= low, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
        missed = []
        for i, p in enumerate(probes):
            own = [(r["v"], r["n"]) for r in counts if r["p"] == i]
            upto = sum(n for v, n in own if v is None)
            found: dict[int, float] = {}
            if upto <= p.ranks[0]:
                for v, n in sorted(x for x in own if x[0] is not None):
                    for rank in p.ranks:
                        if upto <= rank < upto + n:
                            found[rank] = v
                    upto += n
            if len(found) < len(set(p.ranks)):
                p.widen(known[p.col])
                missed.append(p)
            values[p.col] |= found
        probes = missed
    return values


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """Exact linear-interpolation quantiles per column (NULL/NaN ignored).

    Returns ``{col: [q(p) for p in probs]}``; a column without values maps
    to ``None`` entries."""
    return _with_quantiles(df, list(cols), list(probs))[1]


def _with_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> tuple[list[_Column], dict]:
    if not cols:
        return [], {}
    known, probes = _first_scan(df, cols, probs)
    values = _closed(df, cols, known, probes)
    return known, {c: [_interp(values[i], known[i].n, p) for p in probs] for i, c in enumerate(cols)}


# ---------------------------------------------------------------------------
# medians (A1 / A2)
# ---------------------------------------------------------------------------

def fit_medians(df: DataFrame, cols: Iterable[str]) -> dict:
    """Exact median per column; a column with no value gets 0.0."""
    q = exact_quantiles(df, list(cols), [0.5])
    return {c: (0.0 if v[0] is None else float(v[0])) for c, v in q.items()}


def apply_medians(df: DataFrame, medians: dict, text_cols: Iterable[str] = ()) -> DataFrame:
    """Fill NULL and NaN numerics with the fitted medians, text with ''."""
    repl = {c: F.coalesce(nan_to_null(F.col(c)), F.lit(float(v))) for c, v in medians.items()}
    repl.update({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols})
    return df.withColumns(repl) if repl else df


# ---------------------------------------------------------------------------
# min-max scaling (A5 / M5 / M7)
# ---------------------------------------------------------------------------

def fit_minmax(df: DataFrame, cols: Iterable[str]) -> dict:
    """Per-column (min, range); a constant column gets range 1 (maps to 0)."""
    cols = list(cols)
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = nan_to_null(F.col(c))
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        mn, mx = row[f"mn{i}"], row[f"mx{i}"]
        if mn is None:
            mn, mx = 0.0, 0.0
        rng = float(mx) - float(mn)
        out[c] = (float(mn), rng if rng != 0.0 else 1.0)
    return out


def minmax_expr(c: str, stat: tuple) -> Column:
    mn, rng = stat
    return (F.col(c).cast("double") - F.lit(mn)) / F.lit(rng)


def apply_minmax(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """Scale with frozen statistics; later batches may leave [0, 1]."""
    return df.withColumns({c + suffix: minmax_expr(c, s) for c, s in stats.items()})


def stats_frame(spark, stats: dict, kind: str) -> DataFrame:
    """Persistable form of fitted statistics: (kind, column, a, b)."""
    rows = []
    for c, v in stats.items():
        if isinstance(v, tuple):
            rows.append((kind, c, float(v[0]), float(v[1])))
        else:
            rows.append((kind, c, float(v), None))
    return spark.createDataFrame(rows, "kind string, column string, a double, b double")


def stats_from_frame(df: DataFrame, kind: str) -> dict:
    """Inverse of ``stats_frame`` (the table holds one row per column)."""
    out = {}
    for r in df.where(F.col("kind") == kind).collect():
        out[r["column"]] = (r["a"], r["b"]) if r["b"] is not None else r["a"]
    return out


# ---------------------------------------------------------------------------
# fused fit: medians + the min/max the imputed columns will have
# ---------------------------------------------------------------------------

def fit_impute_and_scale(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict]:
    """Medians (A1) and the min-max statistics (A5) of the median-filled
    columns, from the two scans of the medians.

    Filling NULL/NaN with the median m changes a column's range only by
    adding m, so min(filled) = min(min(x), m) when anything was missing
    (max likewise) - exact, and no pass over the filled data is needed."""
    cols = list(cols)
    known, q = _with_quantiles(df, cols, [0.5])
    medians = {c: (0.0 if v[0] is None else float(v[0])) for c, v in q.items()}
    ranges = {}
    for c, k in zip(cols, known):
        m = medians[c]
        if k.n == 0:
            mn = mx = m
        else:
            mn, mx = float(k.least), float(k.most)
            if k.n < k.rows:
                mn, mx = min(mn, m), max(mx, m)
        rng = mx - mn
        ranges[c] = (mn, rng if rng != 0.0 else 1.0)
    return medians, ranges
