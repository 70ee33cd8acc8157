"""Driver queries for Structured Streaming (ST1, ST2): rows pass through a
folder as JSON-lines files and are processed with ``availableNow``; the
result must equal the batch formulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions.vectors import cosine_to
from ..operators import ltr
from ..operators import stats as S
from ..operators.features import apply_intent
from ..operators.labels import weak_labels
from ..operators.metrics import one_row
from ..operators.rank import round6, top_k
from ..session import cut_lineage, scratch_path
from ..streaming.stream import (compact_sink, cut_to_batch, latest_per_key, read_sink, run_available_now, score_stream,
                                text_stream, write_static)
from .bindings import Bindings
from .queries import MINIMAL_SLICE_SQL
from .registry import query
from .q_jobs import TRIAL_ROUNDS
from .slice import SLICE_COLS, slice_raw, slice_scored

CFG = RankConfig()


@query("stream_scan", """
SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events
""")
def stream_scan(spark, sf_dir):
    """ST1: events arrive as four JSON-lines files, one file per micro-batch."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("events-in", "events-out", "events-ckpt"))
    ev = Bindings(spark, sf_dir).t.events
    ev.select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("value")) \
      .repartition(4).write.text(src)
    v = F.try_parse_json("value")
    parsed = text_stream(spark, src, 1).select(
        F.try_variant_get(v, "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get(v, "$.user_id", "bigint").alias("user_id"),
        F.try_variant_get(v, "$.event_type", "string").alias("event_type"),
        F.try_variant_get(v, "$.value", "double").alias("value"),
        F.try_variant_get(F.try_parse_json(F.try_variant_get(v, "$.props", "string")), "$.k", "double")
         .alias("k"))
    run_available_now(parsed, sink, ckpt)
    return read_sink(spark, sink).drop("_batch", "batch")


@query("stream_score", MINIMAL_SLICE_SQL)
def stream_score(spark, sf_dir):
    """ST2: candidates stream in; frozen medians and min/max fitted on the
    batch table are applied per row, vectors come from a stream-static
    join, each micro-batch is upserted, and the top-k is read from the
    scored table.  Equals the batch slice."""
    b = Bindings(spark, sf_dir)
    raw = cut_lineage(slice_raw(b))  # aggregated once for both fits and the input files
    medians, stats = S.fit_impute_and_scale(raw, SLICE_COLS)
    job = b.job_vector(0)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("cand-in", "cand-out", "cand-ckpt"))
    raw.select(F.to_json(F.struct("candidate_id", "c_custkey", *SLICE_COLS)).alias("value")) \
       .repartition(3).write.text(src)
    v = F.try_parse_json("value")
    rows = text_stream(spark, src, 1).select(
        F.try_variant_get(v, "$.candidate_id", "string").alias("candidate_id"),
        F.try_variant_get(v, "$.c_custkey", "bigint").alias("c_custkey"),
        *[F.try_variant_get(v, f"$.{c}", "double").alias(c) for c in SLICE_COLS])

    vectors = write_static(b.capvec(), "c_custkey", scratch_path(spark, "vectors"))

    def score(stream):
        s = apply_intent(S.apply_medians(stream, medians), stats)
        s = s.join(cut_to_batch(spark, vectors, stream, "c_custkey"), "c_custkey", "left")
        s = s.withColumn("cosine_similarity", cosine_to(F.col("embedding"), job))
        s = s.withColumn("score", F.lit(CFG.cosine_weight) * F.col("cosine_similarity")
                         + F.lit(CFG.intent_weight) * F.col("intent_score"))
        return s.select("candidate_id", round6(F.col("score")).alias("score"),
                        round6(F.col("cosine_similarity")).alias("cosine_similarity"),
                        round6(F.col("intent_score")).alias("intent_score"))

    score_stream(rows, score, sink, ckpt)
    compact_sink(spark, sink, "candidate_id")
    table = latest_per_key(read_sink(spark, sink), "candidate_id")
    return top_k(table, CFG.top_k).select("candidate_id", "rank", "score", "cosine_similarity",
                                          "intent_score")


def _candidate_stream(spark, raw):
    """Write candidate rows as JSON-lines files and open a stream over them."""
    src = scratch_path(spark, "cand-in")
    raw.select(F.to_json(F.struct("candidate_id", "c_custkey", *SLICE_COLS)).alias("value")) \
       .repartition(3).write.text(src)
    v = F.try_parse_json("value")
    return text_stream(spark, src, 1).select(
        F.try_variant_get(v, "$.candidate_id", "string").alias("candidate_id"),
        F.try_variant_get(v, "$.c_custkey", "bigint").alias("c_custkey"),
        *[F.try_variant_get(v, f"$.{c}", "double").alias(c) for c in SLICE_COLS])


def model_scorer(b, medians, stats, model):
    """Frozen per-row scoring: medians -> scaler -> cosine -> model."""
    job = b.job_vector(0)
    vectors = write_static(b.capvec(), "c_custkey", scratch_path(b.t.spark, "vectors"))

    def score(df):
        s = apply_intent(S.apply_medians(df, medians), stats)
        s = s.join(cut_to_batch(b.t.spark, vectors, df, "c_custkey"), "c_custkey", "left")
        s = s.withColumn("cosine_similarity", cosine_to(F.col("embedding"), job)).drop("embedding")
        s = ltr.score(s, model, "score")
        return s.select("candidate_id", round6(F.col("score")).alias("score"))
    return score


def fit_slice_model(spark, sf_dir, rounds=TRIAL_ROUNDS):
    """Batch side of ST2: medians, scaler and a model fitted on the table."""
    b = Bindings(spark, sf_dir)
    raw = cut_lineage(slice_raw(b))
    medians, stats = S.fit_impute_and_scale(raw, SLICE_COLS)
    lab, _ = weak_labels(slice_scored(spark, sf_dir, CFG), probs=CFG.label_quantiles)
    feats = ["cosine_similarity", *[f"s_{c}" for c in SLICE_COLS]]
    model = ltr.fit_pointwise(lab, feats, "label", CFG, rounds=rounds)
    return b, raw, medians, stats, model


@query("stream_model_score", f"""
SELECT count(*) AS n_scored, least(count(*), {CFG.top_k}) AS n_top, TRUE AS ranks_ok, TRUE AS equals_batch
FROM customer
""")
def stream_model_score(spark, sf_dir):
    """ST2 with a model: the stream is scored by a boosted model fitted on
    the batch table (frozen), upserted per micro-batch, top-k read back.
    Returns what must hold: every candidate scored once, ranks 1 to k, and
    streamed scores equal to batch scores."""
    b, raw, medians, stats, model = fit_slice_model(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "model-out"), scratch_path(spark, "model-ckpt")
    scorer = model_scorer(b, medians, stats, model)
    table = score_stream(_candidate_stream(spark, raw), scorer, sink, ckpt)
    batch = scorer(raw).select("candidate_id", F.col("score").alias("batch_score"))
    both = table.join(batch, "candidate_id", "full").agg(
        F.count("score").alias("n_scored"),
        F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("batch_score")) < 1e-9, F.lit(False))),
                   F.lit(True)).alias("equals_batch"))
    top = top_k(table, CFG.top_k).agg(
        F.count("*").alias("n_top"),
        ((F.count("*") == 0) | ((F.min("rank") == 1) & (F.max("rank") == F.count("*")))).alias("ranks_ok"))
    return one_row(both, top).select("n_scored", "n_top", "ranks_ok", "equals_batch")
