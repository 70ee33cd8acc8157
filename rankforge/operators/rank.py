"""Ranking, top-k and the shortlist.

Order everywhere: score (already rounded to 6 decimals) descending, then
the id *as a string* ascending.  Ties therefore never depend on row order.

* ``top_k`` is ``ORDER BY .. LIMIT k`` (TakeOrderedAndProject: each task
  keeps k rows, the driver merges k x tasks) and numbers only those k rows.
* ``full_rank`` numbers every row without an unpartitioned window: a
  range-partitioned global sort is written to the checkpoint folder, each
  partition's row count becomes an offset (one small row per partition),
  and rank = offset + position inside the partition.
* ``rank_within`` numbers rows per group (per job, per query group) with a
  partitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def order_cols(score_col: str = "score", id_col: str = "candidate_id"):
    return [F.col(score_col).desc_nulls_last(), F.col(id_col).cast("string").asc_nulls_last()]


def round_half_even(c, decimals: int) -> F.Column:
    """numpy-style rounding: rint(x * 10^d) / 10^d (half-even on the binary
    value of the scaled number, like ``np.round``)."""
    scale = float(10 ** decimals)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)


def round6(c) -> F.Column:
    """Six-decimal half-even rounding."""
    return round_half_even(c, 6)


def top_k(df: DataFrame, k: int, score_col: str = "score", id_col: str = "candidate_id",
          rank_col: str = "rank") -> DataFrame:
    """Best k rows, ranks 1..k renumbered from 1 (BIGINT)."""
    best = df.orderBy(*order_cols(score_col, id_col)).limit(k)
    w = Window.orderBy(*order_cols(score_col, id_col))
    return best.withColumn(rank_col, F.row_number().over(w).cast("bigint"))


def rank_within(df: DataFrame, group_cols, score_col: str = "score",
                id_col: str = "candidate_id", rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """W1 per group (per job, per query group): 1..n inside each group.

    No window holds a group: ranks come from a running count over a
    range-partitioned sort, so a job scored against a third of all rows is
    spread over many tasks."""
    from .prefix import exclusive_prefix_sum
    ones = df.withColumn("_one", F.lit(1.0))
    out = exclusive_prefix_sum(ones, list(group_cols), order_cols(score_col, id_col), "_one",
                               "_before", num_partitions)
    return out.withColumn(rank_col, (F.col("_before") + 1).cast("bigint")).drop("_one", "_before")


def top_k_per_group(df: DataFrame, group_cols, k: int, score_col: str = "score",
                    id_col: str = "candidate_id", rank_col: str = "rank") -> DataFrame:
    """Best k rows of every group (e.g. a shortlist per job)."""
    return rank_within(df, group_cols, score_col, id_col, rank_col).where(F.col(rank_col) <= k)


def global_row_number(df: DataFrame, order, out_col: str = "rank",
                      num_partitions: int | None = None) -> DataFrame:
    """1..N in the given total order without a single-task window.

    The range-partitioned sort is written to the checkpoint folder once, so
    the per-partition counts and the numbering see the same partitions."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *order)
                 .sortWithinPartitions(*order)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    starts = (ordered.groupBy("_pid")
                     .agg(F.count("*").alias("_n"), F.min("_mid").alias("_first")))
    wcum = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count
    offsets = starts.withColumn("_off", F.coalesce(F.sum("_n").over(wcum), F.lit(0)))
    return (ordered.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
                   .withColumn(out_col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1)
                               .cast("bigint"))
                   .drop("_pid", "_mid", "_off", "_first"))


def full_rank(df: DataFrame, score_col: str = "score", id_col: str = "candidate_id",
              rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """W1 over one huge pool: global 1..N by score desc, id asc."""
    return global_row_number(df, order_cols(score_col, id_col), rank_col, num_partitions)


def shortlist_columns(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Rename the model score to ``score`` and project submission columns."""
    if score_col != "score":
        df = df.withColumnRenamed(score_col, "score")
    cols = [c for c in ("candidate_id", "rank", "score", "reasoning") if c in df.columns]
    return df.select(*cols)
