"""Fixture views over the driver tables.

They stand in for the nested candidate records: customers become
candidates, orders become roles, purchased part names become skills,
events become behaviour signals, documents become free text and the
embedding table holds capability vectors (``vec_id = 0`` is the target).

Every per-candidate side table is aggregated on a column named
``c_custkey`` so that the joins that assemble the candidate table reuse
the aggregate's hash partitioning instead of shuffling again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REF_DATE
from ..sources.tables import Tables

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def candidate_id(custkey) -> F.Column:
    return F.concat(F.lit("CAND_"), F.lpad(F.col(custkey).cast("string"), 7, "0"))


def days_before_ref(ts_col: F.Column, ref_date: str = REF_DATE) -> F.Column:
    """Fractional days from a timestamp to the reference date, on wall-clock
    (TIMESTAMP_NTZ) values, so the session time zone plays no part."""
    return days_between(ts_col, F.to_timestamp_ntz(F.lit(ref_date)))


def days_between(start: F.Column, end: F.Column) -> F.Column:
    micros = F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    return micros / F.lit(86400e6)


class Bindings:
    def __init__(self, spark, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # -- candidates -------------------------------------------------------
    def cand(self) -> DataFrame:
        c = self.t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                   "c_mktsegment")
        n = self.t.nation.select("n_nationkey", "n_name")
        return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
                 .select(candidate_id("c_custkey").alias("candidate_id"), "c_custkey",
                         F.col("c_name").alias("anonymized_name"),
                         (F.col("c_acctbal") / F.lit(150.0)).alias("years_of_experience"),
                         F.col("n_name").alias("country"),
                         F.col("c_mktsegment").alias("headline")))

    # -- behaviour signals -------------------------------------------------
    def sig(self) -> DataFrame:
        e = self.t.events.select(F.col("user_id").alias("c_custkey"), "event_type", "value", "ts")
        counts = [F.count_if(F.col("event_type") == F.lit(t)).cast("double").alias(f"n_{t}")
                  for t in EVENT_TYPES]
        return e.groupBy("c_custkey").agg(*counts, F.avg("value").alias("avg_value"),
                                          F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts"))

    def sig_features(self, ref_date: str = REF_DATE) -> DataFrame:
        s = self.sig()
        return s.select("c_custkey", *[f"n_{t}" for t in EVENT_TYPES], "avg_value",
                        days_before_ref(F.col("last_ts"), ref_date).alias("days_since_last_active"),
                        days_before_ref(F.col("first_ts"), ref_date).alias("days_since_signup"))

    # -- roles ---------------------------------------------------------------
    def career(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"),
                                 "o_orderstatus", "o_totalprice", "o_orderdate",
                                 "o_orderpriority")
        start = F.col("o_orderdate")
        return o.select(
            "c_custkey", "o_orderkey",
            F.date_format(start, "yyyy-MM-dd").alias("start_date"),
            F.when(F.col("o_orderstatus") == "O", F.lit("present"))
             .when(F.col("o_orderstatus") == "F",
                   F.date_format(F.add_months(start.cast("date"), 18), "yyyy-MM"))
             .otherwise(F.lit(None).cast("string")).alias("end_date"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("double"))
             .otherwise(F.floor(F.col("o_totalprice") / F.lit(10000.0)).cast("double"))
             .alias("duration_months"),
            F.col("o_orderpriority").alias("description"),
            (F.col("o_orderstatus") == "O").alias("is_current"))

    # -- skills --------------------------------------------------------------
    def skill_pairs(self) -> DataFrame:
        """(c_custkey, skill) per line item: orders -> lineitem -> part."""
        o = self.t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        li = self.t.lineitem.select("l_orderkey", "l_partkey")
        p = self.t.part.select("p_partkey", "p_name")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .join(p, li.l_partkey == p.p_partkey)
                  .select("c_custkey", F.col("p_name").alias("skill")))

    def skill_rows(self) -> DataFrame:
        """Distinct (c_custkey, skill) pairs."""
        return self.skill_pairs().distinct()

    # -- text and vectors ----------------------------------------------------
    def captext(self) -> DataFrame:
        return self.t.documents.select(F.col("doc_id").alias("c_custkey"), "text", "lang")

    def capvec(self) -> DataFrame:
        return self.t.embeddings.select(F.col("vec_id").alias("c_custkey"), "embedding")

    def job_vector(self, vec_id: int = 0) -> list:
        """The one target vector (a single bounded row)."""
        rows = self.t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").take(2)
        if len(rows) != 1:
            raise ValueError(f"expected exactly one target vector for vec_id={vec_id}")
        return [float(x) for x in rows[0][0]]
