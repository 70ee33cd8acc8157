"""Structured Streaming: file ingestion (ST1) and incremental scoring (ST2).

* Ingestion reads a folder of JSON-lines files with ``readStream.text``
  (``maxFilesPerTrigger`` bounds each micro-batch) and applies the same
  stateless parse/shred expressions as the batch path.
* Scoring applies FROZEN statistics (medians, min/max, model) fitted on a
  batch table, so a streamed row is scored exactly like the same row in
  batch.  No state store is needed: every operator is per row.
* The sink is ``foreachBatch`` writing each micro-batch to its own folder
  (``batch=<id>``) in overwrite mode, so a replayed batch after a failure
  replaces its own output (exactly-once together with the checkpoint).
  Readers take the latest row per key (``max_by`` on the batch id).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import bucket_of, manifest, publish


def text_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A stream of text lines from the files that arrive in ``path``."""
    return (spark.readStream.format("text")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(path))


def batch_folder_writer(sink_path: str, fmt: str = "parquet",
                        per_batch: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch function: each micro-batch overwrites only its own folder.
    ``per_batch`` sees the micro-batch as a plain DataFrame, so it can cut
    static tables to the batch's keys and is planned adaptively."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        out = batch_df if per_batch is None else per_batch(batch_df)
        (out.withColumn("_batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").format(fmt).save(f"{sink_path}/batch={batch_id}"))
    return write


BUCKETS = 256


def write_static(static: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> str:
    """A static table in folders by a hash of its key, for `cut_to_batch`."""
    static.withColumn("_bucket", bucket_of(F.col(key), buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    return path


def cut_to_batch(spark: SparkSession, path: str, batch: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a table of `write_static` that a micro-batch asks for; only
    the folders of its keys are read (at most ``buckets`` numbers are
    collected)."""
    keys = batch.select(F.col(key), bucket_of(F.col(key), buckets).alias("_bucket")).distinct()
    wanted = [r[0] for r in keys.select("_bucket").distinct().where("_bucket is not null").collect()]
    found = spark.read.parquet(path).where(F.col("_bucket").isin(wanted))
    return found.join(keys, ["_bucket", key], "left_semi").drop("_bucket")


def run_available_now(stream: DataFrame, sink_path: str, checkpoint_path: str,
                      transform: Callable[[DataFrame], DataFrame] | None = None,
                      timeout_s: float | None = None,
                      per_batch: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Process everything available now, then stop; returns the number of
    micro-batches that produced output."""
    out = transform(stream) if transform is not None else stream
    q = (out.writeStream.foreachBatch(batch_folder_writer(sink_path, per_batch=per_batch))
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True)
         .start())
    if not q.awaitTermination(timeout_s) and timeout_s is not None:
        q.stop()
        raise TimeoutError(f"the stream did not finish within {timeout_s} s; its sink is incomplete")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    progress = q.recentProgress
    return sum(1 for p in progress if p.get("numInputRows", 0) > 0)


def _folders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []


def _sink_parts(spark: SparkSession, sink_path: str) -> tuple[int, str | None, list[int], list[str]]:
    """Manifest version, compacted base, batches behind it, and the folders to read."""
    version, runs = manifest(spark, sink_path)
    base = runs[0] if runs else None
    upto = int(base.split("-")[1]) if base else -1
    batches = sorted(b for n in _folders(spark, sink_path) if n.startswith("batch=") and (b := int(n.removeprefix("batch="))) > upto)
    return version, base, batches, [*([f"{sink_path}/{base}"] if base else []), *(f"{sink_path}/batch={b}" for b in batches)]


def read_sink(spark: SparkSession, sink_path: str) -> DataFrame:
    """The compacted rows and those of the batches since."""
    return spark.read.parquet(*_sink_parts(spark, sink_path)[3])


def compact_sink(spark: SparkSession, sink_path: str, key: str) -> None:
    """Merge all batches so far into one base with the newest row of each key,
    published by a version file; readers see the old or the new state.  Batches
    go on arriving meanwhile: those behind the base stay as they are."""
    version, _, batches, folders = _sink_parts(spark, sink_path)
    if not batches:
        return
    rows = spark.read.parquet(*folders)
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col("_batch")).alias("_r")).select(key, "_r.*")
    base = f"base-{batches[-1]}-{uuid.uuid4().hex[:8]}"
    newest.write.parquet(f"{sink_path}/{base}")
    publish(spark, sink_path, version, [base])


def latest_per_key(table: DataFrame, key: str, batch_col: str = "_batch") -> DataFrame:
    """Upsert view: the row from the newest batch for every key (combined
    map-side: one partial row per key and task)."""
    cols = [c for c in table.columns if c not in (key, batch_col, "batch")]
    last = table.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(batch_col)).alias("_r"))
    return last.select(key, "_r.*")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink_path: str,
                 checkpoint_path: str, key: str = "candidate_id",
                 timeout_s: float | None = None) -> DataFrame:
    """ST2: score every arriving row with FROZEN state captured in ``score``
    (medians, scaler, model, target vector - all fitted on a batch table),
    upsert each micro-batch into the scored table, and return the upsert
    view (latest row per key), from which a top-k is read."""
    run_available_now(stream, sink_path, checkpoint_path, timeout_s=timeout_s, per_batch=score)
    return latest_per_key(read_sink(stream.sparkSession, sink_path), key)
