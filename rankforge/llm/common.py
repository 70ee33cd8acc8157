"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.session import scratch_path

#: Unicode White_Space, as the pre-tokenising pattern understands \s (fixed values).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A run of non-space characters with at most one leading blank, or the
#: white space between two runs, cut where the pre-tokeniser cuts it.
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

_SAFE_CUT = re.compile(f"[^{SPACES}](?=[{SPACES}])")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: the lineage is
    cut, values that depend on task order are fixed, columns stay prunable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Pile:
    """Tables with the same columns, stored one after the other.  All of them
    are one scan, where a union would grow by a scan, its tasks and its memory
    on the driver with every table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.parts = spark, scratch_path(spark, name), []

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, `stored`."""
        self.parts.append(f"{self.path}/{len(self.parts)}")
        df.write.parquet(self.parts[-1])
        self.schema = df.schema
        return self._read(self.parts[-1])

    def whole(self) -> DataFrame:
        return self._read(*self.parts)

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)


def discard(df: DataFrame) -> None:
    """Delete the folders of a table of `stored` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (case-insensitive)."""
    low = {c.lower() for c in taken}
    return base if base.lower() not in low else f"{base}_{uuid.uuid4().hex[:8]}"


def row_mark(text: str) -> Column:
    """A 64-bit mark of a row's text; with the row's key it names the row."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("\u0000null")))


def without_rows(df: DataFrame, verdicts: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, with its own columns.

    ``verdicts`` has key, mark (`row_mark`) and kept for every row of ``df``.
    Dropped rows are anti-joined, so the texts move only when the list of
    dropped rows is too long to broadcast.  Fully repeated rows share one
    mark and leave at most one row.
    """
    by_mark = verdicts.groupBy("key", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    by_mark = stored(by_mark.filter("not kept or n > 1"), "dropped")
    gone = by_mark.filter("not kept").select(F.col("key").alias("_gone_key"), F.col("mark").alias("_gone_mark"))
    mark = fresh(df.columns, "_mark")
    marked = df.withColumn(mark, row_mark(text))
    left = marked.join(gone, marked[key].eqNullSafe(F.col("_gone_key")) & (marked[mark] == F.col("_gone_mark")),
                       "left_anti")
    if not by_mark.filter("kept").isEmpty():
        left = left.dropDuplicates([key, mark])
    return left.select(*df.columns)


def pieces(text: str, size: int) -> list[str]:
    """Cut a long text into pieces of about ``size`` characters.

    Cuts lie between a non-space and a space character: the pre-tokeniser
    ends a word there whatever stands on either side, so token counts add
    up.  A run without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE_CUT.search(text, at + size - 1)
        if m is None:
            break
        out.append(text[at:m.end()])
        at = m.end()
    out.append(text[at:])
    return out


def by_bytes(texts: list[str], size: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose texts hold about ``size`` characters each."""
    out, start, load = [], 0, 0
    for i, t in enumerate(texts):
        if load and load + len(t) > size:
            out.append((start, i))
            start, load = i, 0
        load += len(t)
    if start < len(texts):
        out.append((start, len(texts)))
    return out


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches() -> None:
    """Arrow batches of 4 MB, unless the session already asks for other than
    Spark's 64 MB: texts vary from a line to megabytes, so a batch is bounded
    by bytes, in the JVM as well as in Python."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_BYTES) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH_BYTES, "4m")


def gives_back(function):
    """``function`` of a task's batches; what it has freed goes back to the
    system at its end.  Python workers are kept for later tasks, several a
    core, and would hold it while others need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what was freed; others don't
            if trim is not None:
                trim(0)

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` on small batches."""
    small_batches()
    return df.mapInArrow(gives_back(function), schema)


def arrow(kind: str):
    """`arrow_udf` on small batches."""
    small_batches()
    return F.arrow_udf(kind)


def sliced(texts: pa.Array, size: int, rows: int = 32_768) -> Iterator[list[str | None]]:
    """The values of an Arrow column, about ``size`` bytes and at most
    ``rows`` rows at a time: Python holds one slice, whatever a batch has."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        full = (ends[at - 1] if at else 0) + size
        end = min(max(at + 1, int(np.searchsorted(ends, full, side="right"))), at + rows)
        yield texts.slice(at, end - at).to_pylist()
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift, multiply, shift) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# --- word hashes straight from the UTF-8 bytes -----------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_P = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 16  #: bytes hashed at a time


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_P, -1, 1 << 64)
    up, down = np.full(n, _P, np.uint64), np.full(n, inv, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CACHE: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse."""
    if "p" not in _CACHE or len(_CACHE["p"][0]) < n:
        _CACHE["p"] = _powers(max(SEGMENT, 1 << (n - 1).bit_length()))
    return _CACHE["p"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` and the number of words of each.

    A word is a run of ASCII letters and digits (lower-cased) and non-ASCII
    bytes; the hash is a polynomial of its bytes, taken from prefix sums, so
    no Python object is made per word.  The sums are taken over segments of
    whole words that stay in cache; the hash does not depend on the place.
    """
    raw = [t.encode("utf-8") for t in texts]
    low = np.frombuffer((b"\n".join(raw) + b"\n").translate(_LOWER.tobytes()), np.uint8)
    edge = np.flatnonzero(np.diff(_IS_WORD[low].view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]  # the last byte is no word's
    hashes, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + SEGMENT, side="right")))
        part = low[base:end[j - 1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(part))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[:len(part)])])
        a, z = start[i:j] - base, end[i:j] - base
        hashes[i:j] = mix64((sums[z] - sums[a]) * down[a] ^ (z - a).astype(np.uint64))
        i = j
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) if raw else np.zeros(1, np.int64)
    return hashes, np.diff(np.searchsorted(start, bounds))
