"""Sharding along a Hilbert curve.

Several metadata columns are quantised to equal-depth cells, every row gets
the Hilbert index of its cell, rows are ordered by that index and the order
is cut into runs of equal row counts.  Neighbouring cells stay together, so
each shard covers a small box in every dimension and a reader can skip
shards by the minimum and maximum of any of them.

Law `rows`: shard sizes differ by one row at most, whatever is skewed.  Rows
that tie on the index are ordered by the given key columns.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, stored, text_or_empty


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points: ``cells`` is (n, d), values below
    2**bits, d * bits at most 62.

    Level by level from the top bit: the current orientation (a reflection
    mask and a rotation) turns the point's bit pattern into the visiting
    order of its sub-cube through the Gray code, and is then replaced by the
    orientation inside that sub-cube.
    """
    n, d = cells.shape
    if d * bits > 62:
        raise ValueError("too many bits for a 64-bit index")
    full = np.int64((1 << d) - 1)
    entry, axis = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out = np.zeros(n, np.int64)

    def turn(x: np.ndarray, by: np.ndarray) -> np.ndarray:  # cyclic shift to the right on d bits
        by = by % d
        return ((x >> by) | (x << (d - by))) & full

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for k in range(d):
            corner |= ((cells[:, k].astype(np.int64) >> level) & 1) << k
        gray = turn(corner ^ entry, axis + 1)
        step = gray.copy()
        for s in (1, 2, 4, 8, 16, 32):
            step ^= step >> s
        out = (out << d) | step
        # where the curve enters sub-cube number `step`, and along which axis it runs there
        low = 2 * ((step - 1) // 2)
        enter = np.where(step == 0, 0, low ^ (low >> 1))
        odd = np.where(step & 1 == 1, step, step - 1)
        run = np.where(step == 0, 0, _trailing_ones(np.maximum(odd, 0)) % d)
        entry = entry ^ turn(enter, -(axis + 1))
        axis = (axis + run + 1) % d
    return out


def _trailing_ones(x: np.ndarray) -> np.ndarray:
    n = np.zeros(len(x), np.int64)
    live = np.ones(len(x), bool)
    for k in range(62):
        live &= (x >> k) & 1 == 1
        if not live.any():
            break
        n += live
    return n


def _as_number(df: DataFrame, name: str, shared: int) -> Column:
    """A number in the column's own order; strings by the six bytes after the
    prefix that all values share."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        head = F.substring(F.encode(F.col(name), "UTF-8"), shared + 1, 6)
        return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    number = F.col(name).cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number)


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Equal-depth cell numbers (0 to 2**bits - 1) of the dimensions; null is
    cell 0.  The cut points come from mergeable sketches over all rows (at
    most 2**bits a dimension reach the driver)."""
    text = [c for c in dims if isinstance(df.schema[c].dataType, T.StringType)]
    shared = dict.fromkeys(dims, 0)
    if text:
        ends = df.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(text) for f in (F.min, F.max)]).first()
        for i, c in enumerate(text):
            a, b = ((ends[f"{k}{i}"] or "").encode() for k in ("min", "max"))
            shared[c] = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    numbers = [_as_number(df, c, shared[c]) for c in dims]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(x, steps, 10_000).alias(f"q{i}") for i, x in enumerate(numbers)]).first()
    out = []
    for i, x in enumerate(numbers):
        q = sorted(set(cuts[f"q{i}"] or []))
        cell = reduce(add, [(x >= F.lit(v)).cast("int") for v in q], F.lit(0))
        out.append(F.when(x.isNull(), F.lit(0)).otherwise(cell).cast("int"))
    return out


def curve_index(cells: list[Column], bits: int) -> Column:
    @arrow("long")
    def index(*columns: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1), bits))

    return index(*cells)


def numbered(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """``df`` with the gapless rank (from 0) of each row in ``order``.

    Range partitioning, a row count for each partition (one small row each),
    and a number inside each sorted partition; no task sees the whole table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").count()
    base = sizes.withColumn("_base", F.sum("count").over(W.orderBy("_part")) - F.col("count")).select("_part", "_base")
    inside = W.partitionBy("_part").orderBy(*order)
    return (ranged.withColumn(number, F.row_number().over(inside) - 1)
            .join(F.broadcast(base), "_part")  # one row a partition
            .withColumn(number, F.col(number) + F.col("_base")).drop("_part", "_base"))


def hilbert_shards(df: DataFrame, dims: list[str], key: list[str], shards: int, bits: int = 5) -> DataFrame:
    """``df`` plus curve (Hilbert index), shard and slot (place in the shard).

    Equal rows take neighbouring slots in any order.  An empty table gives
    an empty result; fewer rows than shards leave the last shards empty.
    Columns of ``df`` named curve, shard or slot are replaced.
    """
    df = df.drop("curve", "shard", "slot")
    rows = df.withColumn("curve", curve_index(quantised(df, dims, bits), bits))
    ranked = numbered(rows, ["curve", *key], "_rank")
    n = ranked.count()
    small, more = divmod(n, shards)  # the first `more` shards hold one row more
    edge = more * (small + 1)
    rank = F.col("_rank").cast("long")
    if small == 0:
        shard, slot = rank, F.lit(0).cast("long")
    else:
        late = rank - edge
        shard = F.when(rank < edge, F.expr(f"_rank div {small + 1}")).otherwise(F.expr(f"(_rank - {edge}) div {small}") + more)
        slot = F.when(rank < edge, rank % (small + 1)).otherwise(late % small)
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("_rank")


def shard_plan(df: DataFrame, dims: list[str], key: str, shards: int, text: str = "text") -> DataFrame:
    """Placement without moving the texts: size (UTF-8 bytes + 16), CRC-32,
    shard and slot for every row."""
    plain = text_or_empty(text)
    slim = df.select(F.col(key), (F.octet_length(plain).cast("long") + 16).alias("size"),
                     F.crc32(plain.cast("binary")).alias("text_crc32"),
                     *[c for c in dims if c not in (key, "size", "text_crc32")])
    return hilbert_shards(slim, dims, [key, "text_crc32", "size"], shards)


def write_shards(df: DataFrame, plan: DataFrame, key: str, path: str) -> None:
    """Write the rows into one folder a shard, in slot order, next to a
    manifest with the value range of every dimension (for pruning)."""
    placed = df.join(plan.select(key, "shard", "slot"), key)
    (placed.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(f"{path}/data"))
    dims = [c for c in plan.columns if c not in (key, "shard", "slot", "curve", "text_crc32")]
    (plan.groupBy("shard").agg(F.count("*").alias("rows"),
                               *[f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)])
     .write.parquet(f"{path}/manifest"))
