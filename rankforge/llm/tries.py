"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns.  Its name is a 128-bit
exclusive-or of hashes of (depth, turn), so that the names of all prefixes of
a conversation are running sums, computed on range-partitioned slices: a
conversation that holds a third of all rows is many slices.

`subtree_totals` sums weights over the subtrees of any forest.  Each round
rakes (all leaves hand their sums to their parents and go) and compresses (an
independent set of nodes with one child, drawn by coin, hand their sums to
their parents and are bypassed).  Raked nodes know their totals; bypassed
ones get theirs in reverse, as their own sum plus the total of the child they
had.  Rounds grow with the logarithm of the number of nodes, also for one
long chain.

Defined results: null role or text is empty, null turn comes first, rows
without conv_id belong to no conversation; rows of one turn number are ordered
by a hash of their contents, equal rows count each time; texts of any length
are hashed whole; an empty table has no nodes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankforge.session import scratch_path

from .common import stored

HEAD = 5  #: most turns that a conversation can borrow
BLOCK = 1 << 16  #: ids in one block of a node's list


# --- contraction --------------------------------------------------------------


def _coin(cols: list[str], turn: int) -> Column:
    return F.xxhash64(*cols, F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def _on(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> Column:
    cond = F.lit(True)
    for x, y in zip(left, right):
        cond = cond & (a[x] == b[y])
    return cond


def _put(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def subtree_totals(nodes: DataFrame, key: list[str], parent: list[str], weights: list[str]) -> DataFrame:
    """Key and, in place of each weight, its sum over the subtree of the node.

    ``nodes`` has one row a node; a root's ``parent`` columns are null, every
    other parent is a node.  No columns but those named are read or returned.
    """
    spark = nodes.sparkSession
    k, p, g = ([f"_{s}{i}" for i in range(len(key))] for s in "kpg")
    sums = [f"_w{i}" for i in range(len(weights))]
    live = nodes.select(*[F.col(c).alias(n) for c, n in zip(key + parent + weights, k + p + sums)])
    family = live.filter(F.col(p[0]).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(p, g)]).agg(F.count("*").alias("_n"))
    live = live.join(family, _on(live, family, k, g), "left").select(*k, *p, *sums, F.coalesce("_n", F.lit(0)).alias("_kids"))
    rounds: list[tuple[str, str]] = []
    at, live = _put(live, "trie-live")
    while not live.isEmpty():
        turn = len(rounds)
        gone = live.filter("_kids = 0")
        gifts = (gone.filter(F.col(p[0]).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(p, g)])
                 .agg(*[F.sum(c).alias(f"{c}g") for c in sums], F.count("*").alias("_n")))
        rest = live.filter("_kids > 0")
        rest = rest.join(gifts, _on(rest, gifts, k, g), "left").select(
            *k, *p, *[(F.col(c) + F.coalesce(f"{c}g", F.lit(0))).alias(c) for c in sums],
            (F.col("_kids") - F.coalesce("_n", F.lit(0))).alias("_kids"))
        raked, rest = _put(rest, "trie-raked")
        rounds.append((at, raked))
        at, live = _put(_bypassed(rest, k, p, g, sums, turn), "trie-live")
    return _expanded(spark, live, rounds, k, p, sums).select(
        *[F.col(n).alias(c) for c, n in zip(key + weights, k + sums)])


def _chosen(rest: DataFrame, k: list[str], p: list[str], turn: int) -> Column:
    """Nodes with one child to bypass: never a node and its parent together."""
    return (F.col("_kids") == 1) & F.col(p[0]).isNotNull() & _coin(k, turn) & ~_coin(p, turn)


def _bypassed(rest: DataFrame, k: list[str], p: list[str], g: list[str], sums: list[str], turn: int) -> DataFrame:
    chosen = F.coalesce(_chosen(rest, k, p, turn), F.lit(False))
    out, stay = rest.filter(chosen), rest.filter(~chosen)
    up = out.select(*[F.col(c).alias(n) for c, n in zip(k, g)], *[F.col(c).alias(f"{c}n") for c in p])
    moved = stay.join(up, _on(stay, up, p, g), "left").select(
        *k, *[F.coalesce(f"{c}n", c).alias(c) for c in p], *sums, "_kids")
    gifts = out.groupBy(*[F.col(c).alias(n) for c, n in zip(p, g)]).agg(*[F.sum(c).alias(f"{c}g") for c in sums])
    return moved.join(gifts, _on(moved, gifts, k, g), "left").select(
        *k, *p, *[(F.col(c) + F.coalesce(f"{c}g", F.lit(0))).alias(c) for c in sums], "_kids")


def _expanded(spark: SparkSession, last: DataFrame, rounds: list[tuple[str, str]], k: list[str], p: list[str], sums: list[str]) -> DataFrame:
    """Totals of all nodes: rounds in reverse, each from the totals known after it."""
    kept, done = last.schema, last.select(*k, *sums).schema
    raked: list[str] = []  # tables whose leaves are final
    back: list[str] = []  # tables of totals of bypassed nodes

    def known() -> DataFrame:
        out = last.select(*k, *sums)
        if raked:
            out = out.unionByName(spark.read.schema(kept).parquet(*raked).filter("_kids = 0").select(*k, *sums))
        return out.unionByName(spark.read.schema(done).parquet(*back)) if back else out

    for turn in reversed(range(len(rounds))):
        before, after = rounds[turn]
        rest = spark.read.schema(kept).parquet(after)
        out = rest.filter(_chosen(rest, k, p, turn))
        if raked and not out.isEmpty():
            child = rest.select(*[F.col(c).alias(f"{c}c") for c in k], *[F.col(c).alias(f"{c}u") for c in p])
            pair = out.select(*k, *sums).join(child, _on(out, child, k, [f"{c}u" for c in p]))
            total = known().select(*[F.col(c).alias(f"{c}t") for c in k + sums])
            pair = pair.join(total, _on(pair, total, [f"{c}c" for c in k], [f"{c}t" for c in k]))
            path, _ = _put(pair.select(*k, *[(F.col(c) + F.col(f"{c}t")).alias(c) for c in sums]), "trie-back")
            back.append(path)
        raked.append(before)
    return known()


# --- the trie -------------------------------------------------------------------


def _slices(df: DataFrame, conv: str) -> DataFrame:
    """Slim turns (hashes and lengths, no texts), sorted and numbered by slice."""
    spark = df.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col("turn").alias("t"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit("turn"), role).alias("h2"), F.char_length(text).cast("long").alias("len"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["c", "t", "h1", "h2"]
    return stored(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "turns")


def _mark(depth: Column, salt: str) -> Column:
    """Half of a turn's contribution to the names of the nodes below it."""
    return F.xxhash64(F.lit(salt), depth.cast("long"), "h1", "h2")


def _nobody() -> Column:
    """No borrowed turns."""
    return F.from_json(F.lit("[]"), "array<struct<i: int, z1: bigint, z2: bigint, len: bigint>>")


def prefixes(df: DataFrame, conv: str = "conv_id", base: Column | None = None, head: Column | None = None) -> DataFrame:
    """All prefixes of all conversations: c, depth, name (k1, k2), name of the
    prefix before (p1, p2; null at depth 0), len of the last text, last (the
    whole conversation).

    With ``base`` and ``head`` (expressions of column c), the first ``head``
    turns (0 to HEAD) of a conversation are those of conversation ``base``.
    """
    turns = _slices(df, conv)
    base = F.lit(None).cast("long") if base is None else base
    head = F.lit(0) if head is None else head
    inside = W.partitionBy("part", "c").orderBy("t", "h1", "h2")
    few = turns.withColumn("i", F.row_number().over(inside)).filter(F.col("i") <= HEAD)
    few = few.withColumn("i", F.row_number().over(W.partitionBy("c").orderBy("part", "i"))).filter(F.col("i") <= HEAD)
    lent = (few.select("c", F.struct("i", _mark(F.col("i"), "a").alias("z1"), _mark(F.col("i"), "b").alias("z2"), "len").alias("s"))
            .groupBy(F.col("c").alias("b")).agg(F.sort_array(F.collect_list("s")).alias("lent")))  # at most HEAD turns
    pieces = turns.groupBy("part", "c").agg(F.count("*").alias("n"))
    along = W.partitionBy("c").orderBy("part")  # one row a slice
    pieces = pieces.withColumn("before", F.sum("n").over(along) - F.col("n"))
    convs = pieces.groupBy("c").agg(F.sum("n").alias("own"), F.count("*").alias("slices")).withColumns({"b": base, "head": head.cast("int")})
    convs = convs.join(lent, "b", "left").withColumn("lent", F.slice(F.coalesce("lent", _nobody()), 1, F.col("head")))
    zero = F.lit(0).cast("long")
    xor = {z: F.aggregate(f"lent.{z}", zero, lambda a, e: a.bitwiseXOR(e)) for z in ("z1", "z2")}
    convs = stored(convs.select("c", "own", "slices", "head", "lent", F.size("lent").alias("m"), xor["z1"].alias("x1"), xor["z2"].alias("x2"),
                                (F.size("lent") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("full")), "conversations")

    facts = pieces.join(convs.select("c", "head", "m", "x1", "x2", "full", "slices"), "c")
    own = turns.join(facts, ["part", "c"]).withColumn("place", F.col("before") + F.row_number().over(inside)).filter("place > head")
    own = own.withColumn("depth", F.col("place") - F.col("head") + F.col("m"))
    own = own.withColumns({"z1": _mark(F.col("depth"), "a"), "z2": _mark(F.col("depth"), "b")})
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = stored(own.select("part", "c", "depth", "len", "slices", (F.col("depth") == F.col("full")).alias("last"), "z1", "z2",
                            *[F.bit_xor(f"z{i}").over(upto).bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2)]), "prefixes")
    # only conversations cut into slices (at most two ends a partition) need what the slices before hold
    cut = own.filter("slices > 1").groupBy("part", "c").agg(F.bit_xor("z1").alias("o1"), F.bit_xor("z2").alias("o2"))
    ahead = along.rowsBetween(W.unboundedPreceding, -1)
    cut = cut.select("part", "c", *[F.coalesce(F.bit_xor(o).over(ahead), F.lit(0).cast("long")).alias(o) for o in ("o1", "o2")])
    own = own.join(cut, ["part", "c"], "left")
    name = {i: F.col(f"k{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    own = own.select("c", "depth", name[1].alias("k1"), name[2].alias("k2"), name[1].bitwiseXOR(F.col("z1")).alias("p1"),
                     name[2].bitwiseXOR(F.col("z2")).alias("p2"), "len", "last")

    upto_i = {i: F.aggregate(F.slice(f"lent.z{i}", 1, F.col("s.i")), zero, lambda a, e: a.bitwiseXOR(e)) for i in (1, 2)}
    borrowed = convs.select("c", "lent", "full", F.explode("lent").alias("s")).select(
        "c", F.col("s.i").cast("long").alias("depth"), "full", "s", upto_i[1].alias("k1"), upto_i[2].alias("k2"))
    borrowed = borrowed.select("c", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("s.z1")).alias("p1"),
                               F.col("k2").bitwiseXOR(F.col("s.z2")).alias("p2"), F.col("s.len").alias("len"), (F.col("depth") == F.col("full")).alias("last"))
    none = F.lit(None).cast("long")
    roots = convs.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("len"),
                         (F.col("full") == 0).alias("last"))
    return own.unionByName(borrowed).unionByName(roots)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, as text, in blocks (rows come sorted)."""
    at, first, ids = None, None, []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"k1": pa.array([at[0]], pa.int64()), "k2": pa.array([at[1]], pa.int64()),
                                           "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    for batch in batches:
        for k1, k2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (k1, k2) != at or len(ids) == BLOCK:
                if ids:
                    yield block()
                at, first, ids = (k1, k2), c, []
            ids.append(c)
    if ids:
        yield block()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks in order (rows come sorted); one block at a time in memory."""
    at, sha = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (k1, k2) == at:
                sha.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((*at, sha.hexdigest()))
            at, sha = (k1, k2), hashlib.sha256(ids.encode())
        yield _digest_rows(out)
    if at is not None:
        yield _digest_rows([(*at, sha.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], ["k1", "k2", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 (k1, k2, sha) of the ascending ids c of each node.  The ids of
    a node may lie in many partitions; only their text blocks meet."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "c"]
    runs = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks, "k1 long, k2 long, first long, ids string")
    return (runs.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
            .mapInArrow(_digests, "k1 long, k2 long, sha string"))


def conversation_trie(df: DataFrame, conv: str = "conv_id", base: Column | None = None, head: Column | None = None) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256; k1 and k2 name the node.
    `prefixes` explains ``base`` and ``head``."""
    paths = prefixes(df, conv, base, head)
    nodes = stored(paths.groupBy("k1", "k2").agg(F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                                 F.count("*").alias("n_convs"), F.max("len").alias("len")), "nodes")
    children = nodes.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    weighed = nodes.select("k1", "k2", "p1", "p2", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens"))
    totals = subtree_totals(weighed, ["k1", "k2"], ["p1", "p2"], ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, ["k1", "k2"]).join(end_digests(paths.filter("last")), ["k1", "k2"], "left").join(above, ["p1", "p2"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", nothing).alias("ends_sha256"), "k1", "k2")
