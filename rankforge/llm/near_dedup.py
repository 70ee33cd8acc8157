"""Near duplicates by ProbMinHash.

A text is the set of its distinct five-word shingles, all of weight 1.  Every
shingle sends a Poisson process of arrivals (rate = weight) to random
registers of the text's sketch; a register keeps the shingle that came first,
and a shingle stops as soon as its next arrival is later than the latest
register, so long texts cost little more than one arrival a shingle.  Two
sketches agree in a register with the probability Jaccard similarity of the
texts, which at equal weights is the Jaccard similarity that decides the
classes: weights by count would part texts that differ in how often a line is
repeated.  Bands of registers are bucket keys; bucket mates whose whole sketches
(four bits a register) do not rule it out are verified with the exact Jaccard
similarity of their distinct shingles.

Inside a bucket no list of all pairs is made.  A few leaders are compared
with the members of other classes, verified links merge classes, leaders
leave, and this repeats until every bucket holds one class: each pair that
could still join two classes is compared, pairs inside a class never are.
Texts with the same words are one node from the start.

Texts of one to four words have one shingle (all their words).  Texts
without words (null, empty, punctuation) are alone in their class.  Ties and
repeated rows share a class; its id is the smallest key, and the first such
row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Pile, arrow, discard, mix64, row_mark, sliced, stored, text_or_empty, without_rows, word_hashes
from .graph import components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 48, 10
#: Leaders of a bucket in the first rounds (taken from all members) and later
#: (from the members outside the largest class).
EARLY, LEADERS = (1, 16, 16), 64
_LOW48 = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[str], words: int = WORDS) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """128-bit key of each text's word sequence, owner and hash of every
    shingle (2**16 texts at most)."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    keys = [xxhash.xxh3_128_digest(hashes[e - n:e]) if n else None for n, e in zip(counts.tolist(), ends.tolist())]
    owner, mine = np.repeat(np.arange(len(texts)), counts), np.repeat(counts, counts)
    code = np.zeros(len(hashes), np.uint64)
    left = np.repeat(ends, counts) - np.arange(len(hashes))  # words from here to the end
    for k in range(words):
        part = np.zeros(len(hashes), np.uint64)
        part[: max(0, len(hashes) - k)] = hashes[k:]
        code = np.where(left > k, mix64(code + _STEP) + part, code)
    whole = (left >= words) | ((mine < words) & (left == mine))
    return keys, owner[whole], mix64(code[whole])


def distinct(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 48-bit code of the distinct shingles."""
    both = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (code & _LOW48))
    new = np.flatnonzero(np.diff(both, prepend=both[:1] ^ np.uint64(1))) if len(both) else np.zeros(0, np.int64)
    return (both[new] >> np.uint64(48)).astype(np.int64), both[new] & _LOW48


def sketch(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash sketches (texts x size) of distinct weighted elements; a row
    without elements stays 0."""
    first = np.full(texts * size, np.inf)
    who = np.zeros(texts * size, np.uint64)
    live, when, turn = np.arange(len(code)), np.zeros(len(code)), 0
    latest = np.full(texts, np.inf)
    single = np.bincount(owner, minlength=texts)[owner] == 1
    for t, c in zip(owner[single], code[single]):  # one element wins every register
        who[t * size:(t + 1) * size] = c
    live = live[~single]
    while len(live):
        turn += 1
        draw = mix64(code[live] + np.uint64(turn * int(_STEP) & (1 << 64) - 1))
        uniform = ((draw >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
        when[live] -= np.log(uniform) / weight[live]
        at = owner[live] * size + (mix64(draw) % np.uint64(size)).astype(np.int64)
        now = when[live]
        np.minimum.at(first, at, now)
        won = now == first[at]
        who[at[won]] = code[live[won]]
        mine = owner[live]
        open_ = np.unique(mine)
        latest[open_] = first.reshape(texts, size)[open_].max(axis=1)
        live = live[now < latest[mine]]
    return who.reshape(texts, size)


def band_keys(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = who.reshape(len(who), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, part.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key ^ part[:, :, r]) + _STEP
    return key.view(np.int64)


def bit_sketch(who: np.ndarray) -> np.ndarray:
    """Four bits a register, 16 registers to a word."""
    nibbles = (mix64(who.ravel()) & np.uint64(15)).astype(np.uint8).reshape(who.shape)
    nibbles = np.pad(nibbles, ((0, 0), (0, -who.shape[1] % 16)))
    return np.ascontiguousarray(nibbles[:, ::2] << 4 | nibbles[:, 1::2]).view(np.int64)


def _far_sketches(a: str, b: str, similar: float, registers: int) -> Column:
    """Whether the small sketches rule the similarity out: two registers
    differ in four bits with probability 15/16 (1 - J), and three standard
    deviations are granted."""
    p = (1 - similar) * 15 / 16
    most = registers * p + 3 * (registers * p * (1 - p)) ** 0.5
    differ = F.lit(0)
    for i in range(-(-registers // 16)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ > F.lit(int(most))


def sketches(df: DataFrame, keep: list[str], text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``keep`` columns, words (16-byte key of the word sequence, null without
    words), n (distinct shingles), bands (array of bucket keys) and bits (the
    sketch, four bits a register)."""

    @arrow("words binary, n int, bands array<long>, bits array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch, 1 << 21, 2048):
                names, owner, code = shingles(texts)
                owner, code = distinct(owner, code)
                who = sketch(owner, code, np.ones(len(code)), len(names), bands * rows)
                number = np.bincount(owner, minlength=len(names)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * bands),
                                                 pa.array(band_keys(who, bands, rows).ravel()))
                bits = bit_sketch(who)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * bits.shape[1]),
                                                  pa.array(bits.ravel()))
                yield pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(number), lists, packed],
                                                 names=["words", "n", "bands", "bits"])

    return df.select(*keep, made(text_or_empty(text)).alias("_made")).select(*keep, "_made.*")


def shingle_sets(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, words and the sorted distinct shingle codes."""

    @arrow("words binary, codes array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch, 1 << 21):
                names, owner, code = shingles(texts)
                sets = [np.unique(c).view(np.int64) for c in np.split(code, np.searchsorted(owner, np.arange(1, len(names))))]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.StructArray.from_arrays([pa.array(names, pa.binary()), lists], names=["words", "codes"])

    return df.select(*keep, made(text_or_empty(text)).alias("_made")).select(*keep, "_made.*")


def _close_sizes(a: str, b: str, similar: float):
    return F.least(a, b) >= F.lit(similar) * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) among ``pairs`` by exact Jaccard similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("codes").alias(f"codes_{x}")) for x in "ab")
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    return (pairs.join(b, "b").join(a, "a")
            .filter(both >= F.lit(similar) * (F.size("codes_a") + F.size("codes_b") - both)).select("a", "b"))


def _bucket_classes(buckets: DataFrame, sets: DataFrame, similar: float) -> DataFrame | None:
    """Classes (node, cls) of the linked nodes, from buckets (band, node, n, bits).

    Every round: some members of a bucket (the smallest node of each slot)
    meet the members of other classes, then leave.  The first rounds take
    them from all members: a few members of a large class catch nearly all
    that belong to it.  Later ones take those outside the largest class,
    until one class is left.
    """
    spark, cls, turn = buckets.sparkSession, None, 0
    links, tested = Pile(spark, "links"), Pile(spark, "met")
    rest, used = buckets, []
    while True:
        own = rest if cls is None else rest.join(cls, "node", "left")
        own = own.withColumn("cls", F.col("node") if cls is None else F.coalesce("cls", "node"))
        mixed = (own.groupBy("band", "cls").agg(F.count("*").alias("k")).groupBy("band")
                 .agg(F.max(F.struct("k", "cls")).alias("top"), F.count("*").alias("classes"))
                 .filter("classes > 1").select("band", F.col("top.cls").alias("top")))
        own = stored(own.join(mixed, "band"), "buckets")
        for old in used:  # the rounds before are not read again
            discard(old)
        if own.isEmpty():
            return cls
        early = turn < len(EARLY)
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(EARLY[turn] if early else LEADERS))
        chosen = (own if early else own.filter("cls <> top")).groupBy("band", slot.alias("slot")).agg(
            F.min(F.struct("node", "n", "cls", "bits")).alias("x"))
        leaders = stored(chosen.select("band", F.col("x.node").alias("leader"), F.col("x.n").alias("m"),
                                       F.col("x.cls").alias("their"), F.col("x.bits").alias("their_bits")), "leaders")
        met = (own.join(leaders, "band")
               .filter((F.col("cls") != F.col("their")) & _close_sizes("n", "m", similar)
                       & ~_far_sketches("bits", "their_bits", similar, BANDS * ROWS))
               .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
        if turn:  # a pair refuted in one bucket is not asked for again in another
            met = met.join(tested.whole(), ["a", "b"], "left_anti")
        met = tested.put(met)
        new = links.put(_verified(met, sets, similar))
        if not new.isEmpty():
            cls = components(links.whole())
        rest = (own.select("band", "node", "n", "bits")
                .join(leaders.select("band", F.col("leader").alias("node")), ["band", "node"], "left_anti"))
        used = [own, leaders]
        turn += 1


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row for every input row: key, class_id (smallest key of its class),
    class_size, kept (the one row of its class that stays), mark."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"), row_mark(text).alias("mark"))
    rows = stored(sketches(slim, ["key", "mark"]).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))
    nodes = stored(rows.filter("words is not null").groupBy("words")
                   .agg(F.min("row").alias("node"), F.min(first).alias("first"), F.count("*").alias("size"),
                        F.min(F.struct("row", "n", "bands", "bits")).alias("x"))
                   .select("words", "node", "first", "size", "x.n", "x.bands", "x.bits"), "nodes")
    # only (band, node) goes through the large shuffles; sizes and sketches join what is left
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band")
    buckets = stored(banded.join(shared, "band", "left_semi").join(nodes.select("node", "n", "bits"), "node"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(
        "node", "words", F.col("first.key").alias("wanted_key"))
    texts = (slim.join(wanted, slim.key.eqNullSafe(wanted.wanted_key))
             .select("node", F.col("words").alias("wanted"), "text"))
    sets = stored(shingle_sets(texts, ["node", "wanted"], "text").filter("words = wanted")
                  .select("node", "codes").dropDuplicates(["node"]), "shingle-sets")
    linked = _bucket_classes(buckets, sets, similar)
    if linked is None:
        classed = nodes.withColumn("cls", F.col("node"))
    else:
        classed = nodes.join(linked, "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    classed = stored(classed.select("words", "cls", "first", "size"), "classed")
    classes = classed.groupBy("cls").agg(F.min("first").alias("best"), F.sum("size").alias("class_size"))
    named = classed.join(classes, "cls").select("words", "best", "class_size")
    # rows without words have no class to look up: they stay out of the join, where they would be one key
    found = rows.filter("words is not null").select("key", "mark", "row", "words").join(named, "words").drop("words")
    found = found.unionByName(rows.filter("words is null").select("key", "mark", "row"), allowMissingColumns=True)
    alone = F.col("best").isNull()
    return (found.select(F.col("key").alias(key),
                    F.when(alone, F.col("key")).otherwise(F.col("best.key")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                    (alone | (F.col("row") == F.col("best.row"))).alias("kept"), "mark"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` that stay, one of each class, with its own columns."""
    groups = near_groups(df, key, text, similar)
    return without_rows(df, groups.select(F.col(key).alias("key"), "mark", "kept"), key, text)
