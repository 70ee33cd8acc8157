"""Exact duplicates by content-defined chunk recipes.

White-space runs are folded to one blank; the text is cut where a rolling
hash of the last 16 bytes says so, so equal stretches give equal chunks
wherever they stand.  A text becomes a recipe, the ordered list of its chunk
identifiers, and texts are equal exactly if their recipes are.

A chunk identifier is a 64-bit digest, verified: every distinct chunk travels
once to be compared byte by byte with the others of its digest, and where
different chunks share a digest they get variant numbers that become part of
the recipe.  Long texts themselves never move.

Null and empty texts are equal (an empty recipe).  Among equal texts the row
with the smallest key stays (null keys last, of fully equal rows any one).
Extra columns pass through `deduplicate` unchanged, clashing names included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, by_bytes, map_arrow, mix64, row_mark, sliced, stored, text_or_empty, without_rows

#: Runs that folding changes: all but a single blank between two words.
_FOLD = re.compile(r"[\t-\r][ \t-\r]*| [ \t-\r]+")

_GEAR = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_MIN, _AVG_BITS, _MAX = 512, 11, 16_384


def folded(text: str) -> bytes:
    return _FOLD.sub(" ", text).encode("utf-8")


def cut_points(raws: list[bytes]) -> list[list[int]]:
    """End offsets of the chunks of each text (none for an empty one).

    The 16-byte window hash is built by doubling: a window of 2k is a window
    of k plus the k-shifted window before it.
    """
    buf = np.frombuffer(b"".join(raws), np.uint8)
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - _AVG_BITS) == 0) + 1
    out, start = [], 0
    for raw in raws:
        end, cuts, last = start + len(raw), [], start
        # windows that begin before the text are never asked: a chunk has _MIN bytes at least
        for m in marks[np.searchsorted(marks, start):np.searchsorted(marks, end)].tolist():
            while m - last > _MAX:
                last += _MAX
                cuts.append(last - start)
            if m - last >= _MIN:
                last = m
                cuts.append(last - start)
        while end - last > _MAX:
            last += _MAX
            cuts.append(last - start)
        if last < end:
            cuts.append(end - start)
        out.append(cuts)
        start = end
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(folded text, its chunks) of each text, about 1 MB at a time."""
    plain = [t or "" for t in texts]
    for a, b in by_bytes(plain, 1 << 20):
        raws = [folded(t) for t in plain[a:b]]
        for raw, cuts in zip(raws, cut_points(raws)):
            yield raw, [raw[x:y] for x, y in zip([0, *cuts], cuts)]


def _digest(chunk: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)) - (1 << (bits - 1))


def text_sha256(text: Column) -> Column:
    """Hex SHA-256 of the folded text."""

    @arrow("string")
    def sha(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch, 1 << 22):
                yield pa.array([hashlib.sha256(folded(t or "")).hexdigest() for t in texts], pa.string())

    return sha(text)


def recipes(df: DataFrame, keep: list[str], text: str, bits: int = 64) -> DataFrame:
    """``keep`` columns, text_sha256 and recipe (array of chunk digests)."""

    @arrow("sha string, recipe array<long>")
    def recipe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch, 1 << 21):
                shas, lists = [], []
                for raw, parts in chunks(texts):
                    shas.append(hashlib.sha256(raw).hexdigest())
                    lists.append([_digest(c, bits) for c in parts])
                yield pa.StructArray.from_arrays([pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                                                 names=["sha", "recipe"])

    made = df.select(*keep, recipe(text_or_empty(text)).alias("_made"))
    return made.select(*keep, F.col("_made.sha").alias("text_sha256"), F.col("_made.recipe").alias("recipe"))


def chunk_rows(df: DataFrame, text: str, bits: int) -> DataFrame:
    """(digest, chunk) rows, each chunk once a batch at least."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in sliced(batch.column(0), 1 << 23):
                yield _chunk_batch({c for _, parts in chunks(texts) for c in parts}, bits)

    return map_arrow(df.select(text_or_empty(text).alias("t")), rows, "digest long, chunk binary")


def _chunk_batch(found: set[bytes], bits: int) -> pa.RecordBatch:
    parts = list(found)
    return pa.RecordBatch.from_arrays([pa.array([_digest(c, bits) for c in parts], pa.int64()),
                                       pa.array(parts, pa.binary())], names=["digest", "chunk"])


def _variants(df: DataFrame, text: str, bits: int, known: DataFrame) -> DataFrame | None:
    """For texts with a chunk whose digest stands for several chunks: the
    variant number of each such chunk by place; None if there is none."""
    distinct = chunk_rows(df, text, bits).dropDuplicates(["digest", "chunk"])
    shared = stored(distinct.groupBy("digest").count().filter("count > 1").select("digest"), "shared-digests")
    if shared.isEmpty():
        return None
    # different chunks of one digest, numbered; a chunk's number is how many smaller ones there are
    mine = chunk_rows(df, text, bits).dropDuplicates(["digest", "chunk"]).join(shared, "digest", "left_semi")
    sha = mine.select("digest", F.sha2("chunk", 256).alias("chunk_sha"))
    affected = (known.select("text_sha256", F.explode("recipe").alias("digest")).join(shared, "digest", "left_semi")
                .select("text_sha256").distinct())
    texts = (df.select(text_or_empty(text).alias("t"), text_sha256(F.col(text).cast("string")).alias("text_sha256"))
             .join(affected, "text_sha256", "left_semi").dropDuplicates(["text_sha256"]).select("t", "text_sha256"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (_, parts) in zip(batch.column(1).to_pylist(), chunks(batch.column(0).to_pylist())):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()),
                     pa.array([_digest(c, bits) for c in parts], pa.int64()),
                     pa.array([hashlib.sha256(c).hexdigest() for c in parts], pa.string())],
                    names=["text_sha256", "place", "digest", "chunk_sha"])

    at = map_arrow(texts, places, "text_sha256 string, place int, digest long, chunk_sha string")
    return (at.join(sha, ["digest", "chunk_sha"]).groupBy("text_sha256")
            .agg(F.sort_array(F.collect_list(F.struct("place", "chunk_sha"))).alias("variant")))  # one text's chunks


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row for every input row: key, keep_id (key of the row that stays),
    group_size, kept, text_sha256 (of the folded text), mark (of the raw text).

    ``bits`` shortens the chunk digest (for tests of the variant path).
    """
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"), row_mark(text).alias("mark"))
    known = stored(recipes(slim, ["key", "mark"], "text", bits)
                   .withColumn("row", F.monotonically_increasing_id()), "recipes")
    variants = _variants(df, text, bits, known)
    named = known
    identity = ["recipe"]
    if variants is not None:
        named = known.join(variants, "text_sha256", "left")
        named = named.withColumn("variant", F.coalesce("variant", F.array().cast(named.schema["variant"].dataType)))
        identity = ["recipe", "variant"]
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))
    groups = named.groupBy(*identity).agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    return (named.join(groups, identity)
            .select(F.col("key").alias(key), F.col("first.key").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "mark"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its own columns."""
    groups = exact_groups(df, key, text)
    return without_rows(df, groups.select(F.col(key).alias("key"), "mark", "kept"), key, text)
