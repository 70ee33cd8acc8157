"""Phrase collocation mining after Toivonen.

A sample of the documents proposes phrases at a lowered threshold.  One full
pass then counts, over all documents, the proposals together with their
negative border: every word, and every longer phrase whose first and last
part (all words but one) are proposed.  A border phrase that turns out
frequent is a failure of the sample: it joins the proposals and a further
pass counts the border that it opens, until no failure is left.  Where the
failures are few (`FEW`), that pass goes on from the border: it also counts
longer phrases whose parts it counts itself, frequent or not, so that one pass
repairs all failures.  Counts are exact whatever the sample was; a poor sample
only costs passes.

Tasks know the proposals by a Bloom filter of fixed size (`FILTER_BITS`), not
as a list, since frequent phrases grow with the corpus.  A false positive
only means that a phrase more is counted, so results do not depend on it.

A phrase is named by its language and the 64-bit hashes of its words; the
words themselves are read back, by one pass, for the phrases returned.

Defined results: null text is empty, null language is ``und``; texts without
words and empty tables give no rows; repeated documents count each time; long
texts are hashed in segments cut between words, phrases cross the cuts; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, mix64, powers, stored, text_or_empty

LONGEST = 4  #: words of the longest phrase
FILTER_BITS = 26  #: log2 of the Bloom filter's bits: 8 MB, whatever the corpus
PROBES = 4
SEGMENT = 1 << 16  #: bytes hashed at a time
TAKEN = 1 << 20  #: bytes of texts read at a time
CHUNK = 1 << 19  #: occurrences counted at a time
HELD = 1 << 18  #: rows of counts that a task holds
FEW = 0.25  #: failures' bits for each bit of the proposals, up to which one pass repairs them all
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


def _segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """``raw`` in pieces of about SEGMENT bytes that end at a gap, with their offsets."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > SEGMENT and (m := _CUT.search(raw, at + SEGMENT)):
            end = m.end()
        yield at, raw[at:end]
        at = end


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of ``raw``: its hash (never 0), the piece that it stands in,
    and where it starts and ends."""
    found, pieces = [], 0
    for at, part in _segments(raw):
        buf = _LOWER[np.frombuffer(part, np.uint8)]
        edge = np.diff((~_GAP[buf]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(buf))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])])
        h = mix64((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64))
        breaks = np.cumsum(_BREAK[buf], dtype=np.int64)
        found.append((np.where(h == 0, np.uint64(1), h), breaks[start] + pieces, start + at, end + at))
        pieces += int(breaks[-1]) if len(buf) else 0
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _seed(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % (1 << 64))


def _join(name: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The name of a phrase from that of its first part and its last word."""
    return mix64(name * np.uint64(0xD6E8FEB86659FD93) + word)


class Filter:
    """A Bloom filter of phrase names; its size does not depend on their number."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _step(names: np.ndarray) -> np.ndarray:
        return mix64(names ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)

    @staticmethod
    def places(names: np.ndarray) -> np.ndarray:
        step = Filter._step(names)
        return np.stack([(names + np.uint64(i) * step) >> np.uint64(64 - FILTER_BITS) for i in range(PROBES)])

    def has(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        step, left = self._step(names), np.arange(len(names))
        for i in range(PROBES):  # most unknown names fail the first probe
            p = (names[left] + np.uint64(i) * step[left]) >> np.uint64(64 - FILTER_BITS)
            left = left[(self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        out[left] = True
        return out


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, joined by line ends (no phrase crosses one)."""
    langs = batch.column("lang").to_pylist()
    texts = batch.column("text").cast(pa.large_binary())
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    for lang, rows in by.items():
        part, size = [], 0
        for i in rows:
            raw = texts[i].as_py()
            part.append(raw)
            size += len(raw) + 1
            if size > TAKEN:
                yield lang, b"\n".join(part)
                part, size = [], 0
        if part:
            yield lang, b"\n".join(part)


def occurrences(w: np.ndarray, piece: np.ndarray, seed: np.uint64, known: Filter | None,
                before: Filter | None = None, onward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For lengths 1, 2, ..: where a proposal or a border phrase of that length
    starts, the names of the phrases there, and which of them the smaller
    filter ``before`` would not have let through; ``onward`` takes these for
    known, since nobody has counted them yet."""
    at, name = np.arange(len(w)), mix64(w ^ seed)
    new = np.full(len(w), before is None)
    yield at, name, new
    for k in range(2, LONGEST + 1):
        if known is None:
            return
        good, old = np.zeros(len(w) + 1, bool), np.zeros(len(w) + 1, bool)
        good[at] = known.has(name)
        if before is not None:
            seen = np.flatnonzero(good[at] & ~new)
            old[at[seen]] = before.has(name[seen])
            if onward:
                good[at[new]] = True
        # the first and the last part are known, and both lie in one piece
        spot = np.flatnonzero(good[at] & good[at + 1])
        spot = spot[: np.searchsorted(at[spot], len(w) - k + 1)]
        spot = spot[piece[at[spot]] == piece[at[spot] + k - 1]]
        at = at[spot]
        name = _join(name[spot], w[at + k - 1])
        new = ~(old[at] & old[at + 1])
        yield at, name, new


_ROW = "lang string, " + ", ".join(f"{c} long" for c in WORDS) + ", n long"


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Tables of name, words and count (rows of a 6 x m array) added up by name, in the order of names.

    One row of the tables is brought together at a time: beside the tables
    and the result, two rows are held and not two more tables."""
    name = np.concatenate([p[0] for p in parts])
    order = np.argsort(name)  # equal names have the same words, so their order is free
    name = name[order]
    first = np.flatnonzero(np.diff(name, prepend=name[:1] + np.uint64(1)) != 0) if len(name) else np.zeros(0, np.int64)
    out = np.empty((LONGEST + 2, len(first)), np.uint64)
    out[0] = name[first]
    del name
    for c in range(1, LONGEST + 1):
        out[c] = np.concatenate([p[c] for p in parts])[order[first]]
    if len(first):
        out[-1] = np.add.reduceat(np.concatenate([p[-1] for p in parts])[order], first)
    return out


def _table(w: np.ndarray, at: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Distinct phrases of length k among their places, with counts."""
    order = np.argsort(name)
    name = name[order]
    first = np.flatnonzero(np.diff(name, prepend=name[:1] + np.uint64(1)) != 0)
    out = np.zeros((LONGEST + 2, len(first)), np.uint64)
    out[0], out[-1] = name[first], np.diff(first, append=len(name))
    spot = at[order[first]]
    for j in range(k):
        out[1 + j] = w[spot + j]
    return out


def _blobs(lang: str, table: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row a bucket of names: words and counts, column after column."""
    cut = np.searchsorted(table[0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)),
         pa.array([table[1:, cut[b]:cut[b + 1]].tobytes() for b in full.tolist()], pa.binary())], ["lang", "bucket", "rows"])


def _counter(lengths: set[int], known, before, onward: bool, bits: int):
    """Counts by language and phrase of the lengths asked for, in packed
    tables; phrases that an earlier pass counted (those that ``before`` let
    through) are left out.  The phrase without words holds the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = (None if x is None else Filter(x.value) for x in (known, before))
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, raw in _batches(batch):
                w, piece, _, _ = words(raw)
                if not len(w):
                    continue
                seed, parts = _seed(lang), []
                for k, (at, name, new) in enumerate(occurrences(w, piece, seed, now, old, onward), 1):
                    if k not in lengths:
                        continue
                    at, name = at[new], name[new]
                    parts += [_table(w, at[i:i + CHUNK], name[i:i + CHUNK], k) for i in range(0, len(at), CHUNK)]
                if 1 in lengths:
                    zero = np.zeros(1, np.uint64)
                    parts.append(np.stack([mix64(zero ^ seed), zero, zero, zero, zero, np.array([len(w)], np.uint64)]))
                held.setdefault(lang, []).extend(parts)
                size[lang] = size.get(lang, 0) + sum(p.shape[1] for p in parts)
            while sum(size.values()) > HELD:
                most = max(size, key=size.get)
                del size[most]
                yield _blobs(most, _added(held.pop(most)), bits)
        for lang, parts in held.items():
            if parts:
                yield _blobs(lang, _added(parts), bits)

    return count


def _summed(least: int):
    """Adds the packed tables of a bucket (rows come sorted by bucket)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size, most = None, [], 0, HELD

        def total() -> pa.RecordBatch:
            t = _added(parts)
            t = t[:, (t[5] >= least) | (t[1] == 0)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * t.shape[1], pa.string()), *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(t[1:]))],
                                              ["lang", *WORDS, "n"])

        for batch in batches:
            for lang, bucket, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (lang, bucket) != key:
                    if parts:
                        yield total()
                    key, parts, size, most = (lang, bucket), [], 0, HELD
                cols = np.frombuffer(rows, np.uint64).reshape(5, -1)
                parts.append(np.vstack([_named(cols[:4], _seed(lang))[None], cols]))
                size += cols.shape[1]
                if size > most:  # twice the distinct rows at most
                    parts = [_added(parts)]
                    size = parts[0].shape[1]
                    most = max(HELD, 2 * size)
        if parts:
            yield total()

    return add


def _counted(docs: DataFrame, least: int, lengths: set[int], known=None, before=None, onward: bool = False) -> DataFrame:
    """Exact counts of at least ``least``, and the number of words of each
    language.  Tasks add their counts up before the shuffle, which moves one
    packed table a bucket and not a row a phrase."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = parts.bit_length()  # one to two buckets a partition and language
    packed = map_arrow(docs, _counter(lengths, known, before, onward, bits), "lang string, bucket int, rows binary")
    return map_arrow(packed.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket"), _summed(least), _ROW)


def _named(cols: np.ndarray, seed: np.uint64 | np.ndarray) -> np.ndarray:
    """Names of phrases from their words."""
    name = mix64(cols[0] ^ seed)
    for c in cols[1:]:
        name = np.where(c != 0, _join(name, c), name)
    return name


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases (rows of lang and words) and their lengths."""
    cols = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in WORDS])
    kinds = batch.column("lang").dictionary_encode()
    seeds = np.array([_seed(x) for x in kinds.dictionary.to_pylist()], np.uint64)
    return _named(cols, seeds[kinds.indices.to_numpy()]), (cols != 0).sum(axis=0)


def _filter_words(known):
    """The 64-bit words of the filter that unknown phrases set."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None if known is None else Filter(known.value)
        for batch in batches:
            name, size = _names(batch)
            new = size < LONGEST  # the longest have no extension
            if now is not None:
                new &= ~now.has(name)
            p = Filter.places(name[new]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["at", "mask"])

    return places


def _widened(spark, phrases: DataFrame, known):
    """The broadcast filter with the unknown ones of ``phrases`` in it, or None
    if all are known.  At most 2**FILTER_BITS / 64 rows reach the driver."""
    marks = (map_arrow(phrases.filter("w1 <> 0").select("lang", *WORDS), _filter_words(known), "at long, mask long")
             .groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow())
    if not marks.num_rows:
        return None
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64) if known is None else known.value.copy()
    bits[marks.column("at").to_numpy()] |= marks.column("mask").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def phrase_counts(docs: DataFrame, least: int = 30, share: float = 0.25, key: str = "doc_id") -> tuple[DataFrame, int]:
    """All phrases of 1 to 4 words that occur ``least`` times or more in a
    language (columns lang, w1 .. w4, n; words are hashes, 0 for none; the row
    without words holds the language's number of words), and how many
    expansion passes the sample's failures took.

    ``docs`` has lang and text.  ``share`` of the documents, by a hash of
    ``key``, is the sample; its threshold is lowered by two standard deviations.
    """
    spark = docs.sparkSession
    whole = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    sample = docs.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1000)) < round(share * 1000))
    sample = sample.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    enough = max(1, int(share * least - 2 * (share * least) ** 0.5))
    known = None
    for k in range(1, LONGEST):  # proposals, one length after the other
        wider = _widened(spark, _counted(sample, enough, {k}, known), known)
        if wider is None:
            break
        known = wider
    if known is None:
        known = spark.sparkContext.broadcast(np.zeros(1 << (FILTER_BITS - 6), np.uint64))
    found = [stored(_counted(whole, least, set(range(1, LONGEST + 1)), known), "phrases")]
    onward = False
    while not onward and (wider := _widened(spark, found[-1], known)) is not None:
        more, most = (int(np.bitwise_count(x.value).sum()) for x in (wider, known))
        onward = more - most <= FEW * most  # all that follows from the failures is counted: no failure is left
        found.append(stored(_counted(whole, least, set(range(2, LONGEST + 1)), wider, known, onward), "phrases"))
        known = wider
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, len(found) - 1


def _length() -> Column:
    return sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in WORDS), F.lit(0))


def _part(first: int, size: int) -> list[Column]:
    """The words ``first`` .. of a phrase, moved to the front."""
    return [F.col(WORDS[first + j]) if j < size else F.lit(0).cast("long") for j in range(LONGEST)]


def _as_struct(first: int, size: int, **more: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(_part(first, size), WORDS)], *[v.alias(k) for k, v in more.items()])


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (2 to 4 words) that no longer one absorbs: lang, w1 .. w4, a, l, r, score."""
    phrases = counts.filter("w1 <> 0").withColumn("k", _length())
    longer = phrases.filter("k > 2")
    inside = F.array(*[F.when(F.lit(at + size) <= F.col("k"), _as_struct(at, size)) for size in range(2, LONGEST)
                       for at in range(LONGEST - size + 1) if size < LONGEST])
    inside = F.filter(inside, lambda s: s.isNotNull())
    held = (longer.select("lang", "n", F.explode(F.filter(inside, lambda s: _struct_size(s) < F.col("k"))).alias("s"))
            .groupBy("lang", *[F.col(f"s.{c}").alias(c) for c in WORDS]).agg(F.max("n").alias("held")))
    left = phrases.filter("k > 1").join(held, ["lang", *WORDS], "left")
    left = left.filter(~F.coalesce(F.col("held").cast("decimal(38,0)") * 100 >= F.col("n").cast("decimal(38,0)") * 80, F.lit(False))).drop("held")
    # every cut asks for the counts of its two parts
    cuts = [F.when(F.lit(c) < F.col("k"), F.array(_as_struct(0, c, cut=F.lit(c), side=F.lit(0)), _rest(c))) for c in range(1, LONGEST)]
    asked = left.select("lang", F.struct(*WORDS).alias("p"), "n",
                        F.explode(F.flatten(F.filter(F.array(*cuts), lambda x: x.isNotNull()))).alias("s"))
    asked = asked.select("lang", "p", F.col("n").alias("a"), F.col("s.cut").alias("cut"), F.col("s.side").alias("side"),
                         *[F.col(f"s.{c}").alias(c) for c in WORDS])
    given = asked.join(phrases.select("lang", *WORDS, "n"), ["lang", *WORDS])
    sides = given.groupBy("lang", "p", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"),
                                                       F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    score = F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = sides.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", *[F.col(f"p.{c}").alias(c) for c in WORDS], "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"),
                       F.col("b.score").cast("long").alias("score"))


def _struct_size(s: Column) -> Column:
    return sum((F.when(s[c] != 0, 1).otherwise(0) for c in WORDS), F.lit(0))


def _rest(cut: int) -> Column:
    """What follows the first ``cut`` words, as a request for its count."""
    return F.struct(*[(F.col(WORDS[cut + j]) if cut + j < LONGEST else F.lit(0).cast("long")).alias(n) for j, n in enumerate(WORDS)],
                    F.lit(cut).alias("cut"), F.lit(1).alias("side"))


def _reader(known):
    """(lang, hash, word) of the words that the filter knows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Filter(known.value)
        for batch in batches:
            for lang, raw in _batches(batch):
                w, _, start, end = words(raw)
                order = np.argsort(w)  # equal hashes have the same word, so any place serves
                h = w[order]
                first = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0)
                h, first = h[first], order[first]
                keep = now.has(mix64(h ^ _seed(lang)))
                texts = [raw[start[i]:end[i]].lower().decode() for i in first[keep]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), pa.array(h[keep].view(np.int64)),
                                                  pa.array(texts, pa.string())], ["lang", "w", "word"])

    return read


def _ahead(found: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The first ``top`` of each language; ties at the last place stay until
    the spelling decides.  They are among the first of their part of the
    language, so a language is ranked in parts before it is ranked whole."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = found.withColumn("_part", F.pmod(F.xxhash64(*WORDS), F.lit(parts)))
    for keys in (["lang", "_part"], ["lang"]):
        some = some.withColumn("_place", F.rank().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= top)
    return some.drop("_part", "_place")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: float = 0.25, key: str = "doc_id") -> DataFrame:
    """The ``top`` phrases of each language by score, count and spelling:
    lang, rank, phrase, a, l, r, n, score."""
    counts, _ = phrase_counts(docs, least, share, key)
    order = [F.desc("score"), F.desc("a")]
    ahead = stored(_ahead(scored(counts), top, order), "collocations")
    asked = ahead.select("lang", F.struct(*WORDS).alias("p"), F.posexplode(F.array(*WORDS)).alias("i", "w")).filter("w <> 0")
    single = asked.select("lang", F.col("w").alias("w1"), *[F.lit(0).cast("long").alias(c) for c in WORDS[1:]]).distinct()
    known = _widened(docs.sparkSession, single, None)
    if known is None:
        return ahead.select("lang", F.lit(0).cast("long").alias("rank"), F.lit("").alias("phrase"), "a", "l", "r", F.col("a").alias("n"), "score")
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    spelt = map_arrow(plain, _reader(known), "lang string, w long, word string").groupBy("lang", "w").agg(F.min("word").alias("word"))
    phrase = (asked.join(spelt, ["lang", "w"]).groupBy("lang", "p").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("x"))
              .select("lang", *[F.col(f"p.{c}").alias(c) for c in WORDS], F.array_join("x.word", " ").alias("phrase")))
    sizes = counts.filter("w1 = 0").select("lang", "n")
    full = ahead.join(phrase, ["lang", *WORDS]).join(sizes, "lang")
    ranked = full.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
