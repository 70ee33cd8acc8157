"""Benchmark decontamination by latent semantic retrieval.

Texts are read as passages: windows of 32 words, 16 apart.  Words are hashed
to 2**14 features with TF-IDF weights.  A randomised SVD of the passage by
feature matrix is computed by Spark: every task multiplies its passages with
the current basis and adds up its share of A'(A B); only features x rank
sums leave it.  Two passes give the right singular vectors.  Passages and
benchmark items are projected to the whitened latent space, and a passage
whose cosine to a passage of an item is high enough makes the stretch of text
around it a candidate.  All passages of all texts are searched; the items are
the stated query set and are compared in blocks.

Short items fill only part of a passage and can miss the cosine, so an exact
index of the items' word runs stands beside the search.  It holds the three-
or four-word runs of every item, of which a stretch with 0.8 of an item keeps
a known number however its words were dropped or replaced; stretches with
that many are candidates as well.

Candidates are decided on the words themselves: the longest common
subsequence of the item and the stretch must cover 0.8 of the item or of one
of its passages, or, for paraphrases, 0.6 of its content words while its
answer (the last words, or a given answer column) is found as well.  A run of
13 words of an item is a hit by itself.

Items of fewer than 8 words match by the exact run of all their words; null
and empty texts match nothing.  The cosine of what only the index found is
null.  Equal items give one row each; repeated rows
of documents are reported once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, powers, row_mark, sliced, text_or_empty, without_rows, word_hashes

BITS, RANK, HALF = 14, 64, 16
FEATURES = 1 << BITS
HELD = 1 << 14  # half passages whose sums are spread to features at a time
LEAST_WORDS = 8


@dataclass
class Config:
    cosine: float = 0.45
    shared: float = 0.4  # of the distinct words of an item's passage, before the longer check
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.8
    answer_words: int = 5
    common: float = 0.02  # words in more half-passages than this are no content words
    item_block: int = 20_000
    run: int = 13  # words of an item in a row that are a hit by themselves


@dataclass
class Blocks:
    """Words of some texts, padded to half passages of HALF words."""

    words: np.ndarray  # (blocks, HALF) hashes; padding 0
    feature: np.ndarray  # (blocks, HALF); padding FEATURES
    per_text: np.ndarray  # blocks of each text
    counts: np.ndarray  # words of each text


def blocks(texts: list[str]) -> Blocks:
    hashes, counts = word_hashes(texts)
    per_text = -(-counts // HALF)
    pad = np.cumsum(per_text * HALF - counts) - (per_text * HALF - counts)
    at = np.arange(len(hashes)) + np.repeat(pad, counts)
    words = np.zeros(int(per_text.sum()) * HALF, np.uint64)
    feature = np.full(len(words), FEATURES, np.int64)
    words[at] = hashes
    feature[at] = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return Blocks(words.reshape(-1, HALF), feature.reshape(-1, HALF), per_text, counts)


def passages(b: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """The first half passage of every passage, and whether a second one
    follows (a text of one half passage has one short passage)."""
    last = np.cumsum(b.per_text) - 1
    opens = np.ones(len(b.words), bool)
    opens[last[b.per_text > 1]] = False
    first = np.flatnonzero(opens)
    lonely = np.zeros(len(b.words), bool)
    lonely[last[b.per_text == 1]] = True
    return first, ~lonely[first]


def pair_up(first: np.ndarray, two: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Passage sums from half passage sums."""
    out = half[first]
    out[two] += half[first[two] + 1]
    return out


def half_sums(feature: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table rows of every row of ``feature``, one column after the
    other, in slices that stay in cache."""
    out = np.empty((len(feature), table.shape[1]), table.dtype)
    taken = np.empty((min(len(feature), 1024), table.shape[1]), table.dtype)
    columns = np.ascontiguousarray(feature.T)
    for a in range(0, len(feature), 1024):
        total = out[a:a + 1024]
        np.take(table, columns[0, a:a + 1024], axis=0, out=total, mode="clip")
        for column in columns[1:]:
            total += np.take(table, column[a:a + 1024], axis=0, out=taken[:len(total)], mode="clip")
    return out


def _each(batches: Iterator[pa.RecordBatch], column: int = 0, size: int = 1 << 20) -> Iterator[Blocks]:
    for batch in batches:
        for texts in sliced(batch.column(column), size):
            yield blocks(texts)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Half passages that hold a feature, and the number of half passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for b in _each(batches):
            held = np.sort(b.feature.astype(np.uint16), axis=1)
            new = np.ones(held.shape, bool)
            new[:, 1:] = held[:, 1:] != held[:, :-1]
            total += np.bincount(held[new & (held < FEATURES)], minlength=FEATURES + 1)
            total[FEATURES] += len(b.feature)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["f", "n"])

    got = map_arrow(texts, count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, np.int64)
    df[got.column("f").to_numpy()] = got.column("n").to_numpy()
    return df[:FEATURES], int(df[FEATURES])


def spread(feature: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the half passages in order, and the sum of the ``rows``
    of the half passages that hold each, as often as they hold it.

    The half passages of a feature are laid out in groups of HALF, padded
    with a zero row, so they are added up like words are in `half_sums`; so
    are the sums of the groups, until each feature has one.
    """
    flat = feature.astype(np.uint16).ravel()
    count = np.bincount(flat, minlength=FEATURES + 1)[:FEATURES]
    at = np.argsort(flat, kind="stable")[:count.sum()] // HALF  # padding comes last
    found = np.flatnonzero(count)
    count, out = count[found], np.empty((len(found), rows.shape[1]), rows.dtype)
    left = np.arange(len(found))  # features whose sum is not known yet
    while len(left):
        groups = -(-count // HALF)
        table = np.full(int(groups.sum()) * HALF, len(rows))
        pad = np.cumsum(groups * HALF - count) - (groups * HALF - count)
        table[np.arange(len(at)) + np.repeat(pad, count)] = at
        rows = half_sums(table.reshape(-1, HALF), np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]))
        one = groups == 1
        out[left[one]] = rows[(np.cumsum(groups) - 1)[one]]
        at = np.flatnonzero(np.repeat(~one, groups))
        left, count = left[~one], groups[~one]
    return found, out


def gram_times(texts: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over all passages, A = counts x weight; features x rank."""
    rank = basis.shape[1]
    names = [f"y{j}" for j in range(rank)]
    shared = texts.sparkSession.sparkContext.broadcast(
        np.vstack([basis * weight[:, None], np.zeros((1, rank))]).astype(np.float32))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, held = shared.value, np.zeros((FEATURES, rank)), []

        def add() -> None:
            found, sums = spread(np.concatenate([f for f, _ in held]), np.concatenate([x for _, x in held]))
            total[found] += sums
            held.clear()

        for b in _each(batches):
            if not len(b.feature):
                continue
            first, two = passages(b)
            z = pair_up(first, two, half_sums(b.feature, table))
            back = np.zeros((len(b.feature), rank), np.float32)  # each half passage gets those of its passages
            back[first] += z
            back[first[two] + 1] += z[two]
            held.append((b.feature, back))
            if sum(len(f) for f, _ in held) >= HELD:
                add()
        if held:
            add()
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), *(pa.array(total[at, j], pa.float64()) for j in range(rank))], names=["f", *names])

    got = (map_arrow(texts, multiply, "f int, " + ", ".join(f"{y} double" for y in names)).groupBy("f")
           .agg(*[F.sum(y).alias(y) for y in names]).toArrow())  # FEATURES rows at most
    out, at = np.zeros((FEATURES, rank)), got.column("f").to_numpy()
    for j, y in enumerate(names):
        out[at, j] = got.column(y).to_numpy()
    shared.unpersist()
    return out * weight[:, None]


@dataclass
class Space:
    weight: np.ndarray  # inverse document frequency of each feature
    table: np.ndarray  # feature -> whitened latent coordinates, a zero row for padding
    content: np.ndarray  # features rare enough for content words


def fit(texts: DataFrame, common: float, rank: int = RANK, seed: int = 7) -> Space:
    """Randomised SVD of all passages of ``texts`` (one string column)."""
    df, n = document_frequency(texts)
    weight = np.log((n + 1) / (df + 1)) + 0.0
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, rank)))[0]
    sketch = gram_times(texts, weight, start)
    basis = np.linalg.qr(sketch)[0]
    image = gram_times(texts, weight, basis)
    inner = basis.T @ image
    power, turn = np.linalg.eigh((inner + inner.T) / 2)
    keep = power > max(power.max(initial=0.0), 0.0) * 1e-9
    right = basis @ turn[:, keep] / np.sqrt(np.maximum(power[keep], 1e-300))
    table = np.vstack([right * weight[:, None], np.zeros((1, right.shape[1]))])
    scale = np.abs(table).max(initial=0.0) or 1.0
    return Space(weight, (table / scale).astype(np.float32), df <= common * max(n, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Sequence:
    """Longest common subsequence with one word list, a bit for each word."""

    def __init__(self, words: list[int]):
        self.size, self.mask = len(words), {}
        for i, w in enumerate(words):
            self.mask[w] = self.mask.get(w, 0) | (1 << i)

    def common(self, words: list[int]) -> int:
        full = (1 << self.size) - 1
        v = full
        for m in filter(None, map(self.mask.get, words)):
            u = v & m
            v = ((v + u) | (v - u)) & full
        return self.size - v.bit_count()


def run_hashes(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hash of the run of each size that starts at each word."""
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)])])
    return {k: (sums[k:] - sums[:-k]) * down[:len(words) - k + 1] for k in sizes if k <= len(words)}


class Runs:
    """Word runs of the items: which to look for, and what they tell.

    Items under LEAST_WORDS are one run.  Others have all runs of ``width``
    words, of which a stretch with the ``verbatim`` share keeps ``least``
    when words were dropped or replaced, and those of ``config.run`` words.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, config: Config):
        kept = np.ceil(config.verbatim * counts - 1e-9).astype(np.int64)
        parts = counts - kept + 1  # runs that the lost words leave
        short = counts < LEAST_WORDS
        self.width = np.where(short, counts, np.where(kept > 3 * parts, 4, 3))
        self.least = np.where(short, 1, np.maximum(1, kept - (self.width - 1) * parts))
        item = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
        self.index = {}
        for k, code in run_hashes(hashes, sorted({*self.width[counts > 0].tolist(), config.run})).items():
            at = np.flatnonzero((left >= k) & ((self.width[item] == k) | (~short[item] & (k == config.run))))
            pairs = np.unique(np.array([code[at], item[at].astype(np.uint64)]), axis=1)
            some = np.zeros(1 << 20, bool)
            some[pairs[0] >> np.uint64(44)] = True
            if len(at):
                self.index[k] = pairs[0], pairs[1].astype(np.int64), some

    def hits(self, words: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(run size, position, item); ``left``: words from a position to the end of its text."""
        for k, code in run_hashes(words, list(self.index)).items():
            key, item, some = self.index[k]
            at = np.flatnonzero(some[code >> np.uint64(44)])
            at = at[left[at] >= k]
            lo = np.searchsorted(key, code[at], "left")
            n = np.searchsorted(key, code[at], "right") - lo
            yield k, np.repeat(at, n), item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Items:
    """The benchmark items as queries."""

    def __init__(self, ids: list, texts: list[str], answers: list[str | None], space: Space, config: Config):
        b = blocks(texts)
        hashes, _ = word_hashes(texts)
        ends = np.cumsum(b.counts)
        self.ids, self.config, self.size = ids, config, b.counts
        lists = [hashes[e - n:e] for e, n in zip(ends, b.counts)]
        self.whole = [Sequence(x.tolist()) for x in lists]
        size = 2 * HALF
        self.parts = [[Sequence(x[a:a + size].tolist()) for a in sorted({*range(0, len(x) - size, HALF), len(x) - size})]
                      if len(x) > size else [] for x in lists]
        self.runs = Runs(hashes, b.counts, config)
        feature = [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in lists]
        self.content = [Sequence(x[space.content[f]].tolist()) for x, f in zip(lists, feature)]
        told = word_hashes([a or "" for a in answers])
        cut = np.cumsum(told[1])
        self.answer = [Sequence((told[0][e - n:e] if n else x[-config.answer_words:]).tolist())
                       for e, n, x in zip(cut, told[1], lists)]
        first, two = passages(b)
        latent = pair_up(first, two, half_sums(b.feature, space.table))
        long_enough = (b.counts >= LEAST_WORDS)[np.repeat(np.arange(len(texts)), b.per_text)[first]]
        self.of = np.repeat(np.arange(len(texts)), b.per_text)[first][long_enough]
        self.latent = unit(latent[long_enough])
        self.words = passage_words(b, first[long_enough], two[long_enough])

    def verdict(self, i: int, stretch: list[int], sure: bool = False) -> tuple[float, float, bool] | None:
        c = self.config
        whole = self.whole[i].common(stretch) / self.whole[i].size
        inner = self.content[i]
        content = inner.common(stretch) / inner.size if inner.size >= 4 else whole
        answer = self.answer[i].common(stretch) >= c.answer * self.answer[i].size
        if (sure or whole >= c.verbatim or (inner.size >= 4 and content >= c.paraphrase and answer)
                or any(p.common(stretch) >= c.verbatim * p.size for p in self.parts[i])):
            return whole, content, answer
        return None


def passage_words(b: Blocks, first: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(passages, 2 * HALF) word hashes; 0 where a passage is shorter."""
    out = np.zeros((len(first), 2 * HALF), np.uint64)
    out[:, :HALF] = b.words[first]
    out[two, HALF:] = b.words[first[two] + 1]
    return out


def candidates(b: Blocks, items: Items, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half passage, item, cosine) where a passage is near an item's
    passage and shares enough words with it."""
    first, two = passages(b)
    latent = unit(pair_up(first, two, half_sums(b.feature, table)))
    found = []
    for q in range(0, len(items.of), 512):
        for a in range(0, len(first), 1024):
            near = latent[a:a + 1024] @ items.latent[q:q + 512].T
            p, i = np.nonzero(near >= items.config.cosine)
            if len(p):
                found.append((a + p, q + i, near[p, i]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    p, i, near = (np.concatenate(x) for x in zip(*found))
    enough = np.zeros(len(p), bool)
    for a in range(0, len(p), 2048):
        at = p[a:a + 2048]
        mine, theirs = passage_words(b, first[at], two[at]), items.words[i[a:a + 2048]]
        real = theirs != 0
        shared = np.zeros(real.shape, bool)
        for word in mine.T:
            shared |= theirs == word[:, None]
        shared = (shared & real).sum(axis=1)
        enough[a:a + 2048] = shared >= items.config.shared * real.sum(axis=1)
    return first[p[enough]], items.of[i[enough]], near[enough]


def search(b: Blocks, items: Items, table: np.ndarray) -> list[tuple[int, int, float, float, float, bool]]:
    """(text, item, cosine, share of the item, of its content, answer found),
    the best stretch of each text and item; the cosine is nan where only the
    run index found it."""
    at, item, near = candidates(b, items, table)
    of = np.repeat(np.arange(len(b.per_text)), b.per_text)
    base = np.cumsum(b.per_text) - b.per_text
    flat = b.words.ravel()
    best: dict[tuple[int, int], tuple] = {}

    def judge(t: int, i: int, lo: int, hi: int, cosine: float, sure: bool = False) -> None:
        begin = int(base[t]) * HALF
        got = items.verdict(i, flat[max(begin, lo):min(begin + int(b.counts[t]), hi)].tolist(), sure)
        if got is not None:
            old = best.get((t, i), (cosine, -1.0))
            best[t, i] = (float(np.fmax(old[0], cosine)), *max(got, old[1:]))

    order = np.lexsort((at, item, of[at]))
    at, item, near = at[order], item[order], near[order]
    text = of[at]
    k = 0
    while k < len(at):
        end = k + 1  # neighbouring passages of one item make one stretch
        while end < len(at) and text[end] == text[k] and item[end] == item[k] and at[end] - at[end - 1] <= 3:
            end += 1
        t, i = int(text[k]), int(item[k])
        room = int(items.size[i])
        judge(t, i, int(at[k]) * HALF - room, (int(at[end - 1]) + 2) * HALF + room, float(near[k:end].max()))
        k = end
    left = np.repeat(base * HALF + b.counts, b.per_text * HALF) - np.arange(len(flat))
    for k, at, item in items.runs.hits(flat, left):
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        text, room = of[at // HALF], items.size[item]
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (np.diff(at) > room[1:])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(at))
        sure = (k == items.config.run) | (items.size[item[start]] < LEAST_WORDS)
        for x in np.flatnonzero(sure | (end - start >= items.runs.least[item[start]])):
            a, z = start[x], end[x] - 1
            judge(int(text[a]), int(item[a]), int(at[a] - room[a]), int(at[z] + k + room[a]), np.nan, bool(sure[x]))
    return [(t, i, *v) for (t, i), v in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text", answer: str | None = None, config: Config | None = None) -> DataFrame:
    """Rows (key, mark, item, cosine, overlap, content_overlap, answer_found)
    for every document and benchmark item that it gives away."""
    config = config or Config()
    spark = docs.sparkSession
    space = fit(docs.select(text_or_empty(text).alias("t")), config.common)
    asked = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("string").alias("t"),
                             (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a"))
    groups = max(1, -(-asked.count() // config.item_block))
    rows = docs.select(F.col(key).alias("key"), row_mark(text).alias("mark"), text_or_empty(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, mark long, item string, cosine double, overlap double, content_overlap double, "
              "answer_found boolean")
    out = None
    for g in range(groups):  # about item_block items at a time
        part = asked.filter(F.pmod(F.xxhash64("id", "t"), F.lit(groups)) == g).orderBy("id", "t").collect()
        shared = spark.sparkContext.broadcast(
            (Items([r.id for r in part], [r.t or "" for r in part], [r.a for r in part], space, config), space.table))
        found = map_arrow(rows, _finder(shared), schema)
        out = found if out is None else out.unionByName(found)
    named = out.join(benchmark.select(F.col(item).alias("_item"), F.col(item).cast("string").alias("item")).distinct(),
                     "item").drop("item")
    return named.select(F.col("key").alias(key), "mark", F.col("_item").alias(item), "cosine", "overlap",
                        "content_overlap", "answer_found")


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, table = shared.value
        for batch in batches:
            where, found, at = [], [], 0
            for texts in sliced(batch.column(2), 1 << 20):
                for t, *rest in search(blocks(texts), items, table):
                    where.append(at + t)
                    found.append(rest)
                at += len(texts)
            pick = pa.array(where, pa.int64())
            i, near, whole, content, answer = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick),
                 pa.array([items.ids[x] for x in i], pa.string()), pa.array(np.round(near, 4), pa.float64(), from_pandas=True),
                 pa.array(whole, pa.float64()), pa.array(content, pa.float64()), pa.array(answer, pa.bool_())],
                names=["key", "mark", "item", "cosine", "overlap", "content_overlap", "answer_found"])

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents that give no item away, with their own columns."""
    bad = matches(docs, benchmark, key, text, **more).select(F.col(key).alias("key"), "mark").distinct()
    return without_rows(docs, bad.withColumn("kept", F.lit(False)), key, text)
