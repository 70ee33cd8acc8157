"""Byte-level BPE by speculation and verification.

A tokenisation made of tokens that each encode to themselves is the BPE
result exactly if no merge would ever have crossed one of its borders, and
that can be decided border by border.  So words are first tiled by greedy
longest match, every adjacent pair is then checked at once with numpy, and
only words with a failing border go through exact merging.

A border between tokens a and b is checked by undoing merges, latest first:
while both current neighbours exist, a merge of the two would have happened
if it ranks before the merge that used up the left one and not after the one
that used up the right one (of equal merges the left goes first).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import CHUNK, arrow, sliced

#: The word pattern of the byte-level pre-tokenizer (fixed value).
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

_NEVER = 1 << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes stand for themselves, the rest are numbered from
    U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """Vocabulary tables; ``encode_words`` and ``decode`` do the work."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" \
                or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.to_alphabet = {b: c for b, c in enumerate(alphabet)}
        back = {c: b for b, c in enumerate(alphabet)}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.size = n
        self.token = [b""] * n
        for t, i in vocab.items():
            self.token[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode("utf-8")
        self.byte_id = [vocab[c] for c in alphabet]
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.full(n, -1, np.int64)  # rank of the merge that makes a token; -1: a byte
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if not isinstance(m, str) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if pair in self.rank:
                continue
            self.rank[pair] = (r, whole)
            if self.made[whole] < 0:
                self.left[whole], self.right[whole], self.made[whole] = *pair, r
        keys = np.array([a * n + b for a, b in self.rank], np.int64)
        ranks = np.array([r for r, _ in self.rank.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.whole = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)  # what the merge of a rank makes
        for r, made in self.rank.values():
            self.whole[r] = made
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        made = np.flatnonzero(self.made >= 0)
        self.sound = np.zeros(n, bool)
        self.sound[self.byte_id] = True
        inner = self.compatible(self.left[made], self.right[made], joined=self.made[made])
        for i, ok in sorted(zip(made, inner), key=lambda x: self.made[x[0]]):
            self.sound[i] = ok and self.sound[self.left[i]] and self.sound[self.right[i]]
        self._spelled = vocab

    @cached_property
    def trie(self) -> ahocorasick.Automaton:
        trie = ahocorasick.Automaton()
        for t, i in self._spelled.items():
            if self.sound[i]:
                trie.add_word(t, i)
        trie.make_automaton()
        return trie

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, joined: np.ndarray | None = None) -> np.ndarray:
        """Whether a border between tokens a and b survives all merges; with
        ``joined``, whether it survives until the merge of that rank."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        until_a = np.full(len(a), _NEVER) if joined is None else joined.astype(np.int64)
        until_b = until_a.copy()
        live = np.arange(len(a))
        while len(live):
            x, y, ua, ub = a[live], b[live], until_a[live], until_b[live]
            r = self.pair_rank(x, y)
            bad = (r < ua) & (r <= ub) & (r < _NEVER)
            if joined is not None:
                bad &= r < joined[live]
            ok[live[bad]] = False
            ma, mb = self.made[x], self.made[y]
            go = ~bad & ((ma >= 0) | (mb >= 0))
            undo_a = go & (ma > mb)
            undo_b = go & ~undo_a
            a[live[undo_a]], until_a[live[undo_a]] = self.right[x[undo_a]], ma[undo_a]
            b[live[undo_b]], until_b[live[undo_b]] = self.left[y[undo_b]], mb[undo_b]
            live = live[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: the lowest-ranked pair merges first, the
        leftmost among equals.  A heap keeps long words near linear."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.rank[pair][1]
            gone[j] = 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (p := (ids[k], ids[m])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, p))
        return [t for t, g in zip(ids, gone) if not g]

    def merge_many(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words of at most ``width`` bytes at once: one
        merge a word and step, on a matrix of ids and one of pair ranks.
        (ids, left-aligned, and how many each word has)"""
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = np.array(self.byte_id, np.int64)[raw]
        columns = np.arange(width)
        ranks = np.full((n, width), _NEVER)
        inner = columns[None, 1:] < size[:, None]
        ranks[:, :-1][inner] = self.pair_rank(ids[:, :-1][inner], ids[:, 1:][inner])
        live = np.arange(n)
        while len(live):
            r = ranks[live]
            at = r.argmin(axis=1)
            low = r[np.arange(len(live)), at]
            go = low < _NEVER
            live, at, low = live[go], at[go], low[go]
            if not len(live):
                break
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            x = np.take_along_axis(ids[live], shift, axis=1)
            x[np.arange(len(live)), at] = self.whole[low]
            k = np.take_along_axis(ranks[live], np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
            k[:, -1] = _NEVER
            size[live] -= 1
            row = np.flatnonzero(at > 0)
            k[row, at[row] - 1] = self.pair_rank(x[row, at[row] - 1], x[row, at[row]])
            row = np.flatnonzero(at + 1 < size[live])
            k[row, at[row]] = self.pair_rank(x[row, at[row]], x[row, at[row] + 1])
            row = np.flatnonzero(at + 1 >= size[live])
            k[row, at[row]] = _NEVER
            ids[live], ranks[live] = x, k
        return ids, size

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words, the word of each token,
        and which words the proposal covers completely."""
        text = "\n".join([w.decode("latin-1").translate(self.to_alphabet) for w in words])
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        found = np.array([x for m in self.trie.iter_long(text) for x in m], np.int64).reshape(-1, 2)
        end, ids = found[:, 0], found[:, 1]
        of = np.searchsorted(start, end, side="right") - 1
        covered = np.bincount(of, weights=self.sizes[ids], minlength=len(words)) == size
        return ids, of, covered

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, of, good = self.speculate(words)
        near = np.flatnonzero(of[1:] == of[:-1])
        keys, where = np.unique(ids[near] * self.size + ids[near + 1], return_inverse=True)
        bad = ~self.compatible(keys // self.size, keys % self.size)[where]
        good[of[near[bad]]] = False
        keep = good[of]
        sizes = np.bincount(of[keep], minlength=len(words))
        failed = np.flatnonzero(~good)
        exact, width = [], np.array([len(words[i]) for i in failed])
        for lo, hi in ((0, 8), (8, 16), (16, 32)):
            some = failed[(width > lo) & (width <= hi)]
            for a in range(0, len(some), 1 << 14):
                exact.append((some[a:a + (1 << 14)], *self.merge_many([words[i] for i in some[a:a + (1 << 14)]], hi)))
        for i in failed[width > 32]:
            one = np.array([self.merge(words[i])], np.int64)
            exact.append((np.array([i]), one, np.array([one.shape[1]])))
        for rows, _, size in exact:
            sizes[rows] = size
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        out[np.repeat(good, sizes)] = ids[keep]
        for rows, found, size in exact:
            real = np.arange(found.shape[1]) < size[:, None]
            out[(start[rows][:, None] + np.arange(found.shape[1]))[real]] = found[real]
        return out, sizes

    def decode(self, ids) -> str:
        if ids and (min(ids) < 0 or max(ids) >= self.size):
            ids = [i for i in ids if 0 <= i < self.size]
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


    def decode_many(self, ids: np.ndarray, sizes: list[int | None]) -> list[str | None]:
        """Texts of id lists in a row; Python numbers of one text at a time."""
        out, at = [], 0
        for n in sizes:
            out.append(None if n is None else self.decode(ids[at:at + n].tolist()))
            at += n or 0
        return out


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class Lists:
    """Id lists by number, kept in one growing buffer."""

    def __init__(self) -> None:
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append lists; the number of the first."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[self.n:self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n:self.n + len(sizes)] = sizes
        self.used += len(ids)
        self.n += len(sizes)
        return self.n - len(sizes)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists with these numbers in a row, and their sizes."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[numbers] - (ends - size), size)
        return self.ids[at], size


class Encoder:
    """Encodes whole texts; remembers up to ``limit`` runs and their words."""

    def __init__(self, path: str, limit: int = 200_000, longest: int = 48):
        self.bpe, self.limit, self.longest = load(path), limit, longest
        self.forget()

    def forget(self) -> None:
        self.lists = Lists()
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        for s, i in self.bpe.special.items():
            self.known[s] = self.lists.add(np.array([i], np.int32), np.ones(1, np.int64))

    def runs(self, text: str) -> list[str]:
        parts = [text]
        for s in self.bpe.special:
            if s in text:
                parts = [x for p in parts for i, y in enumerate(p.split(s)) for x in ((s, y) if i else (y,))]
        if len(parts) == 1:
            return CHUNK.findall(text)
        return [r for p in parts for r in ([p] if p in self.bpe.special else CHUNK.findall(p))]

    def _learn(self, new: list[str]) -> None:
        fresh: list[str] = []
        first, made = self.lists.n, []
        for r in new:
            simple = r.isalpha() or (r[0] == " " and r[1:].isalpha())
            at = (r,) if simple else WORD.findall(r)
            for w in at:
                if w not in self.words:
                    self.words[w] = first + len(fresh)
                    fresh.append(w)
            if len(at) == 1:
                self.known[r] = self.words[at[0]]
            else:
                made.append((r, [self.words[w] for w in at]))
        self.lists.add(*self.bpe.encode_words([w.encode("utf-8") for w in fresh]))
        if made:
            ids, sizes = self.lists.get(np.array([w for _, at in made for w in at], np.int64))
            width = np.array([len(at) for _, at in made])
            number = self.lists.add(ids, np.add.reduceat(sizes, np.cumsum(width) - width))
            self.known.update((r, number + i) for i, (r, _) in enumerate(made))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        runs = [self.runs(t) for t in texts]
        distinct = set().union(*runs)
        new = [r for r in distinct if r not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.forget()
            new = [r for r in distinct if r not in self.known]
        self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(runs)), np.int64)
        ids, sizes = self.lists.get(number)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, runs)])]
        for r in new:
            if len(r) > self.longest:
                self.known.pop(r, None)
                self.words.pop(r, None)
        return ids, np.diff(ends)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))


def encode(text: Column, path: str) -> Column:
    """Token ids (array<int>) of ``text``; null and empty give an empty array.

    Equal to the library's encoding without added begin or end tokens;
    special strings inside the text become their own ids."""

    @arrow("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for batch in batches:
            for texts in sliced(batch, 1 << 20):
                yield _lists(*encoder.encode(texts))

    return ids(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Text of an id array: token bytes joined, read as UTF-8, bad sequences
    replaced by U+FFFD.  Null gives null, an empty array the empty text;
    unknown ids stand for nothing."""

    @arrow("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            yield pa.array(bpe.decode_many(batch.flatten().to_numpy(zero_copy_only=False),
                                           batch.value_lengths().to_pylist()), pa.string())

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct(ids, back): the encoding of ``text`` and the text decoded from
    those ids, in one pass of one worker."""

    @arrow("ids array<int>, back string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for batch in batches:
            for texts in sliced(batch, 1 << 20):
                ids, sizes = encoder.encode(texts)
                back = encoder.bpe.decode_many(ids, sizes.tolist())
                yield pa.StructArray.from_arrays([_lists(ids, sizes), pa.array(back, pa.string())], names=["ids", "back"])

    return both(F.coalesce(text.cast("string"), F.lit("")))
