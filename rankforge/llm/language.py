"""Language identification with spans.

Letters are read as character trigrams inside their word; counts over all
training rows give every trigram a log probability for each language.  The
script of a word (by code point ranges) narrows the languages to those whose
training text uses that script; the word's score is the sum of its trigrams'
log probabilities, centred and clipped.  A Viterbi pass over the words of a
text, with a penalty for every change of language, labels runs of words, so
a text of several languages comes back as spans.

The predicted language covers the most letters; the score is its share of
the letters.  Texts that are null or hold no letter get `und`, score 0 and no
spans.  Ties go to the language that sorts first.  If no training language
uses a word's script, all languages stay possible for it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, by_bytes, fresh, map_arrow, mix64, sliced

UNKNOWN = "und"
_BITS = 16

#: First code points of blocks and their scripts (fixed values).
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"),
    (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"),
    (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """0 for code points that are no letters (or marks), else 1 + script."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            kind[c] = 1
    starts = np.array([a for a, _ in SCRIPT_STARTS])
    script = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS], np.uint8)
    at = np.flatnonzero(kind)
    kind[at] = 1 + script[np.searchsorted(starts, at, side="right") - 1]
    return kind


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Code points of category L."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def _lowered(text: str) -> str:
    """Lower case, character by character where offsets would move else."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


@dataclass
class Words:
    """Words of some texts; ``feature`` has one entry a letter, ``first`` and
    ``size`` place the words in it, ``start`` is the place in the text."""

    feature: np.ndarray
    first: np.ndarray
    size: np.ndarray
    script: np.ndarray
    start: np.ndarray
    counts: np.ndarray


def _runs(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff((which > 0).view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(texts: list[str]) -> Words:
    kind = _letters()
    low = [_lowered(t) for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le") + b"\n\0\0\0", np.uint32)
    which = kind[code]
    begin, end = _runs(which)
    # marks extend a word but make none: a word holds a letter
    letters = np.concatenate([[0], np.cumsum(_is_letter()[code])])
    bare_marks = letters[end] == letters[begin]
    if bare_marks.any():
        for a, b in zip(begin[bare_marks], end[bare_marks]):
            which[a:b] = 0
        begin, end = _runs(which)
    inside = which > 0
    bare = np.where(which > 0, code, 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    before = np.where(at > 0, bare[at - 1], 0)
    tri = (before << np.uint64(42)) | (bare[at] << np.uint64(21)) | bare[at + 1]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    counts = np.diff(np.searchsorted(begin, bounds))
    first = np.concatenate([[0], np.cumsum(end - begin)[:-1]]).astype(np.int64) if len(begin) else begin
    return Words((mix64(tri) >> np.uint64(64 - _BITS)).astype(np.int32), first, end - begin, which[begin] - 1,
                 begin - np.repeat(bounds[:-1], counts), counts)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # trigram feature x language: log probability
    allowed: np.ndarray  # script x language


def fit(df: DataFrame, text: str = "text", lang: str = "lang", most: int = 200, rare: float = 0.01) -> Model:
    """Count trigrams and scripts of all rows with a language.

    A task returns one small count vector a language it saw; the model is
    2**16 features x languages.  More than ``most`` languages are refused.
    """
    size = 1 << _BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = (batch.column(i).to_pylist() for i in (0, 1))
            for a, b in by_bytes(texts, 1 << 20):
                for name in sorted(set(names[a:b])):
                    w = words([t for t, n in zip(texts[a:b], names[a:b]) if n == name])
                    got = seen.setdefault(name, np.zeros(size + len(SCRIPTS), np.int64))
                    got[:size] += np.bincount(w.feature, minlength=size)
                    got[size:] += np.bincount(w.script, weights=w.size, minlength=len(SCRIPTS)).astype(np.int64)
        for name, got in seen.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(got[at], pa.int64())], names=["lang", "feature", "n"])

    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    langs = sorted(r.l for r in rows.select("l").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"more than {most} languages")
    totals = map_arrow(rows, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = np.zeros((size + len(SCRIPTS), len(langs)))
    got = totals.toArrow()  # at most languages x (2**16 + scripts) rows
    if got.num_rows:
        which = pc.index_in(got.column("lang"), pa.array(langs, pa.string()))
        counts[got.column("feature").to_numpy(), which.to_numpy()] = got.column("n").to_numpy()
    grams, scripts = counts[:size] + 0.5, counts[size:]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), share >= rare)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word of every text, all texts at once.

    Words are put in order of their place in the text, so one step advances
    every text that is still long enough.  A state is entered from itself or
    from the best state minus the penalty.
    """
    n, states = scores.shape
    if n == 0 or states == 1:
        return np.zeros(n, np.int64)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    by_step = np.argsort(place * len(counts) + np.repeat(rank, counts))
    width = np.bincount(place)
    offset = np.concatenate([[0], np.cumsum(width)])
    s = scores[by_step]
    back = np.empty((n, states), np.int16 if states > 127 else np.int8)
    best = s[: width[0]].astype(np.float64)
    ids = np.arange(states, dtype=back.dtype)
    for t in range(1, len(width)):
        k, a = width[t], offset[t]
        now = best[:k]
        top = now.argmax(axis=1)
        jump = now[np.arange(k), top][:, None] - penalty
        stay = now >= jump
        back[a:a + k] = np.where(stay, ids, top[:, None].astype(back.dtype))
        best[:k] = np.where(stay, now, jump) + s[a:a + k]
    label = np.empty(n, np.int64)
    state = best.argmax(axis=1)
    for t in range(len(width) - 1, -1, -1):
        k, a = width[t], offset[t]
        label[a:a + k] = state[:k]
        if t:
            state[:k] = back[a + np.arange(k), state[:k]]
    out = np.empty(n, np.int64)
    out[by_step] = label
    return out


def word_scores(w: Words, model: Model, clip: float) -> np.ndarray:
    if not len(w.first):
        return np.zeros((0, len(model.langs)), np.float32)
    raw = np.add.reduceat(model.table[w.feature], w.first, axis=0)
    ok = model.allowed[w.script]
    ok |= ~ok.any(axis=1, keepdims=True)
    raw -= np.where(ok, raw, -np.inf).max(axis=1, keepdims=True)
    return np.where(ok, np.maximum(raw, -clip), -2 * clip).astype(np.float32)


def label(text: Column, model: Model, penalty: float = 10.0, clip: float = 8.0) -> Column:
    """struct(lang_pred, score, spans): spans are array<struct<lang, start,
    stop>> in code points, from the first letter of a run to behind its last."""
    kind = "lang_pred string, score double, spans array<struct<lang:string,start:int,stop:int>>"
    if not model.langs:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                        F.array().cast("array<struct<lang:string,start:int,stop:int>>").alias("spans"))

    @arrow(kind)
    def lang(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch, 1 << 23):
                preds, scores, owned, names, starts, stops = _label([t or "" for t in texts], model, penalty, clip)
                ends = np.concatenate([[0], np.cumsum(owned)]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int32()),
                                                    pa.array(stops, pa.int32())], names=["lang", "start", "stop"])
                yield pa.StructArray.from_arrays(
                    [pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                     pa.ListArray.from_arrays(pa.array(ends), spans)], names=["lang_pred", "score", "spans"])

    return lang(text.cast("string"))


def _label(texts: list[str], model: Model, penalty: float, clip: float) -> tuple:
    """Predictions, scores, spans per text, and the spans' columns."""
    parts = []
    for a, b in by_bytes(texts, 1 << 20):
        w = words(texts[a:b])
        parts.append((word_scores(w, model, clip), w.counts, w.start, w.size))
    scores, counts, start, size = (np.concatenate(x) for x in zip(*parts))
    state = viterbi(scores, counts, penalty)
    n, k = len(texts), len(model.langs)
    owner = np.repeat(np.arange(n), counts)
    letters = np.bincount(owner * k + state, weights=size, minlength=n * k).reshape(n, k)
    total = letters.sum(axis=1)
    top = letters.argmax(axis=1)
    preds = [model.langs[i] if z else UNKNOWN for i, z in zip(top, total)]
    score = (letters[np.arange(n), top] / np.maximum(total, 1)).tolist()
    new = np.flatnonzero(np.diff(owner * k + state, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(owner)) - 1 if len(new) else new
    return (preds, score, np.bincount(owner[new], minlength=n), [model.langs[i] for i in state[new]],
            start[new].tolist(), (start[last] + size[last]).tolist())


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(F.col(key), label(F.col(text), model).alias("_l")).select(key, "_l.lang_pred", "_l.score", "_l.spans")


def spoken(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows in some language, with their own columns.  A model without
    languages rejects only what has no letter."""
    if not model.langs:
        return df.filter(F.col(text).cast("string").rlike(r"\p{L}"))
    verdict = fresh(df.columns, "_lang")
    return df.withColumn(verdict, label(F.col(text), model)).filter(F.col(verdict)["lang_pred"] != UNKNOWN).select(*df.columns)
