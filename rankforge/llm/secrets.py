"""Secret scans: fixed rules plus character Markov models.

Three rules give the base spans (assignments, access keys, hexadecimal
runs).  Beyond them, every other token of at least ``shortest`` characters is
scored by two character Markov models, one of random strings and one of
ordinary identifiers: the mean log-likelihood ratio of its transitions.  The
models are trained on labelled samples, the values that the rules found
against the words of the corpus, as transition counts over all texts; a
task returns its count tables only.  A token above the threshold becomes a
`markov` span.

Null and empty texts have no spans.  Repeated rows are scanned row by row.
If either model has no sample, no markov span is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, map_arrow, sliced

KINDS = ("assign", "access", "hex", "markov")

#: The rules (fixed values): pattern, group whose length counts, least length.
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # shorter runs fail anyway
}
#: A text without any of a rule's words cannot match it.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]{3,}")

#: Characters of a token by class number; 0 is the border of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)


@dataclass
class Model:
    """Log-likelihood ratio (random over ordinary) of every transition."""

    ratio: np.ndarray
    threshold: float = 1.0
    shortest: int = 16


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) in code points, kind by kind."""
    found, low = [], text.lower()
    for kind, (rule, group, least) in RULES.items():
        if kind == "hex" or (any(w in low for w in _ASSIGN_WORDS) if kind == "assign" else "AKIA" in text):
            found += [(kind, m.start(), m.end(), m.start(group)) for m in rule.finditer(text)
                      if m.end(group) - m.start(group) >= least]
    return found


def transitions(tokens: list[str]) -> np.ndarray:
    """Counts of character transitions of all tokens, borders included."""
    if not tokens:
        return np.zeros((STATES, STATES), np.int64)
    c = _CLASS[np.frombuffer((" " + " ".join(tokens) + " ").encode("latin-1"), np.uint8)].astype(np.int64)
    return np.bincount(c[:-1] * STATES + c[1:], minlength=STATES * STATES).reshape(STATES, STATES)


@lru_cache(maxsize=8)
def token_pattern(shortest: int) -> re.Pattern:
    return re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % shortest)


def free_tokens(text: str, spans: list[tuple[str, int, int, int]], shortest: int) -> list[tuple[int, int]]:
    """Tokens that no base span touches and that are long enough."""
    taken = sorted((a, b) for _, a, b, _ in spans)
    out, k = [], 0
    for m in token_pattern(shortest).finditer(text):
        a, b = m.span()
        if m.group().isdigit():  # plain numbers are no secrets
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        out.append((a, b))
    return out


def fit(df: DataFrame, text: str = "text", threshold: float = 1.0, shortest: int = 16, smooth: float = 0.5,
        backoff: float = 20.0) -> Model:
    """Train both models on all texts: values of base spans against words
    outside them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES, STATES), np.int64)
        for batch in batches:
            for t in (t for part in sliced(batch.column(0), 1 << 21) for t in part):
                spans = base_spans(t)
                total[0] += transitions([t[v:b].encode("ascii", "ignore").decode() for _, _, b, v in spans])
                at, plain = 0, []
                for a, b in sorted((a, b) for _, a, b, _ in spans):
                    plain.append(t[at:max(a, at)])
                    at = max(at, b)
                plain.append(t[at:])
                total[1] += transitions([w for p in plain for w in _WORD.findall(p)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], names=["k", "n"])

    texts = df.select(F.col(text).cast("string").alias("t")).filter("t is not null")
    got = (map_arrow(texts, count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas())  # 2 * STATES ** 2 rows
    n = np.zeros(2 * STATES * STATES)
    n[got["k"].to_numpy(int)] = got["n"]
    n = n.reshape(2, STATES, STATES)
    if not n.sum(axis=(1, 2)).all():
        return Model(np.full((STATES, STATES), -1.0), threshold, shortest)
    # a transition backs off to how common its second character is
    single = n.sum(axis=1, keepdims=True) + smooth
    single /= single.sum(axis=2, keepdims=True)
    p = np.log((n + backoff * single) / (n.sum(axis=2, keepdims=True) + backoff))
    return Model(p[0] - p[1], threshold, shortest)


def scores(tokens: list[str], model: Model) -> np.ndarray:
    """Mean log-likelihood ratio a transition."""
    if not tokens:
        return np.zeros(0)
    c = _CLASS[np.frombuffer((" ".join(tokens) + " ").encode("latin-1"), np.uint8)].astype(np.int64)
    step = model.ratio[np.concatenate([[0], c[:-1]]), c]
    size = np.array([len(t) + 1 for t in tokens])
    return np.add.reduceat(step, np.cumsum(size) - size) / size


def scan(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """All spans of every text, by start, then kind as listed."""
    base = [base_spans(t) for t in texts]
    free = [free_tokens(t, s, model.shortest) for t, s in zip(texts, base)]
    score = scores([t[a:b] for t, f in zip(texts, free) for a, b in f], model)
    out, k = [], 0
    for spans, more in zip(base, free):
        good = [("markov", a, b) for (a, b), s in zip(more, score[k:k + len(more)]) if s > model.threshold]
        k += len(more)
        out.append(sorted([(n, a, b) for n, a, b, _ in spans] + good, key=lambda x: (x[1], KINDS.index(x[0]))))
    return out


def find(text: Column, model: Model) -> Column:
    """array<struct<kind, start, stop>> in code points (empty for null)."""

    @arrow("array<struct<kind:string,start:int,stop:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch, 1 << 21):
                found = scan([t or "" for t in texts], model)
                flat = [s for f in found for s in f]
                kinds, starts, stops = zip(*flat) if flat else ((), (), ())
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                    names=["kind", "start", "stop"]))

    return spans(text.cast("string"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [kind]; overlapping spans merge
    under the kind of the first."""

    @arrow("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, f in zip(texts.to_pylist(), found.to_pylist()):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in f or []:
                if s["start"] >= at:
                    parts += [t[at:s["start"]], f"[{s['kind']}]"]
                at = max(at, s["stop"])
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return cut(text.cast("string"), spans)
