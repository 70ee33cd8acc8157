"""Token counts: batch encoding in Arrow functions that return lengths only.

Spark's file splits already balance the tasks by bytes.  Inside a task the
texts are cut at safe boundaries into pieces and regrouped into batches of
about ``batch_chars`` characters, so neither one huge text nor ten thousand
long rows decide the memory of a task; only the lengths travel back.
Distinct runs of a batch are encoded once; a bounded table remembers the
lengths of short runs across batches.

Null and empty texts have 0 tokens.  Repeated rows are counted row by row;
other columns pass through untouched.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, arrow, by_bytes, pieces, sliced, text_or_empty


@lru_cache(maxsize=4)
def _library(path: str):
    """(function: list of texts -> list of lengths, special strings, whether
    the lengths of runs add up to that of the text)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        import json

        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        added = tuple(a["content"] for a in spec.get("added_tokens", ()))
        plain = plain and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word")
                                  or any(c.isspace() for c in a["content"])
                                  for a in spec.get("added_tokens", ()))

        def lengths(texts: list[str]) -> list[int]:
            return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return lengths, added, plain
    if path.endswith(".model"):
        import sentencepiece as sp
        proc = sp.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in proc.encode(texts, num_threads=1)]), (), False
    raise ValueError(f"no tokenizer library for {path}")


class _Counter:
    """Counts of one worker; ``limit`` bounds the remembered runs."""

    def __init__(self, path: str, limit: int = 400_000, longest: int = 48):
        self.lengths, self.special, self.plain = _library(path)
        self.known: dict[str, int] = {}
        self.limit, self.longest = limit, longest

    def segments(self, text: str) -> list[str]:
        """The text cut around special strings (which count by themselves)."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for i, y in enumerate(p.split(s)) for x in ((s, y) if i else (y,))]
        return parts

    def count(self, texts: list[str], batch_chars: int, piece_chars: int) -> list[int]:
        out = [0] * len(texts)
        if not self.plain:  # lengths of parts need not add up: whole texts, batched by bytes
            for a, b in by_bytes(texts, batch_chars):
                out[a:b] = self.lengths(texts[a:b])
            return out
        owner, parts = [], []
        for i, t in enumerate(texts):
            for s in self.segments(t):
                for p in pieces(s, piece_chars):
                    owner.append(i)
                    parts.append(p)
        for a, b in by_bytes(parts, batch_chars):
            runs = [CHUNK.findall(p) for p in parts[a:b]]
            distinct = set().union(*runs)
            new = list(distinct.difference(self.known))
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = list(distinct)
            self.known.update(zip(new, self.lengths(new)))
            get = self.known.__getitem__
            for i, one in zip(owner[a:b], runs):
                out[i] += sum(map(get, one))
            for r in new:
                if len(r) > self.longest:
                    del self.known[r]
        return out


def count_tokens(text: Column, path: str, batch_chars: int = 1 << 20,
                 piece_chars: int = 1 << 16) -> Column:
    """Number of tokens of ``text`` under the tokenizer file at ``path``
    (0 for null)."""

    @arrow("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _Counter(path)
        for batch in batches:
            for texts in sliced(batch, 4 * batch_chars):
                yield pa.array(counter.count(texts, batch_chars, piece_chars), pa.int64())

    return lengths(F.coalesce(text.cast("string"), F.lit("")))


def token_report(df: DataFrame, path: str, limit: int, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    return (df.select(*keep, F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
                      count_tokens(F.col(text), path).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
