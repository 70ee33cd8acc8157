"""BPE codec and token counts against the tokenizer library."""
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankforge.llm import bpe, token_counts
from rankforge.llm.common import pieces, table

from .edges import ROWS, documents

PATH = P.path("byte_bpe_50k.json")
HARD = ["", "a", "  ", "\n\n <|endoftext|>\n\n b", "x<|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaa" * 9,
        "日本語テキスト 你好。", "😀😀 ok'll we've", "  x   y", " " * 50 + "z", "\x1c\x1d a", "tab\tq\r\n", "don't DON'T 12 ½²",
        "é" * 300, "-" * 500 + "=="*77, "a" * 5000, "ab" * 3000, "　x", "\x85 x", "0" * 100, "<|endoftext", "İı ſ K"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def hard_texts():
    rng = random.Random(3)
    signs = "ab \n\t'sé1.-_<|>日  "
    out = HARD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    parts = [t.decode("utf8", "ignore") for t in bpe.load(PATH).token]
    return out + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(500)]


def test_all_tokens_encode_to_themselves():
    assert bpe.load(PATH).sound.sum() == 50256


def test_compatible_borders_equal_exact_merging():
    b, rng = bpe.load(PATH), random.Random(5)
    import numpy as np
    pairs = np.array([(rng.randrange(50256), rng.randrange(50256)) for _ in range(3000)])
    ok = b.compatible(pairs[:, 0], pairs[:, 1])
    exact = [b.merge(b.token[x] + b.token[y]) == [x, y] for x, y in pairs]
    assert ok.tolist() == exact


def test_encode_and_decode_equal_the_library(spark, library):
    texts = hard_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    rows = df.select("i", bpe.encode(F.col("text"), PATH).alias("ids")).select(
        "i", "ids", bpe.decode(F.col("ids"), PATH).alias("back")).collect()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    both = df.select("i", bpe.round_trip(F.col("text"), PATH).alias("c")).collect()
    assert all(r.c.ids == want[r.i] and r.c.back == texts[r.i] for r in both)
    for r in rows:
        assert r.ids == want[r.i], texts[r.i]
        assert r.back == library.decode(want[r.i], skip_special_tokens=False) == texts[r.i]


def test_decode_of_broken_sequences(spark):
    b = bpe.load(PATH)
    lone = b.byte_id[0xC3]
    df = spark.createDataFrame([([lone, b.byte_id[65]],), ([],), (None,), ([10**6, b.byte_id[66]],)], "ids array<int>")
    assert [r[0] for r in df.select(bpe.decode(F.col("ids"), PATH)).collect()] == ["�A", "", None, "B"]


def test_counts_equal_the_library(spark, library):
    texts = [*hard_texts(), *[r[1] for r in ROWS]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in token_counts.token_report(df, PATH, 3).collect()}
    want = [len(e) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i].over_limit == (want[i] > 3) for i in got)


def test_small_batches_and_pieces_do_not_change_counts(library):
    texts = [t for t in hard_texts()]
    counter = token_counts._Counter(PATH, limit=50)
    assert counter.count(texts, 100, 20) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert "".join(pieces("ab cd  ef\n" * 50, 7)) == "ab cd  ef\n" * 50
    assert pieces("x" * 100, 7) == ["x" * 100]


def test_sentencepiece_model_counts(spark):
    import sentencepiece as sp
    path = P.path("piece_bpe_32k.model")
    texts = ["", "Hello  world", "über straße", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_report(df, path, 10).collect()}
    proc = sp.SentencePieceProcessor(model_file=path)
    assert [got[i] for i in range(4)] == [len(proc.encode(t)) for t in texts]


def test_empty_tables_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert token_counts.token_report(empty, PATH, 1).count() == 0
    assert empty.select(bpe.encode(F.col("text"), PATH)).count() == 0
    assert documents(spark, clash=True).select("row", bpe.encode(F.col("text"), PATH)).count() == len(ROWS)


def test_whole_sample_round_trip(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("text", bpe.encode(F.col("text"), PATH).alias("ids")).collect()
    want = [e.ids for e in library.encode_batch([r.text for r in rows], add_special_tokens=False)]
    assert [r.ids for r in rows] == want
