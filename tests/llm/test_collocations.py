import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import collocations
from rankforge.llm.common import gives_back, table

from .edges import CLASH, SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    grams, sizes = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        c = grams.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                c.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return grams, sizes


def brute(rows, least, top):
    grams, sizes = counted(rows)
    out = set()
    for lang, c in grams.items():
        f = {g: a for g, a in c.items() if a >= least}
        inside = {}
        for g, a in f.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    inside[g[i:i + s]] = max(a, inside.get(g[i:i + s], 0))
        found = []
        for g, a in f.items():
            if len(g) < 2 or 100 * inside.get(g, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, sizes[lang], -s))
    return out


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)


def random_rows(seed, n=120):
    r = random.Random(seed)
    words = ["A", "b", "New", "york", "city", "é", "the", "x-y", " z"]
    return [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", ", "]) for _ in range(r.randrange(40))),
             r.choice(["en", "en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    got = {tuple(r) for r in collocations.collocations(texts(spark, rows), least=6, top=15).collect()}
    assert got == brute(rows, 6, 15)


@pytest.mark.parametrize(("share", "passes"), [(0.0, range(2, 4)), (0.3, range(4)), (1.0, range(1))])
def test_failures_of_the_sample_are_repaired(spark, share, passes):
    rows = random_rows(3)
    counts, more = collocations.phrase_counts(texts(spark, rows), least=5, share=share)
    grams, sizes = counted(rows)
    got = sorted((r.lang, sum(x != 0 for x in r[1:5]), r.n) for r in counts.collect())
    assert got == sorted([(lang, len(g), a) for lang, c in grams.items() for g, a in c.items() if a >= 5] + [(k, 0, n) for k, n in sizes.items()])
    assert more in passes


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations.Filter, "has", lambda self, names: np.ones(len(names), bool))
    rows = random_rows(4)
    assert {tuple(r) for r in collocations.collocations(texts(spark, rows), least=6, top=50).collect()} == brute(rows, 6, 50)


def test_long_text_is_cut_between_words(monkeypatch):
    text = (" ".join(f"w{i % 7}" for i in range(500)) + ". ").encode() * 3 + b"y" * 300
    whole = collocations.words(text)
    monkeypatch.setattr(collocations, "SEGMENT", 64)
    for a, b in zip(whole, collocations.words(text)):
        assert (a == b).all()
    assert len(collocations.words(b"")[0]) == 0


def test_edge_rows_clashes_and_empty_table(spark):
    rows = [(t, lang) for _, t, lang, _, _ in documents(spark).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    df = documents(spark, clash=True).withColumnRenamed(CLASH[0], "w1")
    assert {tuple(r) for r in collocations.collocations(df, least=30, top=2000).collect()} == brute(rows, 30, 2000)
    assert collocations.collocations(documents(spark, rows=[])).collect() == []


def test_ties_are_cut_by_spelling(spark):
    rows = [(f"{a}1 {a}2. ", "en") for a in "dbca" for _ in range(3)]
    got = collocations.collocations(texts(spark, rows), least=3, top=2, share=1.0).collect()
    assert sorted((r.rank, r.phrase) for r in got) == [(1, "a1 a2"), (2, "b1 b2")]


def test_products_past_64_bits(spark):
    big = 1 << 62
    rows = [("en", 1, 0, 0, 0, big), ("en", 2, 0, 0, 0, big - 1), ("en", 1, 2, 0, 0, big - 2)]
    counts = spark.createDataFrame(rows, "lang string, w1 long, w2 long, w3 long, w4 long, n long")
    got = collocations.scored(counts).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big - 2, big, big - 1, 2_000_000 * (big - 2) // (2 * big - 1))]


def test_whole_table_of_the_smallest_size(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {tuple(r) for r in collocations.collocations(docs).collect()}
    assert got == brute([(r.text, r.lang) for r in docs.collect()], 30, 2000)


def test_tables_are_added_up_in_little_memory():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 62, (6, 50_000)).astype(np.uint64) for _ in range(4)]
    parts[3][:5] = parts[0][:5]
    size = sum(p.nbytes for p in parts)
    tracemalloc.start()
    got = collocations._added(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for row in np.concatenate(parts, axis=1).T.tolist():
        want[row[0]] = [*row[:5], want.get(row[0], [0] * 6)[5] + row[5]]
    assert got.T.tolist() == [want[x] for x in sorted(want)]
    assert peak < 1.6 * size
    assert collocations._added([np.zeros((6, 0), np.uint64)]).shape == (6, 0)


def test_words_are_hashed_in_little_memory():
    raw = b"some words of a text. " * 50_000  # 1.1 MB
    collocations.words(raw[:100])
    tracemalloc.start()
    w, piece, start, end = collocations.words(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == 250_000 and len(set(w.tolist())) == 5 and piece[-1] == 49_999
    assert raw[start[-1]:end[-1]] == b"text"
    assert peak < 22e6


def test_a_task_gives_its_memory_back():
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024

    kept = []

    def task(batches):
        held = [np.ones(8000, np.uint8) for _ in range(25_000)]  # 200 MB
        kept.append(held[-1])  # lies above the others in the heap
        yield from batches

    before = resident()
    assert list(gives_back(task)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60
    before = resident()
    assert list(task(iter([1, 2]))) == [1, 2]
    assert resident() - before > 100  # what the wrapper is for


def test_places_and_tables_of_phrases():
    """Every border phrase of a piece once, and tables in the order of names."""
    from collections import Counter

    import numpy as np

    from rankforge.llm import collocations as C

    raw = b"a b a b. a b c d e\na a a a a; e"
    w, piece, _, _ = C.words(raw)
    seed = C._seed("en")
    every = C.Filter(np.full(1 << (C.FILTER_BITS - 6), ~np.uint64(0), np.uint64))
    texts = [p.split() for p in "a b a b|a b c d e|a a a a a|e".split("|")]
    hashes = {x: int(C.words(x.encode())[0][0]) for x in "abcde"}
    for k, (at, name, new) in enumerate(C.occurrences(w, piece, seed, every), 1):
        want = Counter(tuple(hashes[x] for x in t[i:i + k]) for t in texts for i in range(len(t) - k + 1))
        table = C._table(w, at, name, k)
        assert new.all() and (np.diff(table[0].astype(object)) > 0).all()
        assert {tuple(map(int, c[1:1 + k])): int(c[-1]) for c in table.T} == want
        assert not table[1 + k:-1].any()
        twice = C._added([table, table])
        assert (twice[:-1] == table[:-1]).all() and (twice[-1] == 2 * table[-1]).all()


def test_few_failures_take_one_pass(spark):
    """A phrase that the sample lacks altogether: word, pairs, triples and the
    whole follow from each other, and one pass counts them all."""
    every = texts(spark, random_rows(5, 400) + [("p q r s. ", "en")] * 40)
    inside = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1000)) < 500
    docs = every.filter(~F.col("text").startswith("p q") | ~inside)
    counts, more = collocations.phrase_counts(docs, least=8, share=0.5)
    grams, _ = counted([(r.text, r.lang) for r in docs.collect()])
    got = sorted((r.lang, sum(x != 0 for x in r[1:5]), r.n) for r in counts.filter("w1 <> 0").collect())
    assert got == sorted((lang, len(g), a) for lang, c in grams.items() for g, a in c.items() if a >= 8)
    assert grams["en"]["p", "q", "r", "s"] >= 8
    assert more == 1


def test_a_language_is_ranked_in_parts(spark):
    rows = [("en", i, i, 0, 0, i // 3, 1, 1, i // 3) for i in range(1, 400)] + [("de", i, i, 0, 0, 1, 1, 1, 1) for i in range(1, 9)]
    found = spark.createDataFrame(rows, "lang string, w1 long, w2 long, w3 long, w4 long, a long, l long, r long, score long")
    order = ["score", "a"]
    got = collocations._ahead(found, 5, [found[c].desc() for c in order])
    keep = {(r[0], r[1]) for r in rows if r[0] == "de" or r[8] >= 131}  # the fifth is tied
    assert {(r.lang, r.w1) for r in got.collect()} == keep and got.columns == found.columns
