import re
import tracemalloc

import numpy as np
import pytest

from rankforge.llm import decontaminate as dc
from rankforge.llm.common import table, word_hashes

from .edges import ROWS, documents

SF = "/root/testdata/sf0.01"


def grams(t, n=13):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_recall_and_precision_against_brute_force(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = {r.item_id: grams(r.text) for r in bench.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, g in items.items()
            if g and len(g & grams(d.text)) >= 0.8 * len(g)}
    rows = dc.matches(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(want) > 10
    assert len(want & got) >= 0.9 * len(want)
    assert len(got - want) <= 0.1 * len(want)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuv"), rng.integers(4, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]

    def text(n):
        return [common[rng.integers(5)] if rng.random() < 0.4 else vocabulary[rng.integers(3000)] for _ in range(n)]

    return rng, vocabulary, text


def test_paraphrases_and_clean_texts(spark, world):
    rng, vocabulary, text = world
    items = [text(40) for _ in range(12)]
    docs, planted = [], {}
    for i, item in enumerate(items):
        changed = list(item)
        for j in rng.choice(33, 8, replace=False):  # the answer at the end stays
            changed[j] = vocabulary[rng.integers(3000)]
        for body in (item, changed):
            planted[len(docs)] = i
            docs.append(text(150) + body + text(120))
    clean = range(len(docs), len(docs) + 200)
    docs += [text(250) for _ in clean]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(frame, bench).collect()}
    want = set(planted.items())
    assert len(got & want) >= 0.9 * len(want)
    assert not {d for d, _ in got} & set(clean)
    kept = dc.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in got}


def test_short_items_and_parts_of_items(spark, world):
    """Whole items of 3 to 31 words, and stretches of long items, in random documents."""
    rng, vocabulary, text = world
    rare = [[vocabulary[j] for j in rng.integers(0, 3000, n)] for n in (*range(3, 32), *range(3, 32))]
    long = [text(n) for n in (63, 63, 120, 200)]
    bench = rare + long
    docs, planted = [], set()
    for i, item in enumerate(bench):
        body = item if i < len(rare) else item[5:5 + min(45, len(item) // 2)]
        planted.add((len(docs), i))
        docs.append(text(130) + body + text(141))
    clean = range(len(docs), len(docs) + 150)
    docs += [text(260) for _ in clean]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(bench)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(frame, asked).collect()}
    assert planted - got == set()
    assert not {d for d, _ in got} & set(clean)


def test_given_answers_decide_paraphrases(world):
    _, _, text = world
    item = text(30)
    space = dc.Space(np.ones(dc.FEATURES), np.zeros((dc.FEATURES + 1, 1), np.float32), np.ones(dc.FEATURES, bool))
    half = " ".join(item[:21])
    for answer, found in ((half.split()[3], True), ("unheardof", False)):
        items = dc.Items([1], [" ".join(item)], [answer], space, dc.Config())
        assert (items.verdict(0, dc.word_hashes([half])[0].tolist()) is not None) == found


def test_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 6, rng.integers(0, 15)).tolist() for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert dc.Sequence(a).common(b) == d[-1][-1]


def test_randomised_svd_finds_the_top_space(spark, world):
    """The whitened table reproduces the leading singular values."""
    _, _, text = world
    texts = [" ".join(text(48)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    freq, n = dc.document_frequency(df)
    weight = np.log((n + 1) / (freq + 1))
    b = dc.blocks(texts)
    first, two = dc.passages(b)
    a = np.zeros((len(first), dc.FEATURES))
    for i, (f, t) in enumerate(zip(first, two)):
        for x in b.feature[f:f + 1 + t].ravel():
            if x < dc.FEATURES:
                a[i, x] += weight[x]
    basis = np.random.default_rng(0).standard_normal((dc.FEATURES, 8))
    assert np.allclose(dc.gram_times(df, weight, basis), a.T @ (a @ basis), rtol=1e-3, atol=1e-2 * np.abs(a).max())


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the of"), (4, ROWS[3][1]), (4, ROWS[3][1])], "item_id long, text string")
    docs = documents(spark, clash=True)
    got = sorted({(r.doc_id, r.item_id) for r in dc.matches(docs, bench).collect()})
    assert got == [(4, 4), (5, 4), (6, 4)]
    assert dc.decontaminate(docs, bench).columns == docs.columns
    assert dc.decontaminate(docs, bench).count() == len(ROWS) - 4
    assert dc.matches(documents(spark, []), bench).count() == 0
    assert dc.matches(docs, bench.limit(0)).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_rows_are_spread_to_the_features_of_their_half_passages():
    rng = np.random.default_rng(3)
    feature = np.minimum(rng.geometric(0.001, (900, dc.HALF)) - 1, dc.FEATURES)
    feature[rng.random(feature.shape) < 0.2] = 5  # in some 2,900 places, so over three levels of groups
    feature[rng.random(feature.shape) < 0.1] = dc.FEATURES
    rows = rng.standard_normal((900, 3)).astype(np.float32)
    want = np.zeros((dc.FEATURES + 1, 3))
    np.add.at(want, feature.ravel(), np.repeat(rows, dc.HALF, axis=0))
    found, sums = dc.spread(feature, rows)
    assert found.tolist() == sorted(set(feature.ravel().tolist()) - {dc.FEATURES})
    assert np.allclose(sums, want[found], atol=1e-3)
    found, sums = dc.spread(np.full((2, dc.HALF), dc.FEATURES), rows[:2])  # padding alone
    assert not len(found) and sums.shape == (0, 3)


def test_words_are_hashed_in_little_memory():
    texts = ["some words of a text " * 5000] * 10  # 1 MB
    word_hashes(texts[:1])
    tracemalloc.start()
    hashes, counts = word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [25000] * 10 and len(set(hashes.tolist())) == 5
    assert peak < 20e6


def test_word_hashes_do_not_depend_on_the_place():
    long = "x" * 70_000
    words = ["a", "B", "é", long, "z" * 65_536, "b"]
    hashes, counts = word_hashes(["", "!", " ".join(words), *words])
    assert counts.tolist() == [0, 0, 6, 1, 1, 1, 1, 1, 1]
    assert hashes[:6].tolist() == hashes[6:].tolist()
    assert hashes[1] == hashes[5] and len(set(hashes.tolist())) == 5


def test_sums_of_features_reach_the_driver_as_columns(spark):
    """A million sums, and no Python object for each of them, whatever the session does for pandas."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(10**6, size=2000)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    weight, basis = np.ones(dc.FEATURES), rng.standard_normal((dc.FEATURES, 64))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        got = dc.gram_times(docs, weight, basis)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert (got != 0).all(axis=1).sum() > 0.9 * dc.FEATURES
    assert peak < 5 * basis.nbytes
