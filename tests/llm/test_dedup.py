"""Exact and near duplicates against brute force."""
import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from rankforge.llm import exact_dedup, near_dedup
from rankforge.llm.common import Pile, table, word_hashes
from rankforge.llm.graph import components

from .edges import ROWS, documents


def fold(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_exact(rows, got):
    groups = {}
    for k, t in rows:
        groups.setdefault(fold(t), []).append(k)
    assert len(got) == len(rows)
    by = Counter((r.doc_id, r.text_sha256) for r in got)
    assert by == Counter((k, hashlib.sha256(fold(t).encode()).hexdigest()) for k, t in rows)
    sha = {hashlib.sha256(f.encode()).hexdigest(): ks for f, ks in groups.items()}
    for r in got:
        ks = sha[r.text_sha256]
        best = min((k for k in ks if k is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ks))
        if r.kept:
            assert r.doc_id == best
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(sha, 1))


@pytest.mark.parametrize("bits", [64, 6])
def test_exact_groups(spark, bits):
    """With 6-bit digests many chunks collide; the variants tell them apart."""
    got = exact_dedup.exact_groups(documents(spark).repartition(3), bits=bits).collect()
    check_exact([r[:2] for r in ROWS], got)


def test_exact_groups_with_colliding_recipes(spark):
    texts = [f"text number {i}" for i in range(60)] + ["text number 3", "text  number 4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_exact(list(enumerate(texts)), exact_dedup.exact_groups(df, bits=2).collect())


def test_chunks_are_content_defined():
    rng = np.random.default_rng(0)
    body = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8)).decode()
    a, b = (set(p) for _, p in exact_dedup.chunks([body, "shifted by this" + body]))
    assert len(a & b) > 0.8 * len(a)
    assert all(b"".join(p) == raw for raw, p in exact_dedup.chunks([body, "", "x", None]))


def test_exact_deduplicate_keeps_columns(spark):
    df = documents(spark, clash=True)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert out.count() == len({fold(r[1]) for r in ROWS})
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0


def test_exact_sample(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    check_exact(rows, exact_dedup.exact_groups(table(spark, "/root/testdata/sf0.001", "documents")).collect())


# --- near duplicates ---------------------------------------------------------

def words_of(t):
    """Runs of ASCII letters and digits (any case) and non-ASCII characters."""
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def shingle_set(t):
    w = words_of(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_classes(rows, similar=0.8):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) >= similar * max(len(a), len(b)):
            both = len(a & b)
            if both >= similar * (len(a) + len(b) - both):
                parent[find(j)] = find(i)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def check_near(rows, got, exactly=True):
    want = Counter()
    for c in brute_classes(rows):
        keys = [rows[i][0] for i in c]
        best = min((k for k in keys if k is not None), default=None)
        want.update((k, best, len(keys)) for k in keys)
    have = Counter((r.doc_id, r.class_id, r.class_size) for r in got)
    assert have == want
    kept = Counter(r.class_id for r in got if r.kept)
    assert sum(kept.values()) == len(brute_classes(rows))


def variants(seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.integers(words)] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_groups_edge_rows(spark):
    check_near([r[:2] for r in ROWS], near_dedup.near_groups(documents(spark).repartition(3)).collect())


def test_near_groups_chains_and_shared_passages(spark):
    """A large group of near copies whose members differ from each other, and
    texts that share half their words without being near copies."""
    texts = variants(1, 60, 300, 3) + variants(2, 25, 120, 1) + [f"{p} {q}" for p in variants(3, 1, 60, 0) for q in
                                                                (" ".join(f"q{i}r{j}" for j in range(45)) for i in range(40))]
    rows = list(enumerate(texts))
    check_near(rows, near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


def test_near_groups_with_repeated_lines(spark):
    """Copies that differ by one line, repeated 20 to 500 times."""
    rows = []
    for i, (words, times) in enumerate([(100, 20), (100, 100), (100, 500), (150, 100), (150, 470)] * 3):
        body = variants(100 + i, 1, words, 0)[0]
        line = " ".join(f"line{i}w{j}" for j in range(8))
        rows += [(2 * i, body), (2 * i + 1, "\n".join([body] + [line] * times))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.class_size == 2 for r in got) == len(rows)
    check_near(rows, got)


def test_near_sample(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check_near([tuple(r) for r in docs.select("doc_id", "text").collect()], near_dedup.near_groups(docs).collect())


def test_near_deduplicate(spark):
    df = documents(spark, clash=True)
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert out.count() == len(brute_classes([r[:2] for r in ROWS]))
    assert near_dedup.near_groups(documents(spark, [])).count() == 0


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    a = {int(k): float(w) for k, w in zip(rng.integers(0, 1 << 47, 200), rng.random(200) + 0.2)}
    b = {k: w * 1.5 for i, (k, w) in enumerate(a.items()) if i % 4}
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in set(a) & set(b))
    own = np.repeat([0, 1], [len(a), len(b)])
    who = near_dedup.sketch(own, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 6000)
    assert abs((who[0] == who[1]).mean() - want) < 0.03


def test_word_hashes_follow_the_words():
    texts = ["Ab c-d é1", "", "ab C d É1", "c"]
    h, n = word_hashes(texts)
    assert n.tolist() == [len(words_of(t)) for t in texts]
    assert h[0] == h[4] and h[1] == h[5] == h[8] and h[3] != h[7]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_small_sketches_count_differing_registers(spark):
    rng = np.random.default_rng(6)
    who = rng.integers(0, 1 << 47, (2, 480)).astype(np.uint64)
    who[1, :400] = who[0, :400]
    bits = near_dedup.bit_sketch(who)
    assert bits.shape == (2, 30)
    df = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist(), bits[0].tolist())], "a array<long>, b array<long>, c array<long>")
    row = df.select(near_dedup._far_sketches("a", "b", 0.8, 480).alias("near"), near_dedup._far_sketches("a", "b", 0.95, 480).alias("far"),
                    near_dedup._far_sketches("a", "c", 0.99, 480).alias("same")).first()
    assert (row.near, row.far, row.same) == (False, True, False)


def test_links_of_all_rounds_are_one_scan(spark, monkeypatch):
    """The plans on the driver don't grow with the rounds, and classes are found once a round."""
    words, texts, leaves, found = [f"w{i}" for i in range(200)], [], [], []
    for i in range(30):  # a chain: only neighbours are near copies
        words[7 * i % 200] = f"x{i}"
        words[(7 * i + 100) % 200] = f"y{i}"
        texts.append(" ".join(words))
    rows, verified = list(enumerate(texts)), near_dedup._verified

    def watched(links):
        leaves.append(links._jdf.queryExecution().analyzed().collectLeaves().size())
        return components(links)

    def counted(*asked):
        links = verified(*asked)
        found.append(not links.isEmpty())
        return links

    monkeypatch.setattr(near_dedup, "components", watched)
    monkeypatch.setattr(near_dedup, "_verified", counted)
    check_near(rows, near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert any(found) and leaves == [1] * sum(found)
    pile = Pile(spark, "pile")
    for i in range(3):
        assert [r.id for r in pile.put(spark.range(i, i + 1)).collect()] == [i]
    assert sorted(r.id for r in pile.whole().collect()) == [0, 1, 2]
    assert pile.whole()._jdf.queryExecution().analyzed().collectLeaves().size() == 1
