import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankforge.llm import tries
from rankforge.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, borrow):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    if not borrow:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[:h[c]] + v[h[c]:] for c, v in own.items()}


def brute(rows, borrow=True):
    convs = rebuilt(rows, borrow)
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved, out = {}, {}, set()
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in below[n]) or 1
        saved[n] = (len(members[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(saved[x] for x in below[n])
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n))
        out.add((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(df, borrow=True):
    c = F.col("c")
    how = {"base": c - c % 100, "head": F.crc32(c.cast("string").cast("binary")) % 6} if borrow else {}
    got = [tuple(r) for r in tries.conversation_trie(df, **how).drop("k1", "k2").collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["hi", "é\U0001F600", "", None]))
            for c in r.sample(range(330), 60) for t in r.sample(range(20), r.randrange(1, 9))]
    return rows + [(r.randrange(330), None, "user", "late")]


@pytest.mark.parametrize(("seed", "borrow"), [(1, True), (2, True), (3, False)])
def test_equals_brute_force(spark, seed, borrow):
    rows = random_rows(seed)
    assert trie(spark.createDataFrame(rows, SCHEMA), borrow) == brute(rows, borrow)


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    assert trie(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_one_conversation_in_many_slices_and_one_long_chain(spark):
    rows = [(100, t, "u", f"t{t}") for t in range(700)] + [(101, t, "u", f"t{t}") for t in range(350)]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5), False) == brute(rows, False)


def test_group_of_copies_digested_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 7)
    rows = [(c, 0, "u", "same") for c in range(1000, 1200)] + [(5, 0, "u", "other")]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(9), False) == brute(rows, False)


def test_edge_rows(spark):
    rows = [(None, 0, "u", "nobody"), (1, None, None, None), (1, None, None, None), (2, 0, "u", ""), (207, 0, "u", "short"), (300, 1, "u", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "t", "k1", "part", "depth", "i", "len"):
        df = df.withColumn(name, F.lit("clash"))
    assert trie(df) == brute(rows)
    assert trie(spark.createDataFrame([], SCHEMA)) == set()


def test_totals_of_a_forest(spark):
    r = random.Random(7)
    parent = {i: None if i < 3 else r.choice([i - 1, r.randrange(i)]) for i in range(400)}
    df = spark.createDataFrame([(i, p, i) for i, p in parent.items()], "id long, up long, w long")
    total = {i: i for i in parent}
    for i in range(399, -1, -1):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    assert {x.id: x.w for x in tries.subtree_totals(df, ["id"], ["up"], ["w"]).collect()} == total
