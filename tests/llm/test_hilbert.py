import itertools
import zlib

import numpy as np
import pytest

from rankforge.llm import hilbert
from rankforge.llm.common import table

from .edges import ROWS, documents

DIMS = ["lang", "source", "n_chars"]


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    h = hilbert.hilbert_index(cells, bits)
    assert sorted(h) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def check_law(got, rows, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows if k is not None)
    sizes = [0] * shards
    for s, group in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        slots = [r.slot for r in group]
        assert slots == list(range(len(slots)))
        sizes[s] = len(slots)
    assert max(sizes) - min(sizes) <= 1
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shard_plan_whole_sample(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_law(hilbert.shard_plan(docs, DIMS, "doc_id", 40).collect(), rows, 40)


def test_edges(spark):
    rows = [r[:2] for r in ROWS]
    check_law(hilbert.shard_plan(documents(spark, clash=True).repartition(3), DIMS, "doc_id", 4).collect(), rows, 4)
    check_law(hilbert.shard_plan(documents(spark), DIMS, "doc_id", 40).collect(), rows, 40)  # fewer rows than shards
    assert hilbert.shard_plan(documents(spark, []), DIMS, "doc_id", 4).count() == 0


def test_one_value_may_hold_most_rows(spark):
    rows = [(i, "t", "en", "hot", 5) for i in range(300)] + [(300 + i, "t", "de", f"s{i}", i) for i in range(30)]
    check_law(hilbert.shard_plan(documents(spark, rows), DIMS, "doc_id", 7).collect(), [r[:2] for r in rows], 7)


def test_shards_prune(spark, tmp_path):
    """Written shards hold the texts, and their value ranges let a reader
    skip most of them in every dimension."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    plan = hilbert.shard_plan(docs, ["source", "n_chars"], "doc_id", 16)
    hilbert.write_shards(docs, plan, "doc_id", str(tmp_path / "out"))
    data = spark.read.parquet(str(tmp_path / "out/data"))
    assert data.count() == 1000 and "text" in data.columns
    m = spark.read.parquet(str(tmp_path / "out/manifest")).toPandas()
    by_source = ((m.min_source <= "src3") & (m.max_source >= "src3")).mean()
    by_length = ((m.min_n_chars <= 700) & (m.max_n_chars >= 700)).mean()
    assert by_source < 0.6 and by_length < 0.6
