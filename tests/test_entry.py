"""Driver contract: entry, query/oracle registry, privacy of outputs."""
import __spark_entry__ as E

from rankforge.config import PII_COLUMNS


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["candidate_id", "rank", "score", "reasoning"]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert not {c.lower() for c in df.columns} & set(PII_COLUMNS)


def test_scores_descending(spark):
    rows = E.queries()["minimal_slice"](spark, "/root/testdata/sf0.001").collect()
    keys = [(-r["score"], r["candidate_id"]) for r in rows]
    assert keys == sorted(keys)
