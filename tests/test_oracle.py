"""A sample of driver queries against their DuckDB oracles at sf0.001
(the full set runs through tools/oracle_check.py at sf0.01)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from rankforge.sources.tables import TABLE_NAMES
from tools.oracle_check import rows_key

SF = "/root/testdata/sf0.001"
SAMPLE = ("minimal_slice", "median_impute", "sweep", "skills_join", "taxonomy_fold", "career_full",
          "weak_labels", "query_groups", "full_rank", "ndcg_per_group", "rationale", "metadata_reason",
          "open_flag", "assessment_mean", "embedding_refresh", "stream_scan", "jsonl_scan")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert rows_key(df.columns, rows) == rows_key(ocols, orows)
