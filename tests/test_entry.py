"""The driver contract and the oracle SQL (one representative per area)."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "flowct" in df.columns


def test_every_sql_query_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


@pytest.mark.parametrize("name", ["conn_traces", "traces_layout_b", "flow_gaps_lead", "auc", "leave_family_out",
                                  "quantiles", "log_roundtrip", "stream_deviation"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    rel = con.sql(E.oracle_sql()[name])
    want = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rel.fetchall()), key=repr)
    df = E.queries()[name](spark, SF001)
    order = [df.columns.index(c) for c in rel.columns]
    got = sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in df.collect()),
                 key=repr)
    assert got == want
