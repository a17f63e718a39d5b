"""Every registered query with SQL is compared to it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry_module.oracle_sql()
# A spread over all modules; check_queries.py runs the whole list.
PICKED = ["usage_rollup", "usage_dedupe", "resolve_approvals", "resolve_authority", "burn_alerts", "supersede_commands", "retry_plan", "verify_chain", "merge_snapshot", "classify_events",
          "offering_decisions", "emit_commands", "bgp_customers_by_region", "connected_parts", "rdf_lists", "constraint_min_count", "constraint_xone_shapes", "domain_range", "edition_findings", "heading_findings", "stream_hourly_totals"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def as_rows(cols, rows):
    index = [cols.index(c) for c in sorted(cols)]
    return sorted(repr(tuple(r[i] for i in index)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(cols, cur.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_module.queries())
