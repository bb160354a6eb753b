"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest
from conftest import SF001

import __spark_entry__ as entry
from oracle_compare import compare, duck_conn

QUERIES = entry.queries()
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF001)


def test_every_query_has_an_oracle_or_is_rows_only():
    from pagetide.plans.queries import QUERIES as OWN
    from pagetide.plans.queries import ROWS_ONLY

    assert set(OWN) - set(SQLS) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQLS[name], SF001)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "slug", "citation"]
    assert df.count() > 0


SPARK_T = {"string": "str", "bigint": "i64", "int": "i32", "double": "f64", "boolean": "bool", "timestamp": "ts"}
DUCK_T = {"VARCHAR": "str", "BIGINT": "i64", "INTEGER": "i32", "DOUBLE": "f64", "BOOLEAN": "bool", "TIMESTAMP": "ts"}


def test_schemas_match(spark, con):
    bad = {}
    for name, sql in SQLS.items():
        sdt = {c: SPARK_T.get(t, t) for c, t in QUERIES[name](spark, SF001).dtypes}
        rel = con.sql(sql)
        ddt = {c: DUCK_T.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
        if sdt != ddt:
            bad[name] = (sdt, ddt)
    assert not bad
