"""Every registered query against its DuckDB oracle on the smoke tables
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from orderflow.plans.verify import compare, oracle_connection

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


TYPES = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
         "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN",
         "TimestampNTZType()": "TIMESTAMP", "DateType()": "DATE"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    sdf = df.toPandas()
    if name not in ORACLE:
        assert len(sdf) > 0
        return
    ok, msg = compare(name, sdf, con.execute(ORACLE[name]).df())
    assert ok, msg
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    got = {f.name: TYPES.get(str(f.dataType), str(f.dataType)) for f in df.schema.fields}
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "unfulfilled_demand" in df.columns
