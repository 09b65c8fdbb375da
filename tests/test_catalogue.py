"""Every query of the core against its SQL, on the smallest tables; and the driver's contract."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from opstrata.plans import catalogue

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        got, want, diff = differences(df, ORACLES[name], con)
        assert not diff and got == want
        kinds = {r[0]: r[1] for r in con.execute(f"describe {ORACLES[name]}").fetchall()}
        assert {c: TYPES.get(t, t) for c, t in kinds.items()} == dict(df.dtypes)
    else:
        assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
