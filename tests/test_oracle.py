"""Every registered query against its plain-SQL twin on the smallest data set."""

import glob
import os

import duckdb
import pytest

from sparkcurves.plans.oracle import SQL
from sparkcurves.plans.queries import REGISTRY
from tests.conftest import SF_DIR

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(SQL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_same_rows(spark, duck, name):
    frame = REGISTRY[name](spark, SF_DIR)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    columns = sorted(frame.columns)
    assert columns == sorted(names)
    assert {c: SPARK_TYPES[t] for c, t in frame.dtypes} == types
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert got and got == want
