"""Every query of the catalogue against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from weblume.catalogue_built import ORACLES, QUERIES

from .conftest import SF


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR[]": "array<string>", "TIMESTAMP": "timestamp"}


def norm(v):
    if isinstance(v, float):
        return "None" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    kinds = {r: TYPES.get(str(t), str(t)) for r, t in zip(rel.columns, rel.types)}
    assert {f.name: f.dataType.simpleString().replace("_ntz", "") for f in df.schema} == kinds
    at = [rel.columns.index(n) for n in names]
    assert got and got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
