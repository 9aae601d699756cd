"""Every registered corpus query against its SQL, over whole tables."""

import os

import duckdb
import pytest

from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [
        tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows
    ]
    return sorted(plain, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    cursor = tables.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    expected = normal(cursor.fetchall(), columns)
    assert rows and normal(rows, df.columns) == expected
