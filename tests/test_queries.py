"""Every registered query against its SQL, over whole tables."""

import decimal
import os
from functools import partial

import duckdb
import pytest

import __spark_entry__ as entry_points
from plumbline.plans import models
from plumbline.plans.oracles import ORACLES
from plumbline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def few_rounds(trees, spec, rounds, **more):
    return trees(spec, min(rounds, 3), **more)


def normal(rows, columns):
    def value(x):
        return round(float(x), 6) + 0.0 if isinstance(x, (float, decimal.Decimal)) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(value(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )


def test_oracles_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


# Full training takes minutes; here with few rounds, in full with PLUMBLINE_SLOW=1.
SLOW = ("gbt_holdout", "production_scoring", "retrain_flow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name, monkeypatch):
    if name in SLOW and not os.environ.get("PLUMBLINE_SLOW"):
        monkeypatch.setattr(models, "boosted_trees", partial(few_rounds, models.boosted_trees))
    df = entry_points.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    sql = ORACLES.get(name)
    if sql is None:
        return
    cursor = tables.execute(sql)
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert normal(rows, df.columns) == normal(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6
