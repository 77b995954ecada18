"""Every registered query against its SQL in the other engine, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from tradewind.checks import oracle, queries

FOLDER = "/root/testdata/sf0.001"
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_module.queries().keys() and ORACLE.keys() <= entry_module.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = engine.execute(ORACLE[name])
    types = {column[0]: str(column[1]).replace(" ", "") for column in cursor.description}
    assert {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in df.schema} == types
    order = list(types)
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(row)) for row in df.select(order).collect()) == expected


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20


def test_the_tables_hold_what_a_wrong_operator_would_get_wrong(spark):
    """Orphans of all seven relations, repeated payment types and leads, several ids of a person, a tie over rank 10."""
    from pyspark.sql import functions as F

    from tradewind.checks.testdata import Roles
    from tradewind.schema import FOREIGN_KEYS

    t = Roles(spark, FOLDER)
    found = QUERIES["check_foreign_keys"](spark, FOLDER).select("child_table", "child_column").distinct().collect()
    assert {tuple(r) for r in found} == {(child, column) for child, column, _, _ in FOREIGN_KEYS}
    assert t["order_payments"].where("payment_type is not null").groupBy("order_id", "payment_type").count().where("count > 1").count()
    assert t["leads_qualified"].groupBy("mql_id").count().where("count > 1").count()
    assert t["leads_closed"].groupBy("mql_id").count().where("count > 1").count()
    assert t["customers"].agg(F.count_distinct("customer_unique_id")).first()[0] < t["customers"].count()
    assert t["order_items"].where("price is null").count()


def test_ranks_that_tie_over_the_tenth_all_stay(spark):
    assert QUERIES["top_sellers_ties"](spark, "/root/testdata/sf0.01").count() > 10
