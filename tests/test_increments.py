"""Stored months, continued keys and bucketed tables against the full run."""

from conftest import rows
from pyspark.sql import functions as F
from test_plans import plan

from tradewind.checks.testdata import END, START, Roles
from tradewind.operators import cities, increments, sales
from tradewind.sources.layout import read_bucketed_tables, write_bucketed_tables

FOLDER = "/root/testdata/sf0.001"


def geo(t):
    return t["orders"], t["order_items"], t["customers"], t["sellers"], t["geolocation"]


def test_months_add_up_to_the_full_run(spark, tmp_path):
    t = Roles(spark, FOLDER)
    orders = t["orders"].where("order_purchase_timestamp >= '1996-11-01' and order_purchase_timestamp < '1997-03-01'")
    months = [r[0] for r in orders.select(increments.month_of("order_purchase_timestamp").alias("m")).distinct().collect()]
    assert len(months) == 4
    by_month = t["order_items"].join(
        t["orders"].select("order_id", increments.month_of("order_purchase_timestamp").alias(increments.MONTH)), "order_id"
    )
    by_month.write.partitionBy(increments.MONTH).parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    sides = (t["customers"], t["sellers"], t["geolocation"])
    folder = f"{tmp_path}/sums"
    increments.store_month_sums(folder, sorted(months)[:3], orders, items, *sides)
    before = sorted(rows(increments.stored_trade_routes(spark, folder, *sides)), key=repr)
    partial = orders.where(increments.month_of("order_purchase_timestamp") < max(months))
    full = cities.trade_routes(partial, t["order_items"], *sides)
    assert before == sorted(rows(full), key=repr)
    # The last month is added, twice; the earlier ones are not read again.
    for _ in range(2):
        increments.store_month_sums(folder, [max(months)], orders, items, *sides)
    routes = sorted(rows(increments.stored_trade_routes(spark, folder, *sides)), key=repr)
    assert routes == sorted(rows(cities.trade_routes(orders, t["order_items"], *sides)), key=repr) != before
    for threshold in ("raw", "merged"):
        got = increments.stored_city_activity(spark, folder, *sides, min_orders=3, threshold=threshold)
        want = cities.city_activity(orders, t["order_items"], *sides, min_orders=3, threshold=threshold)
        assert sorted(rows(got), key=repr) == sorted(rows(want), key=repr)
    assert "lineitem" not in plan(got) and "items" not in plan(got).replace("order_items", "")
    own = items.where(F.col(increments.MONTH) == max(months))
    assert f"PartitionFilters: [isnotnull({increments.MONTH}" in plan(own, "formatted")


def numbers(df):
    return {(r.a, r.b): r.number for r in df.collect()}


def test_keys_continue_from_load_to_load(spark, tmp_path):
    folder = f"{tmp_path}/keys"

    def load(name, pairs):
        df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a int, b string, text string")
        found = increments.continue_surrogate_key(df, "number", ["a", "b"], folder, name)
        assert found.columns == ["a", "b", "text", "number"] and found.count() == len(pairs)
        return numbers(found)

    first = load("one", [(3, "x"), (1, "y"), (1, None), (3, "x")])
    assert sorted(first.values()) == [1, 2, 3]
    second = load("two", [(1, "y"), (9, "z"), (0, "a"), (1, None)])
    assert second[1, "y"] == first[1, "y"] and second[1, None] == first[1, None]
    assert {second[0, "a"], second[9, "z"]} == {4, 5}
    assert load("two", [(1, "y"), (9, "z"), (0, "a"), (1, None)]) == second  # repeated
    third = load("three", [(k, "n") for k in range(50)] + [(9, "z")])
    assert third[9, "z"] == second[9, "z"] and sorted(v for (a, b), v in third.items() if b == "n") == list(range(6, 56))
    assert load("four", [(3, "x")]) == {(3, "x"): first[3, "x"]}


def test_order_buckets_join_without_an_exchange(spark, tmp_path):
    t = Roles(spark, FOLDER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = ("orders", "order_items", "order_payments")
        write_bucketed_tables({name: t[name] for name in names}, "order_id", 4, f"{tmp_path}/layout")
        stored = read_bucketed_tables(spark, f"{tmp_path}/layout")
        assert stored.keys() == set(names) and all(stored[n].schema.names == t[n].columns for n in names)
        growth = sales.revenue_growth(stored["orders"], stored["order_items"], START, END)
        assert "Exchange hashpartitioning(order_id" not in plan(growth)
        assert "Exchange hashpartitioning(order_id" in plan(sales.revenue_growth(t["orders"], t["order_items"], START, END))
        assert rows(growth) == rows(sales.revenue_growth(t["orders"], t["order_items"], START, END))
        paid = stored["orders"].join(stored["order_payments"], "order_id")
        assert "Exchange" not in plan(paid) and paid.count() == t["orders"].join(t["order_payments"], "order_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
