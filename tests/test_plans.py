"""The physical plans the operators are meant to have."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from tradewind.checks.queries import OPERATORS
from tradewind.checks.testdata import Roles
from tradewind.operators import cities, sales, selection, sellers
from tradewind.plans.joins import SALT, fits_broadcast, heavy_hitters, lookup, spread_hot_keys

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return Roles(spark, FOLDER)


def plan(df, mode="simple") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_query_crosses_tables_or_sorts_everything_in_one_task(tables, name):
    text = plan(OPERATORS[name](tables))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    ["avg_order_value_by_state", "category_revenue", "top_categories_by_volume", "lead_conversion", "top_routes", "top_city_routes"],
)
def test_top_lists_keep_only_their_rows_per_task(tables, name):
    assert "TakeOrderedAndProject" in plan(OPERATORS[name](tables))


def test_routes_per_city_are_limited_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan(OPERATORS["top_routes_per_city"](tables))


@pytest.mark.parametrize(
    "name",
    ["top_routes_per_city", "top_routes_per_city_buyer", "top_routes_per_city_both", "centroid_search"],
)
def test_a_choice_of_keys_folds_no_name_per_row(tables, name):
    text = OPERATORS[name](tables)._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in text.splitlines() if re.match(r"[\s:+|-]*(Filter|Join) ", line)]
    assert "translate(" in text and not [line for line in conditions if "translate(" in line]


def test_date_window_reaches_the_scan(tables):
    text = plan(sales.revenue_growth(tables["orders"], tables["order_items"]), "formatted")
    assert "GreaterThanOrEqual(o_orderdate,2017-01-01T00:00)" in text
    assert "LessThan(o_orderdate,2018-09-01T00:00)" in text


def test_scans_read_only_the_columns_in_use(tables):
    text = plan(sellers.top_sellers(tables["order_items"]), "formatted")
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int,l_extendedprice:double>" in text


def test_items_are_summed_before_they_are_joined(tables, no_broadcast):
    text = plan(sales.revenue_growth(tables["orders"], tables["order_items"]))
    join = text.index("SortMergeJoin")
    assert "partial_sum((price" in text[join:]


def test_city_activity_reads_the_items_once(tables):
    assert plan(cities.city_activity(*[tables[t] for t in ("orders", "order_items", "customers", "sellers", "geolocation")])).count("lineitem.parquet") == 1


def test_order_lines_stay_on_the_partitioning_by_order(tables, no_broadcast):
    stats = cities.seller_city_stats(*[tables[t] for t in ("orders", "order_items", "customers", "sellers", "geolocation")])
    text = plan(stats)
    above_join = text[: text.index("SortMergeJoin")]
    # window, per-order aggregate and partial city aggregate share one partitioning
    assert above_join.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["city_activity", "trade_routes"])
def test_items_and_orders_meet_in_one_shuffle_by_order(tables, no_broadcast, name):
    # Items also meet once by order and seller, summed before, so that neither is gathered.
    text = plan(OPERATORS[name](tables))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+L?, \d+\)", text)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+L?, seller_id#\d+L?, \d+\)", text)) == 1


@pytest.mark.parametrize("name", ["city_activity", "trade_routes", "top_routes_per_city", "city_search", "merge_city_stats"])
def test_names_are_folded_in_the_jvm(tables, name):
    assert "Python" not in plan(OPERATORS[name](tables))


def test_metric_range_is_a_scalar_subquery(spark):
    df = spark.createDataFrame([("a", 1.0)], "city_key string, v double")
    assert "Subquery" in plan(selection.metric_scale(df, "v"))


def test_lookup_broadcasts_below_the_threshold(spark):
    facts = spark.range(1000).selectExpr("id", "id % 3 as k")
    keyed = spark.range(3).selectExpr("id as k", "string(id) as name")
    assert fits_broadcast(keyed)
    joined = lookup(facts, keyed, "k", ["id"])
    assert "BroadcastHashJoin" in plan(joined) and SALT not in joined.columns
    assert joined.count() == 1000


def test_lookup_spreads_a_hot_key(spark, no_broadcast):
    facts = spark.range(3000).selectExpr("id", "if(id % 3 = 0, id, -1) as k")
    keyed = spark.range(-1, 3000, 2).selectExpr("id as k", "id * 10 as v")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot, nulls = heavy_hitters(facts, "k")
    assert [k for k, _ in hot] == [-1] and hot[0][1] >= partitions * 2 // 3 and nulls == 1
    joined = lookup(facts, keyed, "k", ["id"])
    assert "SortMergeJoin" in plan(joined) and joined.columns == ["k", "id", "v"]
    assert sorted(joined.collect()) == sorted(facts.join(keyed, "k").collect())
    left = lookup(facts, keyed, "k", ["id"], how="left")
    assert left.count() == 3000 and left.where("v is null").count() == 500
    salted, copied = spread_hot_keys(facts, keyed, "k", ["id"], hot)
    assert salted.where("k = -1").groupBy(SALT).count().count() == hot[0][1]
    assert salted.where("k <> -1").select(SALT).distinct().count() == 1  # cold keys have one salt


def test_a_large_keyed_side_is_copied_for_hot_keys_only(spark, no_broadcast):
    many = 10_000_000
    facts = spark.range(300_000).selectExpr("id", f"if(id % 3 = 0, 7, (id * 7919) % {many}) as k")
    keyed = spark.range(many).selectExpr("id as k", "id + 1 as v")
    hot, _ = heavy_hitters(facts, "k")
    assert [k for k, _ in hot] == [7]
    _, copied = spread_hot_keys(facts, keyed, "k", ["id"], hot)
    assert copied.count() == many + hot[0][1] - 1
    assert hot[0][1] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = lookup(facts, keyed, "k", ["id"])
    assert joined.agg({"v": "sum"}).first()[0] == facts.selectExpr("sum(k + 1)").first()[0]


def test_lookup_without_hot_keys_is_a_plain_join(spark, no_broadcast, monkeypatch):
    facts, keyed = spark.range(40_000).selectExpr("id", "id as k"), spark.range(40_000).selectExpr("id as k", "id as v")
    text = plan(lookup(facts, keyed, "k", ["id"]))
    assert "BroadcastHashJoin" not in text and "Generate" not in text and SALT not in text


def test_lookup_spreads_missing_keys_and_takes_empty_facts(spark, no_broadcast):
    facts = spark.range(900).selectExpr("id", "if(id % 3 = 0, id, null) as k")
    keyed = spark.range(0, 900, 2).selectExpr("id as k", "id as v")
    assert heavy_hitters(facts, "k")[1] > 1
    left = lookup(facts, keyed, "k", ["id"], how="left")
    assert sorted(left.collect(), key=str) == sorted(facts.join(keyed, "k", "left").collect(), key=str)
    empty = facts.where("id < 0")
    assert lookup(empty, keyed, "k", ["id"]).count() == 0
    assert lookup(facts.where("k is null"), keyed, "k", ["id"], how="left").count() == 600


def test_lookup_takes_text_keys_and_the_size_of_a_stored_table(spark, no_broadcast):
    facts = spark.range(600).selectExpr("id", "if(id % 2 = 0, 'hot', string(id)) as k")
    keyed = spark.sql("select 'hot' as k, 1 as v union all select '3', 2")
    found = lookup(facts, keyed, "k", ["id"])
    assert found.count() == 301
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    wide = spark.range(3).crossJoin(spark.range(10**9).selectExpr("id as other")).groupBy("id").agg({"other": "max"})
    assert not fits_broadcast(wide)
    assert "BroadcastHashJoin" in plan(lookup(facts, wide, "id", ["k"], sized_by=spark.range(3)))


def test_routes_and_cities_share_one_scan_of_the_items(tables):
    text = plan(OPERATORS["cities_on_routes"](tables))
    assert "lineitem.parquet" not in text and "order-lines-" in text


def test_lookup_rejects_joins_that_would_repeat_copies(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="full"):
        lookup(df, df, "id", ["id"], how="full")
