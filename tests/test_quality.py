from datetime import datetime
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewind.operators import quality as ops


@pytest.fixture(scope="module")
def mixed(spark):
    long_text = "x" * 120
    return spark.createDataFrame(
        [
            (4, 10, "b  ", datetime(2017, 1, 31, 23), D("1.50"), None, 1.0),
            (2, None, long_text, datetime(2017, 2, 1, 1), D("2.25"), None, 2.5),
            (3, -5, "a", None, D("2.25"), None, 2.5),
            (1, None, None, datetime(2017, 1, 31, 23), None, None, None),
            (5, 10, "a", None, D("100.00"), None, 0.125),
        ],
        "id int, n bigint, s string, t timestamp, m decimal(10,2), nothing string, x double",
    )


@pytest.fixture(scope="module")
def profile(mixed):
    return {r.column_name: r for r in ops.profile_table(mixed, "mixed", key=["id"]).collect()}


def test_profile_has_a_row_per_column(profile, mixed):
    assert set(profile) == set(mixed.columns)
    assert list(profile["id"].asDict()) == ops.PROFILE_COLUMNS
    assert {r.table_name for r in profile.values()} == {"mixed"}
    assert {r.sanity_check for r in profile.values()} == {None}


def test_numeric_profile(profile):
    n = profile["n"]
    assert (n.full_type, n.nullable, n.null_count, n.distinct_count) == ("bigint", True, 2, 2)
    assert (n.min_val, n.max_val, n.extra_stat) == ("-5", "10", "avg=5.0000")
    assert (n.sample_1, n.sample_2, n.sample_3) == ("-5", "10", "10")  # rows 3, 4 and 5 of the key
    assert profile["m"].extra_stat == "avg=26.5000"
    assert (profile["m"].full_type, profile["m"].max_val) == ("decimal(10,2)", "100.00")
    assert profile["x"].extra_stat == "avg=1.5313"


def test_temporal_profile_counts_day_boundaries(profile):
    t = profile["t"]
    assert (t.full_type, t.null_count, t.distinct_count) == ("datetime2", 2, 2)
    assert (t.min_val, t.max_val, t.extra_stat) == ("2017-01-31 23:00:00", "2017-02-01 01:00:00", "range_days=1")


def test_text_profile_cuts_and_ignores_trailing_blanks(profile):
    s = profile["s"]
    assert (s.min_val, s.max_val, s.extra_stat) == ("a", "x" * 100, "max_len=120")
    assert (s.sample_1, s.sample_2, s.sample_3) == ("x" * 100, "a", "b  ")
    assert (s.null_count, s.distinct_count) == (1, 3)


def test_empty_column_profile(profile):
    e = profile["nothing"]
    assert (e.null_count, e.distinct_count, e.min_val, e.sample_1, e.extra_stat) == (5, 0, None, None, None)


def test_trailing_blanks_do_not_count(spark):
    df = spark.createDataFrame([("ab   ",)], "s string")
    assert ops.profile_table(df, "t").first().extra_stat == "max_len=2"


def test_samples_without_a_key_come_from_the_table(mixed):
    got = {r.column_name: r for r in ops.profile_table(mixed, "mixed").collect()}
    assert {got["n"].sample_1, got["n"].sample_2, got["n"].sample_3} == {"10", "-5"}


def test_approximate_distinct_is_optional(mixed):
    got = {r.column_name: r for r in ops.profile_table(mixed, "mixed", approximate=True).collect()}
    assert (got["n"].distinct_count, got["n"].null_count, got["n"].extra_stat) == (2, 2, "avg=5.0000")


def test_unordered_type_becomes_an_error_row(spark):
    df = spark.createDataFrame([(1, {"a": 1})], "id int, m map<string,int>")
    got = {r.column_name: r for r in ops.profile_table(df, "t", ["id"]).collect()}
    assert got["m"].extra_stat == "ERROR: type map<string,int> has no order"
    assert got["m"].sanity_check == "ERROR" and got["id"].extra_stat == "avg=1.0000"
    checked = {r.column_name: r.sanity_check for r in ops.sanity_rules(ops.profile_table(df, "t", ["id"])).collect()}
    assert checked == {"id": "OK", "m": "ERROR: type map<string,int> has no order"}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a")], "`a.b` int, `it's` string")
    assert {r.column_name for r in ops.profile_table(df, "o'k", ["a.b"]).collect()} == {"a.b", "it's"}


@pytest.mark.parametrize(
    ("full_type", "low", "high", "stat", "expected"),
    [
        ("nvarchar(5)", "a", "b", "max_len=6", "WARN: max_len 6 exceeds declared nvarchar(5)"),
        ("nvarchar(6)", "a", "b", "max_len=6", "OK"),
        ("nvarchar(MAX)", "a", "b", "max_len=999", "OK"),
        ("varchar(2)", "a", "b", "max_len=3", "WARN: max_len 3 exceeds declared varchar(2)"),
        ("int", "-2147483649", "5", "avg=1.0000", "WARN: value out of INT range (min=-2147483649, max=5)"),
        ("int", None, None, None, "OK"),
        ("smallint", "1", "32768", None, "WARN: value out of SMALLINT range (min=1, max=32768)"),
        ("smallint", "-32768", "32767", None, "OK"),
        ("tinyint", "-1", None, None, "WARN: value out of TINYINT range (min=-1, max=null)"),
        ("decimal(5,1)", "1", "2.25", None, "WARN: fractional digits in max_val (2.25) may exceed scale in decimal(5,1)"),
        ("decimal(5,2)", "1", "2.25", None, "OK"),
        ("decimal(5,0)", "1", "2", None, "OK"),
        ("datetime2", "1999-12-31 23:59:59", "2017-01-01 00:00:00", None,
         "WARN: date out of expected range 2000-2030 (min=1999-12-31 23:59:59, max=2017-01-01 00:00:00)"),
        ("date", "2000-01-01", "2030-01-01", None, "OK"),
        ("date", "2000-01-01", "2030-01-02", None, "WARN: date out of expected range 2000-2030 (min=2000-01-01, max=2030-01-02)"),
        ("int", "1", "2", "ERROR: broken", "ERROR: broken"),
    ],
)
def test_sanity_rules(spark, full_type, low, high, stat, expected):
    df = spark.createDataFrame([(full_type, low, high, stat)], "full_type string, min_val string, max_val string, extra_stat string")
    assert ops.sanity_rules(df).first().sanity_check == expected


def test_report_puts_warnings_first(spark):
    df = spark.createDataFrame(
        [("b", "x", "OK"), ("a", "y", "OK"), ("z", "c", "WARN: w"), ("c", "c", "ERROR: e")],
        "table_name string, column_name string, sanity_check string",
    )
    assert [r[0] for r in rows(ops.profile_report(df))] == ["c", "z", "a", "b"]


def test_primary_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, None), (2, None)], "a int, b int")
    got = ops.check_primary_key(df, "t", ["a", "b"]).first()
    assert tuple(got) == ("t", "a,b", 5, 2, 1, 2, False)
    assert sorted(rows(ops.primary_key_violations(df, ["a", "b"]))) == [(1, 1, 2), (2, None, 2)]
    assert ops.check_primary_key(df.limit(0), "t", ["a"]).first().is_valid
    assert ops.check_primary_key(spark.range(3), "t", ["id"]).first().is_valid


def test_foreign_key(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "p int")
    assert rows(ops.check_foreign_key(child, "k", parent, "p")) == [(9, 2)]


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(12,2)", "timestamp", "double", "struct<a:int>"])
def test_foreign_key_of_any_type_over_many_batches(spark, kind):
    value = "struct(cast(id % 7 as int) as a)" if kind.startswith("struct") else f"cast(id % 7 as {kind})"
    child = spark.range(30_000).selectExpr(f"if(id % 2 = 0, {value}, null) as k")
    parent = spark.range(30_000).where("id % 7 > 1").selectExpr(f"{value} as p")
    want = {0: sum(i % 7 == 0 for i in range(0, 30_000, 2)), 1: sum(i % 7 == 1 for i in range(0, 30_000, 2))}
    keys = child.where("k is not null").distinct().count()
    got = ops.check_foreign_key(child, "k", parent, "p")
    assert keys == 7 and sorted(r.row_count for r in got.collect()) == sorted(want.values())
    assert got.dtypes == [("orphan_key", kind), ("row_count", "bigint")]


def test_foreign_key_of_two_types(spark):
    child = spark.createDataFrame([("1",), ("9",), ("9",)], "k string")
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    assert rows(ops.check_foreign_key(child, "k", parent, "p")) == [("9", 2)]


def test_foreign_keys_meet_in_one_aggregate_over_all_partitions(spark):
    child, parent = spark.range(100).toDF("k"), spark.range(50).toDF("p")
    found = ops.check_foreign_key(child, "k", parent, "p")
    text = found._jdf.queryExecution().toString()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    # neither two hash tables and two sorts in a task nor partitions put together by their packed size
    assert "REPARTITION_BY_NUM" in text and "Join" not in text and f", {partitions})" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_zip_coverage(table):
    from test_sales import item, order

    got = ops.zip_coverage(
        table("orders", [order("1", None), order("2", None, customer="c2"), order("3", None, customer="c3")]),
        table("order_items", [item("1", 1), item("1", 1), item("2", 1), item("3", 1, seller="s2"), item("3", 1, seller="s2")]),
        table("customers", [{"customer_id": "c1", "customer_zip_code_prefix": 7}, {"customer_id": "c2", "customer_zip_code_prefix": None}, {"customer_id": "c3", "customer_zip_code_prefix": 1}]),
        table("sellers", [{"seller_id": "s1", "seller_zip_code_prefix": 1}, {"seller_id": "s2", "seller_zip_code_prefix": 8}]),
        table("geolocation", [{"geolocation_zip_code_prefix": 1, "geolocation_lat": 1, "geolocation_lng": 1}]),
    )
    assert sorted(rows(got)) == [("customer", 2, 2, 3), ("seller", 1, 1, 2)]


def test_surrogate_key_is_dense_and_ordered(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("(id * 7919) % 1000 as review_id", "'t' as text")
    doubled = df.union(df)
    keyed = ops.add_surrogate_key(doubled, "review_row_id", ["review_id"])
    assert keyed.columns == ["review_id", "text", "review_row_id"]
    got = keyed.orderBy("review_row_id").select("review_row_id", "review_id").collect()
    assert [r[0] for r in got] == list(range(1, 2001))
    assert [r[1] for r in got] == sorted(r[1] for r in got)
    assert keyed.agg(F.count_distinct("review_row_id")).first()[0] == 2000


def test_every_declared_key_is_checked(table):
    from tradewind.schema import FOREIGN_KEYS, PRIMARY_KEYS

    names = {*PRIMARY_KEYS, *(r[0] for r in FOREIGN_KEYS)}
    tables = {name: table(name, []) for name in names}
    tables["sellers"] = table("sellers", [{"seller_id": "s"}, {"seller_id": "s"}, {"seller_id": "t"}])
    tables["leads_closed"] = table("leads_closed", [{"mql_id": "m"}, {"mql_id": "m"}])
    found = {r.table_name: r for r in ops.check_primary_keys(tables, PRIMARY_KEYS).collect()}
    assert found.keys() == PRIMARY_KEYS.keys() and [n for n, r in found.items() if not r.is_valid] == ["sellers"]
    assert (found["sellers"].duplicate_rows, found["sellers"].null_key_rows) == (1, 0)
    orphans = [tuple(r) for r in ops.check_foreign_keys(tables, FOREIGN_KEYS).collect()]
    assert orphans == [("leads_closed", "mql_id", "leads_qualified", "m", 2)]


# ---- one bad column, few scans, stored states ----


def test_an_overflow_is_the_error_of_its_column_only(spark):
    df = spark.createDataFrame(
        [(1, 1e30, D("9e37"), 5), (2, 1e30, D("9e37"), 6), (3, None, None, None)],
        "id int, big double, wide decimal(38,0), fine int",
    )
    got = {r.column_name: r for r in ops.profile_table(df, "t", ["id"]).collect()}
    assert got["big"].extra_stat == "ERROR: the mean is out of range of decimal(28,4)"
    assert got["wide"].extra_stat == "ERROR: the sum of decimal(38,0) overflows"
    for name in ("big", "wide"):
        assert got[name].sanity_check == "ERROR" and got[name].full_type in ("float", "decimal(38,0)")
        assert got[name].min_val is None and got[name].null_count is None and got[name].distinct_count is None
    assert (got["fine"].extra_stat, got["fine"].null_count, got["fine"].sample_1) == ("avg=5.5000", 1, "5")
    checked = {r.column_name: r.sanity_check for r in ops.sanity_rules(ops.profile_table(df, "t", ["id"])).collect()}
    assert checked == {
        "id": "OK", "fine": "OK", "big": "ERROR: the mean is out of range of decimal(28,4)",
        "wide": "ERROR: the sum of decimal(38,0) overflows",
    }


def test_infinite_and_missing_numbers_are_errors_of_their_column(spark):
    df = spark.createDataFrame([(float("inf"), float("nan"), 1.0), (1.0, 2.0, 2.0)], "a double, b double, c double")
    got = {r.column_name: r.extra_stat for r in ops.profile_table(df, "t").collect()}
    assert got["a"].startswith("ERROR:") and got["b"].startswith("ERROR:") and got["c"] == "avg=1.5000"


def test_a_table_is_scanned_twice_at_most(spark, tmp_path):
    from test_plans import plan

    columns = [f"id + {k} as a{k}" for k in range(6)] + [f"string(id % {k + 2}) as s{k}" for k in range(6)]
    spark.range(1000).selectExpr("id", *columns, "timestamp_seconds(id) as t", "cast(id as decimal(12,2)) as d").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    text = plan(ops.profile_table(df, "t", ["id"]))
    assert text.count("FileScan") == 2
    assert plan(ops.profile_table(df, "t", ["id"], approximate=True)).count("FileScan") == 1


def test_samples_and_distinct_counts_of_repeated_keys_and_odd_types(spark):
    df = spark.createDataFrame(
        [(1, [2], (1, "x"), True, 0.0), (1, [1], (1, "x"), None, -0.0), (1, None, (0, "y"), False, float("nan")), (0, [9], None, True, float("nan"))],
        "k int, a array<int>, s struct<i:int,t:string>, b boolean, x double",
    )
    got = {r.column_name: r for r in ops.profile_table(df, "t", ["k"]).collect()}
    assert [got["a"][f"sample_{n}"] for n in (1, 2, 3)] == ["[9]", "[1]", "[2]"]
    assert (got["s"].distinct_count, got["b"].distinct_count, got["b"].null_count) == (2, 2, 1)
    assert ops.profile_table(df.limit(0), "t", ["k"]).where("null_count = 0 and distinct_count = 0 and min_val is null").count() == 5


def test_states_of_parts_merge_to_the_profile_of_the_union(spark, mixed, tmp_path):
    from tradewind.operators import profile as states

    more = spark.range(20_000).selectExpr(
        "int(id + 6) as id", "id % 5000 as n", "'v' || (id % 7000) as s", "timestamp_seconds(id * 86400) as t",
        "cast(id % 100 as decimal(10,2)) as m", "cast(null as string) as nothing", "id / 3.0D as x",
    )
    for part, df in (("a", mixed), ("b", more), ("b", more.limit(0)), ("b", more), ("c", mixed.limit(0))):
        states.store_profile_state(df, f"{tmp_path}/s", part, ["id"])
    found = states.profile_from_states(states.read_profile_states(spark, f"{tmp_path}/s"), mixed.schema, "u")
    got = {r.column_name: r.asDict() for r in found.collect()}
    want = {r.column_name: r.asDict() for r in ops.profile_table(mixed.unionByName(more), "u", ["id"]).collect()}
    assert got.keys() == want.keys()
    for name, row in want.items():
        exact = {k: v for k, v in row.items() if k != "distinct_count"}
        assert {k: got[name][k] for k in exact} == exact
        assert got[name]["distinct_count"] == pytest.approx(row["distinct_count"], rel=0.03)
    assert got["id"]["median"] == pytest.approx(10_000, rel=0.04) and got["s"]["median"] is None
    assert got["x"]["quantile_25"] == pytest.approx(5000 / 3, rel=0.1)


def test_an_overflow_in_one_part_stays_an_error_of_the_union(spark, tmp_path):
    from tradewind.operators import profile as states

    schema = "id int, wide decimal(38,0)"
    bad = spark.createDataFrame([(1, D("9e37")), (2, D("9e37"))], schema)
    fine = spark.createDataFrame([(3, D("1")), (4, None)], schema)
    for part, df in (("a", bad), ("b", fine)):
        states.store_profile_state(df, f"{tmp_path}/s", part, ["id"])
    got = {r.column_name: r for r in states.profile_from_states(states.read_profile_states(spark, f"{tmp_path}/s"), bad.schema, "t").collect()}
    assert got["wide"].extra_stat.startswith("ERROR:") and got["id"].extra_stat == "avg=2.5000"
