import json
from datetime import datetime
from decimal import Decimal as D

import pytest
from conftest import rows

from tradewind.schema import FOREIGN_KEYS, PRIMARY_KEYS, TABLES
from tradewind.session import shuffle_partitions
from tradewind.sources.files import export_json, read_csv_table, read_csv_tables, read_parquet_tables
from tradewind.sources.jdbc import Split, jdbc_options
from tradewind.sources.views import register_views


def test_csv_with_newlines_exponents_and_quarantine(spark, tmp_path):
    (tmp_path / "geolocation.csv").write_text(
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng\n"
        "1037,-2.35e1,-1.5e-05\n"
        "1038,abc,1\n"
        "1039,,4.6394\n"
        "1040,1,2,3\n"
    )
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_message\n"
        'r1,o1,5,"first line\nsecond ""line"""\n'
        "r1,o2,x,bad score\n"
        "r2,o3,,\n"
    )
    got = read_csv_tables(spark, str(tmp_path), ["geolocation", "order_reviews"])
    points = got["geolocation"]
    assert points.rows.schema == TABLES["geolocation"]
    assert sorted(rows(points.rows)) == [(1037, D("-23.5"), D("-0.000015")), (1039, None, D("4.6394"))]
    assert sorted(r[0] for r in rows(points.quarantine)) == ["1038", "1040"]
    reviews = got["order_reviews"]
    assert rows(reviews.rows)[0] == ("r1", "o1", 5, 'first line\nsecond "line"')
    assert [r[:3] for r in rows(reviews.quarantine)] == [("r1", "o2", "x")]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text(
        "seller_state,seller_id,extra,seller_city,seller_zip_code_prefix\nSP,s1,?,lins,16400\nSP,s2,?\n"
    )
    got = read_csv_tables(spark, str(tmp_path), ["sellers"])["sellers"]
    assert rows(got.rows) == [("s1", 16400, "lins", "SP")]
    assert got.quarantine.count() == 1
    with pytest.raises(ValueError, match="product_weight_g"):
        (tmp_path / "products.csv").write_text("product_id,product_category_name\np,c\n")
        read_csv_tables(spark, str(tmp_path), ["products"])


def test_csv_without_a_header_goes_by_position(spark, tmp_path):
    (tmp_path / "leads.csv").write_text("m1,web\nm2,\n")
    got = read_csv_table(spark, str(tmp_path / "leads.csv"), TABLES["leads_qualified"], header=False)
    assert rows(got.rows) == [("m1", "web"), ("m2", None)]


def test_csv_requires_keys(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        ",".join(f.name for f in TABLES["orders"]) + "\no1,c1,delivered,2017-10-02 10:56:33,,2017-10-18 00:00:00\n,c2,x,,,\n"
    )
    got = read_csv_tables(spark, str(tmp_path), ["orders"])["orders"]
    assert rows(got.rows) == [
        ("o1", "c1", "delivered", datetime(2017, 10, 2, 10, 56, 33), None, datetime(2017, 10, 18))
    ]
    assert got.quarantine.count() == 1


def test_parquet_tables_take_the_declared_types(spark, table, tmp_path):
    sellers = table("sellers", [{"seller_id": "s", "seller_zip_code_prefix": 1, "seller_city": "x", "seller_state": "y"}])
    sellers.write.parquet(str(tmp_path / "sellers.parquet"))
    assert rows(read_parquet_tables(spark, str(tmp_path), ["sellers"])["sellers"]) == rows(sellers)


def test_json_export_is_lines_and_overwrites(spark, tmp_path):
    target = str(tmp_path / "cities")
    export_json(spark.range(5), target)
    export_json(spark.createDataFrame([("são|sp", D("1.50"))], "city_key string, revenue decimal(12,2)"), target)
    lines = [line for part in (tmp_path / "cities").glob("part-*") for line in part.read_text().splitlines()]
    assert [json.loads(line) for line in lines] == [{"city_key": "são|sp", "revenue": 1.5}]


def test_missing_connection_settings_are_named_together():
    with pytest.raises(ValueError, match="url, password"):
        jdbc_options({"user": "u", "driver": "d", "password": ""}, "orders")


def test_jdbc_split_options():
    settings = {"url": "jdbc:x", "user": "u", "password": "p", "driver": "d"}
    options = jdbc_options(settings, "orders", Split("order_row", "0", "1000", 8))
    assert (options["dbtable"], options["partitionColumn"], options["numPartitions"]) == ("orders", "order_row", "8")
    assert "partitionColumn" not in jdbc_options(settings, "orders")


def test_views(spark, table):
    views = register_views({name: table(name, []) for name in TABLES})
    assert set(views) == {"vw_revenue_growth", "vw_payment_method_breakdown", "vw_geo"}
    for name, df in views.items():
        assert spark.table(name).columns == df.columns
        assert spark.table(name).count() == 0
    assert spark.table("orders").columns == TABLES["orders"].names


def test_declared_keys_exist():
    assert all(set(key) <= set(TABLES[name].names) for name, key in PRIMARY_KEYS.items())
    assert all(c in TABLES[t].names and pc in TABLES[p].names for t, c, p, pc in FOREIGN_KEYS)
    assert len(TABLES) == 11


def test_shuffle_partitions_follow_the_volume():
    assert shuffle_partitions(0, 8) == 8
    assert shuffle_partitions(10 * 1024**4, 4000) == 54614
