from decimal import Decimal as D

import pytest
from conftest import rows
from test_sales import item, order

from tradewind.operators import cities as ops


@pytest.fixture
def small_variants(table):
    """Two spellings of a seller city with four orders each, one customer city."""
    orders = [order(f"o{k}", "2017-01-01 00:00:00") for k in range(8)]
    items = [item(f"o{k}", 10, 1 + k % 2, seller="s1" if k < 4 else "s2") for k in range(8)]
    return (
        table("orders", orders),
        table("order_items", items),
        table("customers", [{"customer_id": "c1", "customer_zip_code_prefix": 1, "customer_city": "Rio", "customer_state": "RJ"}]),
        table(
            "sellers",
            [
                {"seller_id": "s1", "seller_zip_code_prefix": 2, "seller_city": "São Paulo", "seller_state": "SP"},
                {"seller_id": "s2", "seller_zip_code_prefix": 2, "seller_city": "sao paulo", "seller_state": "SP"},
            ],
        ),
        table(
            "geolocation",
            [{"geolocation_zip_code_prefix": z, "geolocation_lat": z, "geolocation_lng": 0} for z in (1, 2)],
        ),
    )


def test_threshold_before_merging_drops_small_spellings(small_variants):
    got = {r.city_key: r for r in ops.city_activity(*small_variants).collect()}
    assert set(got) == {"rio|rj"}
    assert (got["rio|rj"].seller_order_count, got["rio|rj"].buyer_order_count) == (0, 8)
    assert got["rio|rj"].seller_avg_freight == 0


def test_threshold_after_merging_keeps_the_city(small_variants):
    got = {r.city_key: r for r in ops.city_activity(*small_variants, threshold="merged").collect()}
    paulo = got["sao paulo|sp"]
    assert (paulo.seller_order_count, paulo.seller_revenue, paulo.buyer_order_count) == (8, D("92.00"), 0)
    assert (paulo.city, paulo.lat, paulo.lng) == ("São Paulo", 2.0, 0.0)  # a tie goes to the first name
    with pytest.raises(ValueError, match="threshold"):
        ops.city_activity(*small_variants, threshold="both")


def test_one_pass_equals_the_separate_sides(small_variants):
    got = {r.city_key: r for r in ops.city_activity(*small_variants, min_orders=1).collect()}
    supply = ops.merge_city_stats(
        ops.seller_city_stats(*small_variants, min_orders=1), "seller_city", "seller_state", "total_revenue"
    )
    demand = ops.merge_city_stats(
        ops.buyer_city_stats(*small_variants, min_orders=1), "customer_city", "customer_state", "total_spend"
    )
    for r in supply.collect():
        row = got[r.city_key]
        assert (row.seller_order_count, row.seller_revenue, row.seller_avg_freight, row.seller_avg_distance) == tuple(r[3:])
    for r in demand.collect():
        row = got[r.city_key]
        assert (row.buyer_order_count, row.buyer_spend, row.buyer_avg_freight, row.buyer_avg_distance) == tuple(r[3:])


def test_merging_weights_rounded_averages(spark):
    stats = spark.createDataFrame(
        [("São Paulo", "SP", 3, D("30.00"), D("1.11"), D("10.00")), ("SAO PAULO", "sp", 1, D("5.00"), D("2.22"), None), ("", "SP", 2, None, None, None)],
        "city string, state string, order_count long, total decimal(20,2), avg_freight decimal(12,2), avg_distance_km decimal(12,2)",
    )
    got = {r[0]: tuple(r[1:]) for r in ops.merge_city_stats(stats, "city", "state", "total").collect()}
    assert got["sao paulo|sp"] == ("São Paulo", "SP", 4, D("35.00"), D("1.39"), D("7.50"))
    assert got["|sp"] == ("", "SP", 2, D("0.00"), D("0.00"), D("0.00"))
    assert rows(ops.merge_city_stats(stats, "city", "state", "total", min_orders=3))[0][0] == "sao paulo|sp"


def test_routes_merge_spellings(small_variants):
    got = ops.trade_routes(*small_variants).collect()
    assert len(got) == 1
    route = got[0]
    assert (route.seller_key, route.customer_key, route.order_count) == ("sao paulo|sp", "rio|rj", 8)
    assert (route.total_revenue, route.avg_freight, route.avg_distance_km) == (D("92.00"), D("1.50"), D("111.00"))
    assert (route.seller_lat, route.customer_lat) == (2.0, 1.0)
