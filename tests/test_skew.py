"""One order, seller, zip code and product with a third or more of all rows."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tradewind.operators import cities, geography, sales, sellers

ITEMS, HOT = 60_000, 20_000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Items 0..19999 are one order (4 x 10^8 pairs); seller s0 sells a third of all items."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    items = spark.range(ITEMS).selectExpr(
        f"if(id < {HOT}, 'hot', 'o' || id) as order_id",
        "int(id) as order_item_id",
        "if(id % 2 = 0, 'p0', 'p' || id % 50) as product_id",
        "'s' || id % 3 as seller_id",
        "cast(1 + id % 7 as decimal(12,2)) as price",
        "cast(id % 5 as decimal(12,2)) as freight_value",
    )
    frames = {
        "items": items,
        "orders": items.selectExpr(
            "order_id", "'c' || pmod(hash(order_id), 4) as customer_id", "'delivered' as order_status",
            "timestamp'2017-05-01' as order_purchase_timestamp",
        ).distinct(),
        "customers": spark.range(4).selectExpr(
            "'c' || id as customer_id", "1 as customer_zip_code_prefix", "'rio' as customer_city", "'RJ' as customer_state"
        ),
        "sellers": spark.range(3).selectExpr(
            "'s' || id as seller_id", "int(2 + id % 2) as seller_zip_code_prefix", "'city' || id % 2 as seller_city", "'SP' as seller_state"
        ),
        "geolocation": spark.range(1, 4).selectExpr(
            "int(id) as geolocation_zip_code_prefix", "cast(id as decimal(22,19)) as geolocation_lat",
            "cast(0 as decimal(22,19)) as geolocation_lng",
        ),
        "products": spark.range(50).selectExpr(
            "'p' || id as product_id", "'cat' || id % 4 as product_category_name", "int(100 * id) as product_weight_g"
        ),
    }
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in frames}


@pytest.fixture(params=["10MB", "-1"])
def threshold(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def geo(t):
    return t["orders"], t["items"], t["customers"], t["sellers"], t["geolocation"]


def expected_city(city: int) -> tuple[int, int]:
    """Orders and revenue of one seller city, from the pairs in closed form."""
    own = [k for k in range(ITEMS) if (k % 3) % 2 == city]
    value = {k: 1 + k % 7 + k % 5 for k in own}
    hot = sum(v for k, v in value.items() if k < HOT)
    single = sum(v for k, v in value.items() if k >= HOT)
    return 1 + sum(k >= HOT for k in own), HOT * hot + single


def test_hot_order_costs_no_pairs(skewed, threshold):
    got = {r.seller_city: (r.order_count, int(r.total_revenue)) for r in cities.seller_city_stats(*geo(skewed)).collect()}
    assert got == {f"city{c}": expected_city(c) for c in (0, 1)}
    buyer = cities.buyer_city_stats(*geo(skewed)).first()
    assert buyer.order_count == 1 + ITEMS - HOT
    assert int(buyer.total_spend) == expected_city(0)[1] + expected_city(1)[1]


def test_hot_order_in_city_routes(skewed, threshold):
    got = {r.route: r.order_count for r in geography.top_city_routes(*geo(skewed)).collect()}
    own = {c: sum((k % 3) % 2 == c for k in range(HOT)) for c in (0, 1)}
    rest = {c: sum((k % 3) % 2 == c for k in range(HOT, ITEMS)) for c in (0, 1)}
    # all sellers share one state, so each city's pairs fall in one route
    assert got == {f"city{c} (SP) -> rio (RJ)": own[c] * HOT + rest[c] for c in (0, 1)}


def test_every_item_keeps_its_place(skewed, threshold):
    df = geography.order_geo(*geo(skewed))
    assert df.count() == ITEMS
    assert rows(df.groupBy("distance_km").count().orderBy("distance_km")) == [(111.0, 40_000), (222.0, 20_000)]


def test_hot_product_and_order_in_sales(skewed, threshold):
    total = sum(1 + k % 7 + k % 5 for k in range(ITEMS))
    growth = sales.revenue_growth(skewed["orders"], skewed["items"]).first()
    assert (growth.order_count, int(growth.total_revenue)) == (1 + ITEMS - HOT, total)
    pairs = sellers.weight_freight_pairs(skewed["items"], skewed["products"])
    assert pairs.count() == ITEMS
    assert pairs.agg(F.sum("freight_value")).first()[0] == sum(k % 5 for k in range(ITEMS))
