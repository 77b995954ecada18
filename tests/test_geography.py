import random
from decimal import Decimal as D

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_sales import item, order

from tradewind.functions.text import city_key, fold, normalize_city
from tradewind.operators import cities as city_ops
from tradewind.operators import geography as geo
from tradewind.plans.joins import fits_broadcast
from tradewind.sources.files import read_parquet_tables


@pytest.fixture
def two_sellers(table):
    """One order of two items by sellers in different states."""
    return (
        table("orders", [order("o", "2017-01-01 00:00:00")]),
        table("order_items", [item("o", 10, 1, 1, seller="s1"), item("o", 20, 3, 2, seller="s2")]),
        table("customers", [{"customer_id": "c1", "customer_zip_code_prefix": 1, "customer_city": "rio", "customer_state": "RJ"}]),
        table(
            "sellers",
            [
                {"seller_id": "s1", "seller_zip_code_prefix": 2, "seller_city": "campinas", "seller_state": "SP"},
                {"seller_id": "s2", "seller_zip_code_prefix": 3, "seller_city": "belem", "seller_state": "PA"},
            ],
        ),
        table(
            "geolocation",
            [
                {"geolocation_zip_code_prefix": z, "geolocation_lat": lat, "geolocation_lng": lng}
                for z, lat, lng in [(1, 0, 0), (2, 1, 0), (2, 3, 0), (3, 0, 4), (9, 7, 7)]
            ],
        ),
    )


def test_zip_centroid_averages_points(two_sellers):
    got = {row[0]: row[1:] for row in rows(geo.zip_centroid(two_sellers[-1]))}
    assert got == {1: (0.0, 0.0), 2: (2.0, 0.0), 3: (0.0, 4.0), 9: (7.0, 7.0)}


def test_order_geo_has_one_row_per_item(two_sellers):
    got = geo.order_geo(*two_sellers)
    assert sorted((r.seller_city, r.freight_value, r.distance_km) for r in got.collect()) == [
        ("belem", D("3.00"), 444.0),
        ("campinas", D("1.00"), 222.0),
    ]


def test_fan_out_of_the_published_figures(two_sellers):
    # each item meets both items: four pairs, the seller city of one with the state of the other
    got = {row[0]: row[1:] for row in rows(geo.top_city_routes(*two_sellers))}
    assert got == {
        "campinas (SP) -> rio (RJ)": (1, D("222.0"), D("138.0"), D("1.00")),
        "campinas (PA) -> rio (RJ)": (1, D("444.0"), D("275.9"), D("3.00")),
        "belem (SP) -> rio (RJ)": (1, D("222.0"), D("138.0"), D("1.00")),
        "belem (PA) -> rio (RJ)": (1, D("444.0"), D("275.9"), D("3.00")),
    }
    once = {row[0]: row[1:] for row in rows(geo.top_city_routes(*two_sellers, grain="item"))}
    assert once == {
        "campinas (SP) -> rio (RJ)": (1, D("222.0"), D("138.0"), D("1.00")),
        "belem (PA) -> rio (RJ)": (1, D("444.0"), D("275.9"), D("3.00")),
    }


def test_city_figures_in_both_grains(two_sellers):
    buyer = rows(city_ops.buyer_city_stats(*two_sellers, min_orders=1))
    assert buyer == [("rio", "RJ", 1, D("68.00"), D("2.00"), D("333.00"))]
    buyer_once = rows(city_ops.buyer_city_stats(*two_sellers, min_orders=1, grain="item"))
    assert buyer_once == [("rio", "RJ", 1, D("34.00"), D("2.00"), D("333.00"))]
    with pytest.raises(ValueError, match="grain"):
        city_ops.buyer_city_stats(*two_sellers, grain="order")


def random_marketplace(seed: int):
    """Small tables with unlocated zips, unknown sellers, hot orders and missing freight."""
    rng = random.Random(seed)
    customers = [
        {"customer_id": f"c{k}", "customer_zip_code_prefix": rng.randrange(6), "customer_city": rng.choice(["rio", "Rio ", "lins"]), "customer_state": rng.choice(["RJ", "SP"])}
        for k in range(12)
    ]
    sellers = [
        {"seller_id": f"s{k}", "seller_zip_code_prefix": rng.randrange(6), "seller_city": rng.choice(["bauru", "BAURU", "lins"]), "seller_state": rng.choice(["SP", "PA"])}
        for k in range(8)
    ]
    points = [
        {"geolocation_zip_code_prefix": z, "geolocation_lat": round(rng.uniform(-9, 9), 3), "geolocation_lng": round(rng.uniform(-9, 9), 3)}
        for z in range(4)
        for _ in range(2)
    ]
    orders = [order(f"o{k}", None, rng.choice(["delivered", "delivered", "shipped"]), f"c{rng.randrange(13)}") for k in range(40)]
    items = []
    for k in range(40):
        for number in range(30 if k == 0 else rng.randrange(5)):
            freight = rng.choice([None, round(rng.uniform(1, 9), 2)])
            items.append(item(f"o{k}", round(rng.uniform(1, 99), 2), freight, number, seller=f"s{rng.randrange(9)}"))
    return orders, items, customers, sellers, points


def brute_force_pairs(data) -> pd.DataFrame:
    """Every located item of a delivered order with every item of that order."""
    orders, items, customers, sellers, points = (pd.DataFrame(rows) for rows in data)
    points = points.groupby("geolocation_zip_code_prefix").mean().reset_index()
    side = {}
    for name in ("customer", "seller"):
        side[name] = points.rename(
            columns={"geolocation_zip_code_prefix": f"{name}_zip_code_prefix", "geolocation_lat": f"{name}_lat", "geolocation_lng": f"{name}_lng"}
        )
    located = (
        orders[orders.order_status == "delivered"]
        .merge(items, on="order_id")
        .merge(customers, on="customer_id")
        .merge(sellers, on="seller_id")
        .merge(side["customer"], on="customer_zip_code_prefix")
        .merge(side["seller"], on="seller_zip_code_prefix")
    )
    located["km"] = 111 * ((located.customer_lat - located.seller_lat) ** 2 + (located.customer_lng - located.seller_lng) ** 2) ** 0.5
    located = located[["order_id", "customer_city", "customer_state", "seller_state", "km", "freight_value"]].rename(
        columns={"seller_state": "other_state", "freight_value": "other_freight"}
    )
    pairs = located.merge(items, on="order_id").merge(sellers, on="seller_id", how="left")
    pairs["value"] = pairs.price + pairs.freight_value.astype(float)
    pairs["seller_placed"] = pairs.seller_zip_code_prefix.isin(set(points.geolocation_zip_code_prefix))
    return pairs


def summed(pairs: pd.DataFrame, names: list[str], freight: str) -> dict:
    out = {}
    for key, group in pairs.groupby(names):
        out[key] = (
            group.order_id.nunique(),
            round(group.value.sum(), 2),
            group[freight].astype(float).mean(),
            group.km.mean(),
        )
    return out


def agree(got: dict, expected: dict):
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        have = got[key]
        assert have[0] == want[0]
        assert float(have[1] or 0) == pytest.approx(want[1])
        for h, w in zip(have[2:], want[2:], strict=True):
            assert (h is None and pd.isna(w)) or float(h) == pytest.approx(w, abs=0.00501)


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("seed", [1, 2])
def test_products_of_sums_equal_all_pairs(spark, table, tmp_path, seed, threshold):
    """Both lookup plans, broadcast and salted, against every pair spelled out."""
    data = random_marketplace(seed)
    names = ["orders", "order_items", "customers", "sellers", "geolocation"]
    for name, part in zip(names, data, strict=True):
        table(name, part).write.parquet(f"{tmp_path}/{name}.parquet")
    tables = list(read_parquet_tables(spark, str(tmp_path), names).values())
    pairs = brute_force_pairs(data)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert fits_broadcast(geo.zip_centroid(tables[-1])) == (threshold != "-1")
    try:
        sellers = city_ops.seller_city_stats(*tables, min_orders=1)
        agree({tuple(r[:2]): r[2:] for r in rows(sellers)}, summed(pairs[pairs.seller_placed], ["seller_city", "seller_state"], "freight_value"))
        buyers = city_ops.buyer_city_stats(*tables, min_orders=1)
        agree({tuple(r[:2]): r[2:] for r in rows(buyers)}, summed(pairs, ["customer_city", "customer_state"], "freight_value"))
        routes = city_ops.route_stats(*tables)
        keys = ["seller_city", "seller_state", "customer_city", "customer_state"]
        agree({tuple(r[:4]): r[4:] for r in rows(routes)}, summed(pairs.dropna(subset=["seller_city"]), keys, "other_freight"))
        top = geo.top_city_routes(*tables, n=1000)
        expected = pairs.groupby(["seller_city", "other_state", "customer_city", "customer_state"]).size()
        labels = {f"{a} ({b}) -> {c} ({d})": n for (a, b, c, d), n in expected.items()}
        assert {r[0]: r[1] for r in rows(top)} == labels
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_city_spellings(spark):
    names = ["São Paulo", "SAO PAULO", " sao paulo ", "são paulo", "sao  paulo", " Sao Paulo\t", "ﬁm½", "Ḗ한", "", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, city string")
    got = [r[1] for r in df.select("k", normalize_city(F.col("city"))).orderBy("k").collect()]
    assert got == ["sao paulo"] * 4 + ["sao  paulo", "sao paulo", "fim1⁄2", "e한", "", ""]
    assert got == [fold(n) for n in names]


def test_city_key_keeps_state_accents(spark):
    df = spark.createDataFrame([("Belém", " PÁ "), (None, None)], "city string, state string")
    assert [r[0] for r in df.select(city_key(F.col("city"), F.col("state"))).collect()] == ["belem|pá", "|"]


def test_centroids_merge_spellings(spark):
    seen = spark.createDataFrame(
        [("São Paulo", "SP", 1.0, 2.0), ("sao paulo", "SP", 3.0, 4.0), ("sao paulo", "SP ", 5.0, 6.0), ("sao paulo", "SP", 7.0, 8.0), ("", "RJ", 1.0, 1.0)],
        "city string, state string, lat double, lng double",
    )
    got = {r[0]: r[1:] for r in rows(geo.city_centroids(seen))}
    assert got == {"sao paulo|sp": ("sao paulo", "SP", 4.0, 5.0), "|rj": ("", "RJ", 1.0, 1.0)}


def test_observations_are_per_person_and_counted_ones_agree(two_sellers):
    _, _, customers, sellers, points = two_sellers
    single = geo.city_observations(sellers, customers, points)
    assert single.count() == 3
    counted = geo.counted_observations(sellers, customers, points)
    assert sorted(rows(geo.city_centroids(single))) == sorted(rows(geo.city_centroids(counted)))


def test_centroid_search_folds_the_text(spark):
    centroids = spark.createDataFrame([("sao paulo|sp",), ("rio|rj",)], "city_key string")
    assert rows(geo.centroid_search(centroids, " SÃO")) == [("sao paulo|sp",)]
    assert geo.centroid_search(centroids, "").count() == 2
