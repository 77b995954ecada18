import math

import pytest
from conftest import rows

from tradewind.operators import selection as ops

ROUTES = [
    # seller_key, customer_key, order_count, total_revenue, customer_lat
    ("a|x", "b|x", 5, 50.0, 1.0),
    ("a|x", "c|x", 9, 10.0, 2.0),
    ("b|x", "a|x", 7, 70.0, 3.0),
    ("c|x", "a|x", 1, 99.0, 3.0),
    ("c|x", "b|x", 2, 20.0, 1.0),
    ("b|x", "d|x", 4, 40.0, None),
]


@pytest.fixture(scope="module")
def routes(spark):
    rows_ = [
        (s, c, n, v, v / 10, v / 100, lat, lat, c.split("|")[0].upper(), c.split("|")[1]) for s, c, n, v, lat in ROUTES
    ]
    return spark.createDataFrame(
        rows_,
        "seller_key string, customer_key string, order_count long, total_revenue double, avg_distance_km double, "
        "avg_freight double, customer_lat double, customer_lng double, customer_city string, customer_state string",
    )


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(
        [
            ("a|x", "Ána", 1.0, 1.0, 9, 90.0, 1, 10.0),
            ("b|x", "Bana", 1.0, 1.0, 5, 50.0, 0, 0.0),
            ("c|x", "Cana", 0.0, 1.0, 3, 30.0, 3, 30.0),
            ("d|x", "Dana", None, 1.0, 2, 20.0, 3, 30.0),
            ("e|x", "ana", 1.0, 1.0, 0, 0.0, 4, 40.0),
        ],
        "city_key string, city string, lat double, lng double, seller_order_count long, seller_revenue double, "
        "buyer_order_count long, buyer_spend double",
    )


def keys(df):
    return [r[0] for r in df.select("city_key").collect()]


def test_city_search(cities):
    assert keys(ops.city_search(cities, " ANA ")) == ["b|x", "c|x", "d|x", "e|x"]  # accents are not folded
    assert keys(ops.city_search(cities, "ana", n=2)) == ["b|x", "c|x"]
    assert keys(ops.city_search(cities, "  ")) == []


def test_both_metrics(cities):
    got = ops.city_both_metrics(cities).where("city_key = 'a|x'").first()
    assert (got.both_order_count, got.both_gmv) == (10, 100.0)


@pytest.mark.parametrize(
    ("view", "expected"),
    [("seller", {"a|x", "b|x"}), ("buyer", {"a|x", "e|x"}), ("both", {"a|x", "b|x", "e|x"})],
)
def test_cities_in_view(cities, view, expected):
    assert set(keys(ops.cities_in_view(cities, view))) == expected


def test_view_names_are_checked(cities):
    with pytest.raises(ValueError, match="view"):
        ops.cities_in_view(cities, "carrier")


def test_metric_scale_over_positive_values(cities):
    got = {r.city_key: (r.intensity, r.radius) for r in ops.metric_scale(cities, "seller_revenue").collect()}
    assert got["a|x"] == (1.0, 28.0)
    assert got["d|x"] == (0.0, 4.0)
    low, high = math.log1p(20), math.log1p(90)
    assert got["e|x"][0] == pytest.approx(-20 / 70)
    assert got["e|x"][1] == pytest.approx(4 + 24 * (0 - low) / (high - low))


def test_flat_metric_scale(cities):
    flat = ops.metric_scale(cities.selectExpr("city_key", "5 as v"), "v")
    assert {(r.intensity, r.radius) for r in flat.collect()} == {(0.0, 8.0)}


def test_metric_scale_without_positive_values(cities):
    empty = ops.metric_scale(cities.selectExpr("city_key", "0 as v"), "v")
    assert {(r.intensity, r.radius) for r in empty.collect()} == {(0.0, 4.0)}


def test_route_scale(routes):
    got = {(r.seller_key, r.customer_key): (r.weight, r.intensity) for r in ops.route_scale(routes).collect()}
    assert got["a|x", "c|x"] == (7.0, 1.0)
    assert got["c|x", "a|x"] == pytest.approx((1 + 6 / 9, 1 / 9))
    zero = ops.route_scale(routes.selectExpr("seller_key", "0 as v"), "v")
    assert {(r.weight, r.intensity) for r in zero.collect()} == {(1.0, 0.0)}


def test_top_routes(routes):
    assert [r.order_count for r in ops.top_routes(routes, n=3).collect()] == [9, 7, 5]
    assert [r.total_revenue for r in ops.top_routes(routes, "total_revenue", 2).collect()] == [99.0, 70.0]


def matched(df):
    return {(r.match_key, r.seller_key, r.customer_key) for r in df.collect()}


def test_seller_view_matches_sellers_only(routes):
    assert matched(ops.top_routes_per_city(routes, ["A|X"], "seller")) == {("a|x", "a|x", "b|x"), ("a|x", "a|x", "c|x")}


def test_buyer_view_falls_through_to_the_seller(routes):
    assert matched(ops.top_routes_per_city(routes, ["a|x"], "buyer")) == {
        ("a|x", "b|x", "a|x"),
        ("a|x", "c|x", "a|x"),
        ("a|x", "a|x", "b|x"),
        ("a|x", "a|x", "c|x"),
    }


def test_both_view_files_bought_routes_under_their_seller(routes):
    got = ops.top_routes_per_city(routes, ["a|x"], "both", n=1)
    assert matched(got) == {("a|x", "a|x", "c|x"), ("b|x", "b|x", "a|x"), ("c|x", "c|x", "a|x")}


def test_nothing_selected_shows_nothing(routes):
    assert ops.top_routes_per_city(routes, []).count() == 0


def test_cities_on_routes(routes, cities):
    shown = ops.top_routes(routes, n=2)
    assert keys(ops.cities_on_routes(shown, cities, "buyer_order_count")) == ["c|x", "a|x", "b|x"]


def test_route_destinations(routes):
    got = sorted(rows(ops.route_destinations(routes)))
    assert got == [("a|x", "A", "x", 3.0, 3.0), ("b|x", "B", "x", 1.0, 1.0), ("c|x", "C", "x", 2.0, 2.0)]


@pytest.mark.parametrize(
    ("layer", "metric"),
    [
        ("seller_order_count", "order_count"),
        ("buyer_spend", "total_revenue"),
        ("both_gmv", "total_revenue"),
        ("seller_revenue", "total_revenue"),
        ("seller_avg_distance", "avg_distance_km"),
        ("buyer_avg_freight", "avg_freight"),
        ("anything", "order_count"),
    ],
)
def test_layers_name_route_metrics(layer, metric):
    assert ops.route_metric(layer) == metric
