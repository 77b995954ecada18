"""Every operator as a query over the generated tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.checks.testdata import END, MIN_MONTH_ORDERS, START, Roles
from tradewind.functions.distance import planar_distance_km
from tradewind.functions.text import city_key, normalize_city
from tradewind.operators import (
    cities,
    customers,
    geography,
    increments,
    profile,
    quality,
    sales,
    selection,
    sellers,
)
from tradewind.plans.baskets import order_seller_lines
from tradewind.plans.joins import lookup
from tradewind.schema import FOREIGN_KEYS, PRIMARY_KEYS
from tradewind.sources.checkpoints import new_folder, stored
from tradewind.sources.layout import read_bucketed_tables, write_bucketed_tables

Tables = Mapping[str, DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

# Cities chosen in the per-city route queries.
CHOSEN = ["nation_1|america", "nation_2|asia", "nation_8|europe"]

# Declared types of the profiled tables; some are too narrow on purpose.
DECLARED = {
    "customers": {"customer_city": "nvarchar(9)", "customer_state": "varchar(11)", "customer_id": "int"},
    "products": {"product_id": "smallint", "product_weight_g": "tinyint", "product_category_name": "nvarchar(20)"},
    "order_items": {"price": "decimal(12,1)", "seller_id": "int", "order_id": "int"},
    "geolocation": {"geolocation_lat": "decimal(16,4)"},
    "order_payments": {"payment_type": "nvarchar(6)", "payment_installments": "tinyint"},
    "order_reviews": {"review_score": "tinyint", "review_id": "smallint"},
    "orders": {
        "order_id": "int",
        "order_status": "nvarchar(12)",
        "order_purchase_timestamp": "datetime2",
        "order_delivered_customer_date": "datetime2",
        "order_estimated_delivery_date": "datetime2",
    },
}
# The eleven tables of the schema, each with columns that order its rows.
PROFILE_KEYS = {
    "customers": ["customer_id"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"],
    "leads_closed": ["mql_id", "declared_monthly_revenue"],
    "leads_qualified": ["mql_id", "origin"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id"],
    "order_payments": ["order_id", "payment_value"],
    "order_reviews": ["review_row_id"],
    "orders": ["order_id"],
    "product_category_name_translation": ["product_category_name"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
}


# Tables whose profile is also merged from states of their parts.
MERGED = ("order_items", "order_payments", "orders")


def _geo(t: Tables) -> tuple[DataFrame, ...]:
    return t["orders"], t["order_items"], t["customers"], t["sellers"], t["geolocation"]


def _centroids(t: Tables) -> DataFrame:
    return geography.city_centroids(geography.counted_observations(t["sellers"], t["customers"], t["geolocation"]))


def _rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in columns})


def _raw_cities(t: Tables) -> DataFrame:
    raw = t["sellers"].select(F.col("seller_city").alias("city"), F.col("seller_state").alias("state"))
    return raw.union(t["customers"].select("customer_city", "customer_state")).distinct()


def _point_distances(t: Tables) -> DataFrame:
    """How far the points of each zip code lie from its centroid."""
    centers = geography.zip_centroid(t["geolocation"])
    points = t["geolocation"].withColumnRenamed("geolocation_zip_code_prefix", "zip_code_prefix")
    km = planar_distance_km("geolocation_lat", "geolocation_lng", "lat", "lng")
    return (
        lookup(points, centers, "zip_code_prefix", spread=["geolocation_lat", "geolocation_lng"])
        .groupBy("zip_code_prefix")
        .agg(F.round(F.min(km), 6).alias("nearest_km"), F.round(F.max(km), 6).alias("farthest_km"))
    )


def _cities_on_routes(t: Tables) -> DataFrame:
    """Routes and cities from one scan of the items, their order lines being stored."""
    lines = stored(order_seller_lines(*_geo(t)), "order-lines")
    routes = selection.top_routes(cities.trade_routes(*_geo(t), lines=lines), n=10)
    return selection.cities_on_routes(routes, cities.city_activity(*_geo(t), lines=lines))


def _tied_sales(t: Tables) -> DataFrame:
    """One sale of every seller, at prices that three sellers share: a tie reaches over rank 10."""
    sales_of = t["order_items"].where("seller_id >= 0").groupBy("seller_id").agg(F.min("order_id").alias("order_id"))
    return sales_of.withColumn("price", F.expr("cast((seller_id + 2) div 3 as decimal(12,2))"))


def _profile(t: Tables) -> DataFrame:
    return quality.profile_tables({name: t[name] for name in PROFILE_KEYS}, PROFILE_KEYS, DECLARED)


def _month_sums(t: Tables) -> str:
    """A folder with the sums of all months, stored in two loads."""
    folder = new_folder(t["orders"].sparkSession, "month-sums")
    month = increments.month_of("order_purchase_timestamp").alias("month")
    months = sorted(r.month for r in t["orders"].select(month).distinct().collect())  # one row for each month
    for part in (months[::2], months[1::2]):
        increments.store_month_sums(folder, part, *_geo(t))
    return folder


def _stored_routes(t: Tables) -> DataFrame:
    spark = t["orders"].sparkSession
    return increments.stored_trade_routes(spark, _month_sums(t), t["customers"], t["sellers"], t["geolocation"])


def _stored_cities(t: Tables) -> DataFrame:
    spark = t["orders"].sparkSession
    return increments.stored_city_activity(spark, _month_sums(t), t["customers"], t["sellers"], t["geolocation"])


def _bucketed_growth(t: Tables) -> DataFrame:
    """Revenue growth over orders and items in buckets of the order."""
    spark = t["orders"].sparkSession
    folder = new_folder(spark, "order-buckets")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed_tables({name: t[name] for name in ("orders", "order_items")}, "order_id", buckets, folder)
    layout = read_bucketed_tables(spark, folder)
    return sales.revenue_growth(layout["orders"], layout["order_items"], START, END)


def _continued_keys(t: Tables) -> DataFrame:
    """Numbers of review ids after two loads, that of the even rows and that of all."""
    reviews = t["order_reviews"].select("review_row_id", "review_id")
    folder = new_folder(reviews.sparkSession, "review-keys")
    increments.continue_surrogate_key(reviews.where("review_row_id % 2 = 0"), "review_key", ["review_id"], folder, "even")
    return increments.continue_surrogate_key(reviews, "review_key", ["review_id"], folder, "all")


def _merged_profile(t: Tables) -> DataFrame:
    """Profiles from states of two parts of each table, without the estimates."""
    profiles = []
    for name in MERGED:
        folder = new_folder(t[name].sparkSession, f"profile-{name}")
        part = F.pmod(F.xxhash64(*PROFILE_KEYS[name]), F.lit(2))
        for k in (0, 1):
            profile.store_profile_state(t[name].where(part == k), folder, str(k), PROFILE_KEYS[name])
        states = profile.read_profile_states(t[name].sparkSession, folder)
        profiles.append(profile.profile_from_states(states, t[name].schema, name, DECLARED.get(name)))
    return reduce(DataFrame.unionByName, profiles).drop("distinct_count", "sanity_check", *profile.QUANTILES)


def _both_views(t: Tables) -> DataFrame:
    activity = selection.city_both_metrics(cities.city_activity(*_geo(t)))
    return selection.cities_in_view(activity, "both")


OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    # sales
    "table_row_counts": lambda t: sales.table_row_counts({k: v for k, v in t.items() if k != "state_names"}),
    "order_status_span": lambda t: sales.order_status_span(t["orders"], MIN_MONTH_ORDERS),
    "revenue_growth": lambda t: sales.revenue_growth(t["orders"], t["order_items"], START, END),
    "revenue_growth_summary": lambda t: sales.revenue_growth_summary(
        sales.revenue_growth(t["orders"], t["order_items"], START, END)
    ),
    "revenue_growth_bucketed": _bucketed_growth,
    "payment_method_breakdown": lambda t: sales.payment_method_breakdown(t["order_payments"]),
    "avg_order_value_by_state": lambda t: sales.avg_order_value_by_state(
        t["orders"], t["customers"], t["order_items"], t["state_names"]
    ),
    "avg_order_value_by_state_500": lambda t: sales.avg_order_value_by_state(
        t["orders"], t["customers"], t["order_items"], t["state_names"], min_orders=500
    ),
    "avg_order_value_by_state_500_15": lambda t: sales.avg_order_value_by_state(
        t["orders"], t["customers"], t["order_items"], t["state_names"], min_orders=500, top_n=15
    ),
    "avg_order_value_by_state_strict": lambda t: sales.avg_order_value_by_state(
        t["orders"], t["customers"], t["order_items"], t["state_names"], min_orders=1000, top_n=3
    ),
    "avg_order_value_by_state_all": lambda t: sales.avg_order_value_by_state(
        t["orders"], t["customers"], t["order_items"], t["state_names"], min_orders=None, top_n=None
    ),
    "category_revenue": lambda t: sales.category_revenue(
        t["order_items"], t["products"], t["product_category_name_translation"]
    ),
    # customers
    "delivery_status": lambda t: customers.delivery_status(t["orders"]),
    "review_score_distribution": lambda t: customers.review_score_distribution(t["order_reviews"]),
    "repeat_customers_by_month": lambda t: customers.repeat_customers_by_month(t["customers"], t["orders"], START, END),
    "order_status_breakdown": lambda t: customers.order_status_breakdown(t["orders"]),
    # sellers and products
    "top_sellers": lambda t: sellers.top_sellers(t["order_items"]),
    "top_sellers_by_id": lambda t: sellers.top_sellers(t["order_items"], alias=False),
    "top_sellers_ties": lambda t: sellers.top_sellers(_tied_sales(t)),
    "top_categories_by_volume": lambda t: sellers.top_categories_by_volume(
        t["order_items"], t["products"], t["product_category_name_translation"]
    ),
    "lead_conversion": lambda t: sellers.lead_conversion(t["leads_qualified"], t["leads_closed"]),
    "converted_leads_by_origin": lambda t: sellers.converted_leads_by_origin(t["leads_qualified"], t["leads_closed"]),
    "freight_by_weight_bucket": lambda t: sellers.freight_by_weight_bucket(t["order_items"], t["products"]),
    "weight_freight_pairs": lambda t: sellers.weight_freight_pairs(t["order_items"], t["products"]),
    "weight_freight_correlation": lambda t: _rounded(
        sellers.weight_freight_correlation(t["order_items"], t["products"]), ["weight_freight_corr"], 9
    ),
    # coordinates and routes
    "zip_centroid": lambda t: geography.zip_centroid(t["geolocation"]),
    "planar_distance_km": _point_distances,
    "order_geo": lambda t: geography.order_geo(*_geo(t)),
    "top_city_routes": lambda t: geography.top_city_routes(*_geo(t)),
    "top_city_routes_item": lambda t: geography.top_city_routes(*_geo(t), grain="item"),
    "normalize_city": lambda t: _raw_cities(t).select("city", normalize_city(F.col("city")).alias("normalized")).distinct(),
    "city_key": lambda t: _raw_cities(t).select("city", "state", city_key(F.col("city"), F.col("state")).alias("city_key")),
    "city_observations": lambda t: geography.city_observations(t["sellers"], t["customers"], t["geolocation"]),
    "city_centroids": lambda t: _rounded(
        geography.city_centroids(geography.city_observations(t["sellers"], t["customers"], t["geolocation"])),
        ["lat", "lng"],
        6,
    ),
    "centroid_search": lambda t: _rounded(geography.centroid_search(_centroids(t), " NÁTION_1"), ["lat", "lng"], 6),
    "seller_city_stats": lambda t: cities.seller_city_stats(*_geo(t)),
    "seller_city_stats_min300": lambda t: cities.seller_city_stats(*_geo(t), min_orders=300),
    "seller_city_stats_item": lambda t: cities.seller_city_stats(*_geo(t), grain="item"),
    "buyer_city_stats": lambda t: cities.buyer_city_stats(*_geo(t)),
    "buyer_city_stats_min60": lambda t: cities.buyer_city_stats(*_geo(t), min_orders=60),
    "buyer_city_stats_item": lambda t: cities.buyer_city_stats(*_geo(t), grain="item"),
    "merge_city_stats": lambda t: cities.merge_city_stats(
        cities.buyer_city_stats(*_geo(t), min_orders=60), "customer_city", "customer_state", "total_spend"
    ),
    "city_activity": lambda t: cities.city_activity(*_geo(t)),
    "city_activity_item": lambda t: cities.city_activity(*_geo(t), grain="item"),
    "city_activity_merged": lambda t: cities.city_activity(*_geo(t), min_orders=200, threshold="merged"),
    "route_stats": lambda t: cities.route_stats(*_geo(t)),
    "trade_routes": lambda t: cities.trade_routes(*_geo(t)),
    "trade_routes_item": lambda t: cities.trade_routes(*_geo(t), grain="item"),
    # selection
    "city_search": lambda t: selection.city_search(cities.city_activity(*_geo(t)), " Nation_1"),
    "city_both_metrics": lambda t: selection.city_both_metrics(cities.city_activity(*_geo(t))),
    "cities_in_view": lambda t: selection.cities_in_view(cities.city_activity(*_geo(t), min_orders=700), "seller"),
    "metric_scale": lambda t: _rounded(
        selection.metric_scale(_both_views(t), "both_gmv").select("city_key", "both_gmv", "intensity", "radius"),
        ["intensity", "radius"],
        9,
    ),
    "route_scale": lambda t: _rounded(
        selection.route_scale(selection.top_routes(cities.trade_routes(*_geo(t)), "total_revenue"), "total_revenue").select(
            "seller_key", "customer_key", "total_revenue", "weight", "intensity"
        ),
        ["weight", "intensity"],
        9,
    ),
    "stored_trade_routes": _stored_routes,
    "stored_city_activity": _stored_cities,
    "top_routes": lambda t: selection.top_routes(cities.trade_routes(*_geo(t)), "avg_distance_km", 50),
    "top_routes_per_city": lambda t: selection.top_routes_per_city(cities.trade_routes(*_geo(t)), CHOSEN, "seller", n=5),
    "top_routes_per_city_buyer": lambda t: selection.top_routes_per_city(
        cities.trade_routes(*_geo(t)), CHOSEN, "buyer", "avg_freight", 5
    ),
    "top_routes_per_city_both": lambda t: selection.top_routes_per_city(
        cities.trade_routes(*_geo(t)), CHOSEN, "both", "total_revenue", 5
    ),
    "cities_on_routes": _cities_on_routes,
    "route_destinations": lambda t: selection.route_destinations(
        selection.top_routes(cities.trade_routes(*_geo(t)), n=40)
    ),
    # data quality
    "profile_table": _profile,
    "sanity_rules": lambda t: quality.sanity_rules(_profile(t)),
    "profile_from_states": _merged_profile,
    "profile_report": lambda t: quality.profile_report(quality.sanity_rules(_profile(t))),
    "check_primary_key": lambda t: quality.check_primary_key(
        t["order_items"], "order_items", ["order_id", "order_item_id"]
    ),
    "primary_key_violations": lambda t: quality.primary_key_violations(t["order_reviews"], ["review_id"]),
    "check_foreign_key": lambda t: quality.check_foreign_key(
        t["customers"], "customer_zip_code_prefix", t["geolocation"], "geolocation_zip_code_prefix"
    ),
    "check_primary_keys": lambda t: quality.check_primary_keys(t, PRIMARY_KEYS),
    "check_foreign_keys": lambda t: quality.check_foreign_keys(t, FOREIGN_KEYS),
    "zip_coverage": lambda t: quality.zip_coverage(*_geo(t)),
    "continue_surrogate_key": _continued_keys,
    "add_surrogate_key": lambda t: quality.add_surrogate_key(
        t["order_reviews"].drop("review_row_id", "order_id").withColumn("score_text", F.col("review_score").cast("string")),
        "review_key",
        ["review_id", "review_score"],
    ),
}


def queries() -> dict[str, Query]:
    def bound(operator: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: operator(Roles(spark, folder))

    return {name: bound(operator) for name, operator in OPERATORS.items()}
