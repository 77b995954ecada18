"""Choosing and scaling cities and routes for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


VIEWS = ("seller", "buyer", "both")
METRICS = ("order_count", "total_revenue", "avg_distance_km", "avg_freight")


def _check_view(view: str) -> None:
    if view not in VIEWS:
        raise ValueError(f"view must be one of {VIEWS}, not {view!r}")


def route_metric(layer: str) -> str:
    """Route column by which a city layer sorts its routes."""
    words = {
        "order_count": "order_count",
        "revenue": "total_revenue",
        "spend": "total_revenue",
        "gmv": "total_revenue",
        "distance": "avg_distance_km",
        "freight": "avg_freight",
    }
    return next((metric for word, metric in words.items() if word in layer), "order_count")


def _value(metric: str) -> Column:
    return F.coalesce(F.col(metric), F.lit(0))


def city_search(cities: DataFrame, text: str, n: int = 8) -> DataFrame:
    """First ``n`` cities, busiest seller first, whose name contains the text; blank text finds none."""
    wanted = text.strip().lower()
    found = F.lower("city").contains(wanted) if wanted else F.lit(False)
    return cities.where(found).orderBy(F.desc("seller_order_count"), "city_key").limit(n)


def city_both_metrics(cities: DataFrame) -> DataFrame:
    """Adds the order count and value of both sides together."""
    return cities.withColumns(
        {
            "both_order_count": _value("seller_order_count") + _value("buyer_order_count"),
            "both_gmv": _value("seller_revenue") + _value("buyer_spend"),
        }
    )


def cities_in_view(cities: DataFrame, view: str = "seller") -> DataFrame:
    """Cities with coordinates and with orders on the viewed side."""
    _check_view(view)
    # a coordinate of exactly 0 counts as missing
    shown = (_value("lat") != 0) & (_value("lng") != 0)
    if view != "both":
        orders = F.col(f"{view}_order_count")
        shown = shown & (orders.isNull() | (orders != 0))
    return cities.where(shown)


def metric_scale(cities: DataFrame, metric: str) -> DataFrame:
    """Adds the colour intensity (linear) and marker radius (logarithmic, 4 to 28) of a metric.

    The range is that of the positive values; with a single value the intensity is 0
    and the radius 8. A zero value falls below the range, as published. The cities are
    read twice, for the range and for the result: pass a stored table when they are
    costly to compute.
    """
    value = _value(metric).cast("double")
    extent = (
        cities.where(value > 0)
        .agg(
            F.struct(
                F.coalesce(F.min(value), F.lit(0.0)).alias("low"), F.coalesce(F.max(value), F.lit(1.0)).alias("high")
            ).alias("extent")
        )
        .scalar()
    )
    low, high = F.col("_extent.low"), F.col("_extent.high")
    logarithmic = (F.log1p(value) - F.log1p(low)) / (F.log1p(high) - F.log1p(low))
    # the subquery is one column of its own, so it is planned once however often it is used
    return (
        cities.withColumn("_extent", extent)
        .withColumns(
            {
                "intensity": F.when(high > low, (value - low) / (high - low)).otherwise(0.0),
                "radius": F.when(high > low, 4 + logarithmic * 24).otherwise(8.0),
            }
        )
        .drop("_extent")
    )


def route_scale(routes: DataFrame, metric: str = "order_count") -> DataFrame:
    """Adds the line weight (1 to 7) and colour intensity of each route relative to the largest."""
    value, largest = _value(metric).cast("double"), F.col("_largest")
    return (
        routes.withColumn("_largest", routes.agg(F.max(value).alias("largest")).scalar())
        .withColumn("intensity", F.when(largest > 0, value / largest).otherwise(0.0))
        .withColumn("weight", 1 + F.least(F.col("intensity") * 6, F.lit(6.0)))
        .drop("_largest")
    )


def top_routes(routes: DataFrame, metric: str = "order_count", n: int = 50) -> DataFrame:
    """The ``n`` largest routes by a metric."""
    return routes.orderBy(_value(metric).desc(), "seller_key", "customer_key").limit(n)


def top_routes_per_city(
    routes: DataFrame,
    keys: list[str],
    view: str = "seller",
    metric: str = "order_count",
    n: int = 50,
) -> DataFrame:
    """The ``n`` largest routes of each selected city, in column ``match_key``.

    A route belongs to its customer city in the buyer view and otherwise to its
    seller city. As published, the buyer view falls back to the seller city when only
    that one is selected, and the view of both sides files a route under its seller
    city even when only the customer city is selected.
    """
    _check_view(view)
    chosen = [key.lower() for key in keys]
    sold, bought = F.col("seller_key").isin(chosen), F.col("customer_key").isin(chosen)
    match = F.when(sold, F.col("seller_key"))
    if view == "buyer":
        match = F.when(bought, F.col("customer_key")).when(sold, F.col("seller_key"))
    elif view == "both":
        match = F.when(sold | bought, F.col("seller_key"))
    largest = Window.partitionBy("match_key").orderBy(_value(metric).desc(), "seller_key", "customer_key")
    return (
        routes.withColumn("match_key", match)
        .where(F.col("match_key").isNotNull())
        .withColumn("place", F.row_number().over(largest))
        .where(F.col("place") <= n)
        .drop("place")
    )


def cities_on_routes(routes: DataFrame, cities: DataFrame, metric: str = "seller_order_count") -> DataFrame:
    """Cities at either end of the routes, largest metric first."""
    touched = routes.select(F.col("seller_key").alias("city_key")).union(routes.select("customer_key")).distinct()
    return cities.join(touched, "city_key", "left_semi").orderBy(_value(metric).desc(), "city_key")


def route_destinations(routes: DataFrame, metric: str = "order_count") -> DataFrame:
    """Each customer city of the routes once, as its largest route names it."""
    names = ["customer_lat", "customer_lng", "customer_city", "customer_state"]
    placed = (_value("customer_lat") != 0) & (_value("customer_lng") != 0)
    return (
        routes.where(placed)
        .groupBy("customer_key")
        .agg(F.min_by(F.struct(*names), F.struct(-_value(metric), "seller_key")).alias("first"))
        .select(
            F.col("customer_key").alias("key"),
            F.col("first.customer_city").alias("city"),
            F.col("first.customer_state").alias("state"),
            F.col("first.customer_lat").alias("lat"),
            F.col("first.customer_lng").alias("lng"),
        )
    )
