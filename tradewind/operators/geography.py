"""Coordinates of orders and cities, and city-to-city routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.distance import MILES_PER_KM, planar_distance_km
from tradewind.functions.numbers import MONEY, mean
from tradewind.functions.text import city_key, fold
from tradewind.plans.baskets import (
    GRAINS,
    ORDER_SUMS,
    destinations,
    order_seller_lines,
    placed_sellers,
    zip_centroid,
)
from tradewind.plans.joins import lookup

__all__ = [
    "centroid_search",
    "city_centroids",
    "city_observations",
    "counted_observations",
    "order_geo",
    "top_city_routes",
    "zip_centroid",
]


def order_geo(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
) -> DataFrame:
    """One row per order item whose customer and seller zip codes have a centroid.

    Besides the coordinates and the distance it carries seller_id, price and both
    cities, so item-grain statistics need no second join to the items.
    """
    shops = placed_sellers(sellers, geolocation).where("seller_placed").drop("seller_placed")
    sold = items.select("order_id", "order_item_id", "seller_id", "price", "freight_value")
    return (
        lookup(sold, shops, "seller_id", spread=["order_id", "order_item_id"], sized_by=sellers)
        .join(destinations(orders, customers, geolocation), "order_id")
        .select(
            "order_id",
            "order_status",
            "seller_id",
            "price",
            "freight_value",
            "customer_city",
            "customer_state",
            "customer_lat",
            "customer_lng",
            "seller_city",
            "seller_state",
            "seller_lat",
            "seller_lng",
            planar_distance_km("customer_lat", "customer_lng", "seller_lat", "seller_lng").alias("distance_km"),
        )
    )


def top_city_routes(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    n: int = 10,
    grain: str = "pair",
) -> DataFrame:
    """Busiest seller-city to customer-city routes of delivered orders.

    ``grain="pair"`` reproduces the published figures, in which every located item of
    an order meets every item of it: the route's seller city belongs to one item and
    the seller state, distance and freight to the other. Here the order's items are
    summed per seller city on one side and per seller state on the other, and only
    those sums meet. ``grain="item"`` counts each item once, with its own seller.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    lines = order_seller_lines(orders, items, customers, sellers, geolocation)
    if grain == "item":
        combined = lines.where("placed").selectExpr(
            "seller_city",
            "seller_state",
            "customer_city",
            "customer_state",
            "items as pairs",
            "distance_km * items as distance",
            "if(distance_km is null, 0, items) as distance_n",
            "freight",
            "freight_n",
        )
    else:
        by_state = (
            lines.groupBy("order_id", "customer_city", "customer_state", "seller_state")
            .agg(*[F.expr(total).alias(name) for name, total in ORDER_SUMS.items()])
            .where("g > 0")
        )
        by_city = (
            lines.where("seller_known").groupBy("order_id", "seller_city").agg(F.sum("items").alias("items"))
        )
        combined = by_state.join(by_city, "order_id").selectExpr(
            "seller_city",
            "seller_state",
            "customer_city",
            "customer_state",
            "items * g as pairs",
            "items * d as distance",
            "items * dn as distance_n",
            "items * f as freight",
            "items * fn as freight_n",
        )
    km = mean(F.sum("distance"), F.sum("distance_n"))
    return (
        combined.groupBy("seller_city", "seller_state", "customer_city", "customer_state")
        .agg(
            F.sum("pairs").alias("order_count"),
            km.cast("decimal(10,1)").alias("avg_distance_km"),
            (km * MILES_PER_KM).cast("decimal(10,1)").alias("avg_distance_mi"),
            mean(F.sum("freight"), F.sum("freight_n")).cast(MONEY).alias("avg_freight_value"),
        )
        .orderBy(F.desc("order_count"), "seller_city", "seller_state", "customer_city", "customer_state")
        .limit(n)
        .select(
            F.concat(
                "seller_city",
                F.lit(" ("),
                "seller_state",
                F.lit(") -> "),
                "customer_city",
                F.lit(" ("),
                "customer_state",
                F.lit(")"),
            ).alias("route"),
            "order_count",
            "avg_distance_km",
            "avg_distance_mi",
            "avg_freight_value",
        )
    )


def _people(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        F.col(f"{side}_zip_code_prefix").alias("zip_code_prefix"),
        F.col(f"{side}_city").alias("city"),
        F.col(f"{side}_state").alias("state"),
        F.col(f"{side}_id").alias("id"),
    )


def _coordinates(geolocation: DataFrame) -> DataFrame:
    return zip_centroid(geolocation).where(F.col("lat").isNotNull() & F.col("lng").isNotNull())


def city_observations(sellers: DataFrame, customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """City, state and zip-code coordinates of every seller and every customer."""
    places = _coordinates(geolocation)
    shops = lookup(_people(sellers, "seller"), places, "zip_code_prefix", spread=["id"])
    people = lookup(_people(customers, "customer"), places, "zip_code_prefix", spread=["id"])
    columns = ["city", "state", "lat", "lng"]
    return shops.select(columns).unionByName(people.select(columns))


def counted_observations(sellers: DataFrame, customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """The same observations with equal ones counted before the zip-code join (column ``observed``)."""
    both = _people(sellers, "seller").drop("id").unionByName(_people(customers, "customer").drop("id"))
    counted = both.groupBy("zip_code_prefix", "city", "state").agg(F.count(F.lit(1)).alias("observed"))
    return counted.join(_coordinates(geolocation), "zip_code_prefix").select(
        "city", "state", "lat", "lng", "observed"
    )


def key_of_group(name: str, key: str) -> Column:
    """The key of a merged group as an aggregate of it.

    A choice of keys then stays above the merge, where a key is folded once for each raw spelling.
    A choice by the grouping column itself would be pushed below all sums and fold names row by row.
    """
    return F.max(key).alias(name)


def city_centroids(observations: DataFrame) -> DataFrame:
    """Mean coordinates per city key over all observations of all its spellings.

    The city and state shown are those of the most frequent non-empty spelling.
    Takes either form of observations; spellings are folded after they are counted.
    Observations without both coordinates do not count.
    """
    observations = observations.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    observed = F.col("observed") if "observed" in observations.columns else F.lit(1)
    spellings = observations.groupBy("city", "state").agg(
        F.sum(F.col("lat").cast("double") * observed).alias("lat_sum"),
        F.sum(F.col("lng").cast("double") * observed).alias("lng_sum"),
        F.sum(observed).alias("observed"),
    )
    empty = F.coalesce(F.col("city"), F.lit("")) == ""
    return (
        spellings.withColumn("_key", city_key(F.col("city"), F.col("state")))
        .groupBy("_key")
        .agg(
            key_of_group("city_key", "_key"),
            (F.sum("lat_sum") / F.sum("observed")).alias("lat"),
            (F.sum("lng_sum") / F.sum("observed")).alias("lng"),
            F.min_by(F.struct("city", "state"), F.struct(empty, -F.col("observed"), "city", "state")).alias("shown"),
        )
        .select("city_key", "shown.city", "shown.state", "lat", "lng")
    )


def centroid_search(centroids: DataFrame, text: str) -> DataFrame:
    """Centroids whose key contains the folded text."""
    return centroids.where(F.col("city_key").contains(fold(text)))
