"""The (order, seller) grain under the geographic statistics.

The published route and city figures join every located item of an order to every
item of the same order. Nothing here builds those pairs. Items collapse to one row
per (order, seller) or a few; with

    g  located items of the order       d  their summed distance (dn of them known)
    f  their summed freight (fn known)

an item that takes part contributes g pairs, d to the distance sum and f to the
freight sum, so every pair statistic is a product of sums taken per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.distance import planar_distance_km
from tradewind.plans.joins import lookup

GRAINS = ("pair", "item")

# What a line adds to the sums of its order.
ORDER_SUMS = {
    "g": "sum(if(placed, items, 0))",
    "d": "sum(if(placed, distance_km * items, 0D))",
    "dn": "sum(if(placed and distance_km is not null, items, 0))",
    "f": "sum(if(placed, freight, null))",
    "fn": "sum(if(placed, freight_n, 0))",
}

# What a line adds to the sums of its city or route. With pairs, its value and freight count
# once per located item of the order, and the order's distances once per item of the line.
LINE_PARTS = {
    "pair": {
        "value": "value * g",
        "freight": "freight * g",
        "freight_n": "freight_n * g",
        "distance": "d * items",
        "distance_n": "dn * items",
    },
    "item": {
        "value": "value",
        "freight": "freight",
        "freight_n": "freight_n",
        "distance": "distance_km * items",
        "distance_n": "if(distance_km is null, 0, items)",
    },
}
# Routes average the freight of the order's located items instead of the line's own.
ROUTE_PARTS = {
    "pair": LINE_PARTS["pair"] | {"freight": "f * items", "freight_n": "fn * items"},
    "item": LINE_PARTS["item"],
}


def zip_centroid(geolocation: DataFrame) -> DataFrame:
    """One mean coordinate per zip code prefix."""
    return geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix")).agg(
        F.expr("double(sum(geolocation_lat)) / nullif(count(geolocation_lat), 0) as lat"),
        F.expr("double(sum(geolocation_lng)) / nullif(count(geolocation_lng), 0) as lng"),
    )


def located_customers(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """Customers whose zip code has a centroid, with its coordinates."""
    places = zip_centroid(geolocation).selectExpr(
        "zip_code_prefix as customer_zip_code_prefix", "lat as customer_lat", "lng as customer_lng"
    )
    people = customers.select("customer_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    return lookup(people, places, "customer_zip_code_prefix", spread=["customer_id"]).drop("customer_zip_code_prefix")


def placed_sellers(sellers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """All sellers; ``seller_placed`` tells whether the zip code has a centroid."""
    places = zip_centroid(geolocation).selectExpr(
        "zip_code_prefix as seller_zip_code_prefix",
        "lat as seller_lat",
        "lng as seller_lng",
        "true as has_centroid",
    )
    shops = sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    return lookup(shops, places, "seller_zip_code_prefix", spread=["seller_id"], how="left").selectExpr(
        "seller_id",
        "seller_city",
        "seller_state",
        "seller_lat",
        "seller_lng",
        "coalesce(has_centroid, false) as seller_placed",
    )


def destinations(
    orders: DataFrame, customers: DataFrame, geolocation: DataFrame, status: str | None = None
) -> DataFrame:
    """Orders with the city and coordinates of their customer; unlocated customers drop out."""
    chosen = orders if status is None else orders.where(F.col("order_status") == status)
    return (
        chosen.select("order_id", "order_status", "customer_id")
        .join(located_customers(customers, geolocation), "customer_id")
        .drop("customer_id")
    )


def order_seller_lines(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    status: str = "delivered",
) -> DataFrame:
    """Items of the chosen orders collapsed per (order, seller), sellers missing from the table included.

    Items collapse per (order, seller) first, summed before they are shuffled by both
    columns, so neither a hot seller nor a hot order lands in one task. Only collapsed
    lines look their seller up. The result is partitioned by order, so per-order sums and
    counts need no further shuffle.
    """
    sold = items.selectExpr(
        "order_id", "seller_id", "price + freight_value as value", "freight_value as freight"
    )
    shops = placed_sellers(sellers, geolocation).selectExpr("*", "true as in_table")
    collapsed = sold.groupBy("order_id", "seller_id").agg(
        F.expr("count(1) as items"),
        F.expr("cast(sum(value) as decimal(18,2)) as value"),
        F.expr("cast(sum(freight) as decimal(18,2)) as freight"),
        F.expr("count(freight) as freight_n"),
    )
    placed = lookup(
        collapsed, shops, "seller_id", spread=["order_id"], how="left", sized_by=sellers, counted=items
    )
    return (
        placed.join(destinations(orders, customers, geolocation, status), "order_id")
        .withColumn("distance_km", planar_distance_km("customer_lat", "customer_lng", "seller_lat", "seller_lng"))
        .selectExpr(
            "order_id",
            "items",
            "value",
            "freight",
            "freight_n",
            "distance_km",
            "seller_city",
            "seller_state",
            "customer_city",
            "customer_state",
            "coalesce(in_table, false) as seller_known",
            "coalesce(seller_placed, false) as placed",
            "seller_lat is not null as seller_located",
            "customer_lat is not null as customer_located",
        )
    )


def with_order_sums(lines: DataFrame) -> DataFrame:
    """Lines with their order's g, d, dn, f and fn, for orders with a located item."""
    sums = [f"{total} over (partition by order_id) as {name}" for name, total in ORDER_SUMS.items()]
    return lines.selectExpr("*", *sums).where("g > 0")


def weighted_lines(lines: DataFrame, grain: str, parts: dict[str, dict[str, str]]) -> DataFrame:
    """Lines with what they add to their groups, under the given grain."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    ready = with_order_sums(lines) if grain == "pair" else lines.where("placed")
    kept = [
        "order_id",
        "seller_city",
        "seller_state",
        "customer_city",
        "customer_state",
        "seller_known",
        "placed",
        "seller_located",
        "customer_located",
    ]
    return ready.selectExpr(*kept, *[f"{part} as {name}" for name, part in parts[grain].items()])
