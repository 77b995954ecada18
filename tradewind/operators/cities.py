"""Trade statistics per city and per route, merged over spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.text import city_key
from tradewind.operators.geography import city_centroids, counted_observations, key_of_group
from tradewind.plans.baskets import LINE_PARTS, ROUTE_PARTS, order_seller_lines, weighted_lines

THRESHOLDS = ("raw", "merged")
ROUTE = ["seller_city", "seller_state", "customer_city", "customer_state"]

# Lines that count for a side of the trade.
_TAKES_PART = {"seller": "placed and seller_located", "customer": "customer_located"}


# What a group of orders adds up to; sums of disjoint sets of orders add up in turn.
SUMS = ("order_count", "value", "freight", "freight_n", "distance", "distance_n")


def group_sums(lines: DataFrame, names: list[str]) -> DataFrame:
    """Distinct orders and sums per group of names.

    The first aggregate runs on the partitioning by order that the lines already
    have; after it a row is one distinct order of the group.
    """
    per_order = lines.groupBy("order_id", *names).agg(*[F.sum(part).alias(part) for part in SUMS[1:]])
    return per_order.groupBy(*names).agg(
        F.count(F.lit(1)).alias("order_count"), *[F.sum(part).alias(part) for part in SUMS[1:]]
    )


def averaged(sums: DataFrame, names: list[str], revenue: str, min_orders: int) -> DataFrame:
    """Group sums as the published statistics, of groups with enough orders."""
    return sums.where(F.col("order_count") >= min_orders).selectExpr(
        *names,
        "order_count",
        f"cast(value as decimal(20,2)) as {revenue}",
        "cast(double(freight) / nullif(freight_n, 0) as decimal(12,2)) as avg_freight",
        "cast(distance / nullif(distance_n, 0) as decimal(12,2)) as avg_distance_km",
    )


def _statistics(lines: DataFrame, names: list[str], revenue: str, min_orders: int) -> DataFrame:
    return averaged(group_sums(lines, names), names, revenue, min_orders)


def seller_city_stats(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 5,
    grain: str = "pair",
) -> DataFrame:
    """Delivered orders, revenue, mean freight and distance per raw seller city."""
    lines = order_seller_lines(orders, items, customers, sellers, geolocation)
    chosen = weighted_lines(lines, grain, LINE_PARTS).where(_TAKES_PART["seller"])
    return _statistics(chosen, ["seller_city", "seller_state"], "total_revenue", min_orders)


def buyer_city_stats(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 5,
    grain: str = "pair",
) -> DataFrame:
    """Delivered orders, spend, mean freight and distance per raw customer city."""
    lines = order_seller_lines(orders, items, customers, sellers, geolocation)
    chosen = weighted_lines(lines, grain, LINE_PARTS).where(_TAKES_PART["customer"])
    return _statistics(chosen, ["customer_city", "customer_state"], "total_spend", min_orders)


def route_stats(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 1,
    grain: str = "pair",
    lines: DataFrame | None = None,
) -> DataFrame:
    """Delivered orders, mean distance and freight and revenue per raw pair of cities."""
    if lines is None:
        lines = order_seller_lines(orders, items, customers, sellers, geolocation)
    return averaged(group_sums(route_lines(lines, grain), ROUTE), ROUTE, "total_revenue", min_orders)


def _merged_sums(revenue: str) -> list[Column]:
    return [
        F.expr("sum(order_count) as orders"),
        F.expr(f"cast(coalesce(sum({revenue}), 0) as decimal(20,2)) as revenue"),
        F.expr("sum(coalesce(avg_freight, 0) * order_count) as freight_sum"),
        F.expr("sum(coalesce(avg_distance_km, 0) * order_count) as distance_sum"),
    ]


def _weighted(total: str) -> Column:
    return F.expr(f"cast(double({total}) / nullif(orders, 0) as decimal(12,2))")


def _shown(names: list[str]) -> Column:
    """The spelling with most orders, a non-empty city first, as an aggregate."""
    listed = ", ".join(names)
    return F.expr(
        f"min_by(struct({listed}), struct(coalesce({names[0]}, '') = '', -order_count, {listed})) as shown"
    )


def merge_city_stats(
    stats: DataFrame, city: str, state: str, revenue: str, min_orders: int | None = None
) -> DataFrame:
    """Raw spellings merged to their city key; averages weighted by the order count.

    The city and state shown are those of the non-empty spelling with most orders.
    """
    merged = (
        stats.withColumn("_key", city_key(F.col(city), F.col(state)))
        .groupBy("_key")
        .agg(key_of_group("city_key", "_key"), *_merged_sums(revenue), _shown([city, state]))
        .select(
            "city_key",
            F.col("shown")[city].alias("city"),
            F.col("shown")[state].alias("state"),
            F.col("orders").alias("order_count"),
            "revenue",
            _weighted("freight_sum").alias("avg_freight"),
            _weighted("distance_sum").alias("avg_distance"),
        )
    )
    return merged if min_orders is None else merged.where(F.col("order_count") >= min_orders)


CITY = ["side", "city", "state"]


def side_lines(lines: DataFrame, grain: str = "pair") -> DataFrame:
    """What every line adds to its seller's and its buyer's raw city, told apart by ``side``."""
    sides = ", ".join(
        f"struct('{side}' as side, {side}_city as city, {side}_state as state, {takes_part} as takes_part)"
        for side, takes_part in _TAKES_PART.items()
    )
    return (
        weighted_lines(lines, grain, LINE_PARTS)
        .selectExpr(
            "order_id", "value", "freight", "freight_n", "distance", "distance_n", f"inline(array({sides}))"
        )
        .where("takes_part")
    )


def route_lines(lines: DataFrame, grain: str = "pair") -> DataFrame:
    """What every line adds to its raw pair of cities."""
    return weighted_lines(lines, grain, ROUTE_PARTS).where("seller_known")


def city_activity(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 5,
    grain: str = "pair",
    threshold: str = "raw",
    lines: DataFrame | None = None,
) -> DataFrame:
    """One row per city with its supply and its demand, busiest seller city first.

    ``threshold="raw"`` applies ``min_orders`` to each spelling before merging, as
    published; ``"merged"`` applies it to each side of the merged city. Both sides
    come from one pass over the order lines. ``lines`` takes those of ``order_seller_lines``
    where another statistic has them already.
    """
    if threshold not in THRESHOLDS:
        raise ValueError(f"threshold must be one of {THRESHOLDS}, not {threshold!r}")
    if lines is None:
        lines = order_seller_lines(orders, items, customers, sellers, geolocation)
    return activity_of(group_sums(side_lines(lines, grain), CITY), customers, sellers, geolocation, min_orders, threshold)


def activity_of(
    sums: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 5,
    threshold: str = "raw",
) -> DataFrame:
    """``city_activity`` from the sums of all its ``side_lines``."""
    raw_min, merged_min = (min_orders, 1) if threshold == "raw" else (1, min_orders)
    merged = (
        averaged(sums, CITY, "revenue", raw_min)
        .withColumn("_key", city_key(F.col("city"), F.col("state")))
        .groupBy("_key", "side")
        .agg(key_of_group("city_key", "_key"), *_merged_sums("revenue"), _shown(["city", "state"]))
        .where(F.col("orders") >= merged_min)
        .withColumns({"avg_freight": _weighted("freight_sum"), "avg_distance": _weighted("distance_sum")})
    )

    def of(side: str, column: str) -> str:
        return f"max(if(side = '{side}', {column}, null))"

    columns = []
    for side, name, revenue in (("seller", "seller", "seller_revenue"), ("customer", "buyer", "buyer_spend")):
        columns += [
            F.expr(f"coalesce({of(side, 'orders')}, 0) as {name}_order_count"),
            F.expr(f"cast(coalesce({of(side, 'revenue')}, 0) as decimal(20,2)) as {revenue}"),
            F.expr(f"cast(coalesce({of(side, 'avg_freight')}, 0) as decimal(12,2)) as {name}_avg_freight"),
            F.expr(f"cast(coalesce({of(side, 'avg_distance')}, 0) as decimal(12,2)) as {name}_avg_distance"),
        ]
    # at most two rows per city; the seller's spelling is shown first
    activity = merged.groupBy("city_key").agg(F.max_by("shown", "side").alias("shown"), *columns)
    centroids = city_centroids(counted_observations(sellers, customers, geolocation)).selectExpr(
        "city_key", "round(lat, 6) as lat", "round(lng, 6) as lng"
    )
    return (
        activity.join(centroids, "city_key")
        .select(
            "city_key",
            "shown.city",
            "shown.state",
            "lat",
            "lng",
            "seller_order_count",
            "seller_revenue",
            "seller_avg_freight",
            "seller_avg_distance",
            "buyer_order_count",
            "buyer_spend",
            "buyer_avg_freight",
            "buyer_avg_distance",
        )
        .orderBy(F.desc("seller_order_count"), "city_key")
    )


def trade_routes(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 1,
    grain: str = "pair",
    lines: DataFrame | None = None,
) -> DataFrame:
    """Seller-city to customer-city routes merged over spellings, busiest first."""
    if lines is None:
        lines = order_seller_lines(orders, items, customers, sellers, geolocation)
    return routes_of(group_sums(route_lines(lines, grain), ROUTE), customers, sellers, geolocation, min_orders)


def routes_of(
    sums: DataFrame, customers: DataFrame, sellers: DataFrame, geolocation: DataFrame, min_orders: int = 1
) -> DataFrame:
    """``trade_routes`` from the sums of all its ``route_lines``."""
    raw = averaged(sums, ROUTE, "total_revenue", min_orders)
    merged = (
        raw.withColumns(
            {
                "_seller": city_key(F.col("seller_city"), F.col("seller_state")),
                "_customer": city_key(F.col("customer_city"), F.col("customer_state")),
            }
        )
        .groupBy("_seller", "_customer")
        .agg(
            key_of_group("seller_key", "_seller"),
            key_of_group("customer_key", "_customer"),
            *_merged_sums("total_revenue"),
            _shown(ROUTE),
        )
    )
    centroids = city_centroids(counted_observations(sellers, customers, geolocation))

    def ends(side: str) -> DataFrame:
        return centroids.selectExpr(
            f"city_key as {side}_key", f"round(lat, 6) as {side}_lat", f"round(lng, 6) as {side}_lng"
        )

    # A city has at most as many routes as there are cities, so no key is hot.
    located = merged.join(ends("seller"), "seller_key").join(ends("customer"), "customer_key")
    return located.select(
        "shown.seller_city",
        "shown.seller_state",
        "seller_key",
        "shown.customer_city",
        "shown.customer_state",
        "customer_key",
        "seller_lat",
        "seller_lng",
        "customer_lat",
        "customer_lng",
        F.col("orders").alias("order_count"),
        _weighted("distance_sum").alias("avg_distance_km"),
        _weighted("freight_sum").alias("avg_freight"),
        F.col("revenue").alias("total_revenue"),
    ).orderBy(F.desc("order_count"), "seller_key", "customer_key")
