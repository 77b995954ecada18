"""Results that continue from stored ones: monthly sums of cities and routes, and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.cities import CITY, ROUTE, SUMS, activity_of, group_sums, route_lines, routes_of, side_lines
from tradewind.operators.quality import add_surrogate_key
from tradewind.plans.baskets import order_seller_lines
from tradewind.sources.checkpoints import stored

MONTH = "order_month"
KINDS = {"cities": (side_lines, CITY), "routes": (route_lines, ROUTE)}


def month_of(moment: str) -> Column:
    """The month of a moment as text, by which sums are stored."""
    return F.date_format(moment, "yyyy-MM")


def store_month_sums(
    folder: str,
    months: list[str],
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    grain: str = "pair",
) -> None:
    """Store the city and route sums of the orders bought in these months, in place of what was stored for them.

    An order belongs to the month of its purchase, so distinct orders, values, freights and
    distances of months add up. ``items`` are those of the months' orders at least; where they have
    an ``order_month`` (the column they are partitioned by) only these months are read. The months
    share one pass and replace their partitions, no others; one without orders is emptied.
    """
    spark = orders.sparkSession
    bought = orders.where(month_of("order_purchase_timestamp").isin(months))
    own = items.where(F.col(MONTH).isin(months)).drop(MONTH) if MONTH in items.columns else items
    lines = stored(order_seller_lines(bought, own, customers, sellers, geolocation), "month-lines")
    when = bought.select("order_id", month_of("order_purchase_timestamp").alias(MONTH))
    named = spark.createDataFrame([(month,) for month in months], f"{MONTH} string")
    for kind, (parts, names) in KINDS.items():
        sums = group_sums(parts(lines, grain).join(when, "order_id"), [MONTH, *names])
        # A row without orders for every month, so that each one's partition is replaced.
        kept = sums.unionByName(named.withColumn("order_count", F.lit(0).cast("long")), allowMissingColumns=True)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{folder}/{kind}")


def stored_sums(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The sums of all stored months, by raw spelling."""
    months = spark.read.parquet(f"{folder}/{kind}").where("order_count > 0")
    return months.groupBy(*KINDS[kind][1]).agg(*[F.sum(part).alias(part) for part in SUMS])


def stored_city_activity(
    spark: SparkSession,
    folder: str,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 5,
    threshold: str = "raw",
) -> DataFrame:
    """``city_activity`` over all stored months; no item is read. The threshold applies to the months' sum."""
    return activity_of(stored_sums(spark, folder, "cities"), customers, sellers, geolocation, min_orders, threshold)


def stored_trade_routes(
    spark: SparkSession,
    folder: str,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
    min_orders: int = 1,
) -> DataFrame:
    """``trade_routes`` over all stored months; no item is read."""
    return routes_of(stored_sums(spark, folder, "routes"), customers, sellers, geolocation, min_orders)


LOAD = "load"


def continue_surrogate_key(
    df: DataFrame, name: str, key: list[str], folder: str, load: str, order_by: list[str] | None = None
) -> DataFrame:
    """``df`` with the surrogate number of its natural ``key``; numbers once given never change.

    ``folder`` keeps the map from key to number, one part for each load, and with it the highest
    number given. Keys that no earlier load had are numbered densely from there on, by ``order_by`` (the
    key by default); a NULL in a key is a value like any other. A load that is repeated, after a
    failure or with more rows, numbers anew only what it alone had numbered, from the same place.
    Loads are to run one after the other.
    """
    spark = df.sparkSession
    keys = df.select(*key, *[c for c in order_by or [] if c not in key]).dropDuplicates(key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    known = spark.read.schema(f"{fields}, `{name}` bigint, `{LOAD}` string").option("basePath", folder)
    try:
        earlier = known.parquet(folder).where(F.col(LOAD) != load).drop(LOAD)
        highest = earlier.agg(F.max(name)).first()[0] or 0
    except Exception as error:  # the first load finds no folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        earlier, highest = spark.createDataFrame([], f"{fields}, `{name}` bigint"), 0
    same = [F.col(f"new.`{c}`").eqNullSafe(F.col(f"old.`{c}`")) for c in key]
    new = stored(keys.alias("new").join(earlier.alias("old"), same, "left_anti"), "new-keys")
    numbered = add_surrogate_key(new, name, order_by or key).withColumn(name, F.col(name) + highest).select(*key, name)
    numbered.write.mode("overwrite").parquet(f"{folder}/{LOAD}={load}")
    every = known.parquet(folder).drop(LOAD)
    matched = [F.col(f"row.`{c}`").eqNullSafe(F.col(f"map.`{c}`")) for c in key]
    return df.alias("row").join(every.alias("map"), matched).select("row.*", f"map.`{name}`")
