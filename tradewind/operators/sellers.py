"""Seller, product and lead performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import MONEY, MONEY_TOTAL, mean
from tradewind.plans.joins import lookup
from tradewind.schema import category_labels

UNKNOWN = "Unknown"


def top_sellers(items: DataFrame, n: int = 10, alias: bool = True) -> DataFrame:
    """Sellers whose revenue RANK is at most ``n``; ties stay, so more than ``n`` rows may come out.

    Every revenue that ranks within ``n`` occurs in the top ``n`` rows. Ranks are
    therefore taken from those rows and joined back by revenue: no task ever holds
    more than ``n`` rows to rank, however many sellers tie.
    """
    per_seller = (
        items.groupBy("seller_id", "order_id")
        .agg(F.sum("price").alias("spent"))
        .groupBy("seller_id")
        .agg(
            F.sum("spent").cast(MONEY_TOTAL).alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
        )
    )
    leaders = per_seller.select("total_revenue").orderBy(F.desc("total_revenue")).limit(n)
    ranks = leaders.select(
        F.col("total_revenue").alias("ranked_revenue"),
        F.rank().over(Window.orderBy(F.desc("total_revenue"))).cast("long").alias("Revenue_rank"),
    ).distinct()
    ranked = per_seller.join(ranks, F.col("total_revenue").eqNullSafe(F.col("ranked_revenue"))).select(
        "seller_id",
        "total_revenue",
        "total_orders",
        mean(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
        "Revenue_rank",
    ).orderBy("Revenue_rank", "seller_id")
    if not alias:
        return ranked
    return ranked.select(
        F.concat(F.lit("Seller "), F.col("Revenue_rank").cast("string")).alias("Seller_Alias"),
        "total_revenue",
        "total_orders",
        "avg_order_value",
    )


def top_categories_by_volume(
    items: DataFrame, products: DataFrame, labels: DataFrame | None = None, n: int = 10
) -> DataFrame:
    """Top categories by items sold, with the English label of the ``labels`` table.

    ``labels`` is (product_category_name, product_category_name_english), by default
    the ten fixed labels. A category without a label is 'Unknown' in English only.
    """
    labels = category_labels(items.sparkSession) if labels is None else labels
    by_product = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("sold"))
    by_category = (
        by_product.join(products.select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(F.sum("sold").alias("Total_items_sold"))
    )
    return (
        by_category.join(labels, "product_category_name", "left")
        .orderBy(F.desc("Total_items_sold"), "product_category_name")
        .limit(n)
        .select(
            F.coalesce("product_category_name", F.lit(UNKNOWN)).alias("Category"),
            F.coalesce("product_category_name_english", F.lit(UNKNOWN)).alias("Category_English"),
            "Total_items_sold",
        )
    )


def lead_conversion(qualified: DataFrame, closed: DataFrame, n: int = 5) -> DataFrame:
    """Top origins by converted leads, with qualified leads and the conversion rate.

    Both sides are reduced to distinct leads before the join, so repeated lead rows
    never multiply and the two distinct counts become plain counts.
    """
    leads = qualified.select("origin", "mql_id").distinct()
    won = closed.select("mql_id").distinct().withColumn("won", F.lit(True))
    return (
        leads.join(won, "mql_id", "left")
        .groupBy("origin")
        .agg(F.count("won").alias("Converted_leads"), F.count("mql_id").alias("Total_qualified_leads"))
        .withColumn(
            "Conversion_rate_percent",
            mean(F.col("Converted_leads") * 100, F.col("Total_qualified_leads")).cast("decimal(5,2)"),
        )
        .orderBy(F.desc("Converted_leads"), "origin")
        .limit(n)
    )


def converted_leads_by_origin(qualified: DataFrame, closed: DataFrame) -> DataFrame:
    """Converted leads per origin; origins without one are left out."""
    leads = qualified.select("origin", "mql_id").distinct()
    return (
        leads.join(closed.select("mql_id").distinct(), "mql_id", "left_semi")
        .groupBy("origin")
        .agg(F.count(F.lit(1)).alias("converted_leads"))
        .orderBy(F.desc("converted_leads"), "origin")
    )


def freight_by_weight_bucket(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items, average weight and average freight in four weight buckets."""
    weight = F.col("product_weight_g")
    bucket = (
        F.when(weight < 500, "< 500 g")
        .when(weight.between(500, 1999), "500 g - 2 kg")
        .when(weight.between(2000, 4999), "2 - 5 kg")
        .otherwise("5 kg +")
    )
    by_product = items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("sold"),
        F.sum("freight_value").alias("freight"),
        F.count("freight_value").alias("freight_n"),
    )
    weighed = products.where(weight.isNotNull()).select("product_id", "product_weight_g")
    return (
        by_product.join(weighed, "product_id")
        .groupBy(bucket.alias("weight_bucket"))
        .agg(
            F.sum("sold").alias("item_count"),
            mean(F.sum(weight * F.col("sold")), F.sum("sold")).cast("decimal(10,0)").alias("avg_weight_g"),
            mean(F.sum("freight"), F.sum("freight_n")).cast(MONEY).alias("avg_freight_value"),
        )
        .orderBy("avg_weight_g", "weight_bucket")
    )


def weight_freight_pairs(items: DataFrame, products: DataFrame, n: int | None = None) -> DataFrame:
    """Weight and freight of every item, dearest freight first; ``n`` keeps the first rows only.

    The item identity is the last sort key, so a freight value shared by very many
    items is still divided over sort partitions.
    """
    weighed = products.where(F.col("product_weight_g").isNotNull()).select("product_id", "product_weight_g")
    shipped = items.where(F.col("freight_value").isNotNull()).select(
        "order_id", "order_item_id", "product_id", "freight_value"
    )
    pairs = lookup(shipped, weighed, "product_id", spread=["order_id", "order_item_id"]).orderBy(
        F.desc("freight_value"), F.desc("product_weight_g"), "order_id", "order_item_id"
    )
    if n is not None:
        pairs = pairs.limit(n)
    return pairs.select("product_weight_g", "freight_value")


def weight_freight_correlation(items: DataFrame, products: DataFrame) -> DataFrame:
    """Pearson correlation of weight and freight over items: the pairs question as one number.

    Computed from exact per-product sums, so items are reduced map-side and a product
    with a third of all items is one row by the time of the join.
    """
    cost = F.col("freight_value")
    by_product = items.where(cost.isNotNull()).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cost).alias("y"),
        F.sum(cost * cost).alias("yy"),
    )
    weight = F.col("product_weight_g").cast("decimal(10,0)")
    weighed = products.where(weight.isNotNull()).select("product_id", weight.alias("w"))
    sums = by_product.join(weighed, "product_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("w") * F.col("n")).cast("double").alias("x"),
        F.sum("y").cast("double").alias("y"),
        F.sum(F.col("w") * F.col("w") * F.col("n")).cast("double").alias("xx"),
        F.sum("yy").cast("double").alias("yy"),
        F.sum(F.col("w") * F.col("y").cast("decimal(20,2)")).cast("double").alias("xy"),
    )
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    zero = F.lit(0.0)
    spread = F.sqrt(F.greatest(n * F.col("xx") - x * x, zero)) * F.sqrt(F.greatest(n * F.col("yy") - y * y, zero))
    return sums.select(
        n.alias("item_count"),
        ((n * F.col("xy") - x * y) / F.nullif(spread, zero)).alias("weight_freight_corr"),
    )
