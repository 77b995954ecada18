"""Delivery, reviews, repeat customers and order status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.dates import in_range
from tradewind.functions.numbers import SHARE, percent


def _share_of_all(count: str):
    """Share of one group's count in the sum over all groups; for small grouped frames."""
    return percent(F.col(count), F.sum(count).over(Window.partitionBy())).cast(SHARE)


def delivery_status(orders: DataFrame) -> DataFrame:
    """Delivered orders that came on time, late, or have no delivery date."""
    actual, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    outcome = F.when(actual <= promised, "On Time").when(actual > promised, "Late").otherwise("Not Delivered Yet")
    return (
        orders.where(F.col("order_status") == "delivered")
        .groupBy(outcome.alias("DeliveryStatus"))
        .agg(F.count(F.lit(1)).alias("OrderCount"))
        .withColumn("Percentage", _share_of_all("OrderCount"))
    )


def review_score_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews, star label and share per score, best score first."""
    return (
        reviews.groupBy(F.col("review_score").alias("ReviewScore"))
        .agg(F.count(F.lit(1)).alias("TotalReviews"))
        .select(
            "ReviewScore",
            "TotalReviews",
            F.repeat(F.lit("★"), F.col("ReviewScore")).alias("RatingLabel"),
            _share_of_all("TotalReviews").alias("Percentage"),
        )
        .orderBy(F.desc("ReviewScore"))
    )


def repeat_customers_by_month(
    customers: DataFrame,
    orders: DataFrame,
    start: str = "2017-01-01",
    end: str = "2018-09-01",
) -> DataFrame:
    """People who ordered in each month of the window, and those of them with more than one order ever.

    Orders reduce to (customer, month) before they meet customers and to (person, month)
    after, all months outside the window sharing one row, so a person's orders over all
    time are a sum over their few month rows.
    """
    moment = F.col("order_purchase_timestamp")
    month = F.when(in_range(moment, start, end), F.date_format(moment, "yyyy-MM"))
    person_month = (
        orders.groupBy("customer_id", month.alias("OrderMonth"))
        .agg(F.count("order_id").alias("orders"))
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id", "OrderMonth")
        .agg(F.sum("orders").alias("orders"))
    )
    ever = F.sum("orders").over(Window.partitionBy("customer_unique_id"))
    return (
        person_month.withColumn("ever", ever)
        .where(F.col("OrderMonth").isNotNull())
        .groupBy("OrderMonth")
        .agg(
            F.count(F.lit(1)).alias("TotalCustomers"),
            F.count_if(F.col("ever") > 1).alias("RepeatCustomers"),
        )
        .orderBy("OrderMonth")
    )


def order_status_breakdown(orders: DataFrame, exclude: str = "delivered") -> DataFrame:
    """Orders per status, one status left out."""
    return (
        orders.where(F.col("order_status") != exclude)
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("TotalOrders"))
        .orderBy(F.desc("TotalOrders"), "order_status")
    )
