"""Sales and revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.dates import in_range, month_boundaries
from tradewind.functions.numbers import GROWTH, MONEY, MONEY_TOTAL, mean, percent
from tradewind.schema import state_names

TRIMMED_LABEL = "delivered (trimmed)"


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table and a TOTAL row, the total last."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return (
        counts.rollup("name")
        .agg(F.sum("rows").alias("row_count"), F.grouping("name").alias("is_total"))
        .orderBy("is_total", "name")
        .select(F.coalesce("name", F.lit("TOTAL")).alias("table_name"), "row_count")
    )


def order_status_span(orders: DataFrame, min_month_orders: int = 300) -> DataFrame:
    """Orders, first and last day and span per status, and for the busy months of 'delivered'.

    One scan reduces orders to (status, month); every output row, the trimmed one
    included, is computed from that small table.
    """
    moment = F.col("order_purchase_timestamp")
    monthly = orders.groupBy(
        "order_status", F.year(moment).alias("yr"), F.month(moment).alias("mo")
    ).agg(
        F.count(F.lit(1)).alias("orders"),
        F.min(moment).alias("first_moment"),
        F.max(moment).alias("last_moment"),
    )
    busy = (
        (F.col("order_status") == "delivered")
        & (F.col("orders") >= min_month_orders)
        & F.col("yr").isNotNull()
    )
    status, trimmed = F.col("order_status"), F.lit(TRIMMED_LABEL)
    rows = monthly.select(
        F.explode(F.when(busy, F.array(status, trimmed)).otherwise(F.array(status))).alias("label"),
        "orders",
        "first_moment",
        "last_moment",
    )
    # the trimmed row exists even when no month qualifies
    moment_type = rows.schema["first_moment"].dataType
    always = rows.sparkSession.range(1).select(
        trimmed.alias("label"),
        F.lit(0).cast("long").alias("orders"),
        F.lit(None).cast(moment_type).alias("first_moment"),
        F.lit(None).cast(moment_type).alias("last_moment"),
    )
    span = month_boundaries(F.min("first_moment"), F.max("last_moment"))
    return (
        rows.unionByName(always)
        .groupBy("label")
        .agg(
            F.sum("orders").alias("order_count"),
            F.to_date(F.min("first_moment")).alias("first_order"),
            F.to_date(F.max("last_moment")).alias("last_order"),
            span.alias("span"),
        )
        .select(
            F.col("label").alias("order_status"),
            "order_count",
            "first_order",
            "last_order",
            F.expr("int(span div 12)").alias("span_years"),
            (F.col("span") % 12).alias("span_months"),
        )
        .orderBy(F.desc("order_count"), "order_status")
    )


def revenue_growth(
    orders: DataFrame,
    items: DataFrame,
    start: str = "2017-01-01",
    end: str = "2018-09-01",
    status: str = "delivered",
) -> DataFrame:
    """Orders and revenue per month with month-over-month and cumulative growth.

    Items collapse to one row per order before the join, so a very large order is
    summed map-side, and each joined row is one distinct order.
    """
    moment = F.col("order_purchase_timestamp")
    baskets = items.groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("revenue"))
    chosen = orders.where((F.col("order_status") == status) & in_range(moment, start, end)).select(
        "order_id", F.year(moment).alias("order_year"), F.month(moment).alias("order_month")
    )
    monthly = (
        chosen.join(baskets, "order_id")
        .groupBy("order_year", "order_month")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("revenue").cast(MONEY_TOTAL).alias("total_revenue"),
        )
    )
    calendar = Window.orderBy("order_year", "order_month")  # over months only
    revenue = F.col("total_revenue")
    previous = F.lag(revenue).over(calendar)
    first = F.first_value(revenue).over(calendar)
    return monthly.select(
        "order_year",
        "order_month",
        "order_count",
        "total_revenue",
        percent(revenue - previous, previous).cast(GROWTH).alias("mom_growth_pct"),
        percent(revenue - first, first).cast(GROWTH).alias("cumulative_growth_pct"),
    ).orderBy("order_year", "order_month")


def revenue_growth_summary(growth: DataFrame) -> DataFrame:
    """Minimum, maximum and average of the four monthly measures, from one aggregate."""
    measures = {
        "order_count": "decimal(18,0)",
        "total_revenue": "decimal(20,2)",
        "mom_growth_pct": "decimal(12,1)",
        "cumulative_growth_pct": "decimal(12,1)",
    }
    aggregates = []
    for name, output in measures.items():
        aggregates += [
            F.min(name).cast(output).alias(f"min_{name}"),
            F.max(name).cast(output).alias(f"max_{name}"),
            mean(F.sum(name), F.count(name)).cast(output).alias(f"avg_{name}"),
        ]
    cells = []
    for label, prefix in (("Minimum", "min"), ("Maximum", "max"), ("Average", "avg")):
        cells.append(F.lit(label))
        cells += [F.col(f"{prefix}_{name}") for name in measures]
    return growth.agg(*aggregates).select(F.stack(F.lit(3), *cells).alias("stat", *measures))


def payment_method_breakdown(payments: DataFrame) -> DataFrame:
    """Orders, average installments and value per payment type."""
    return (
        payments.where(F.col("payment_type").isNotNull())
        .groupBy("payment_type")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            mean(F.sum("payment_installments"), F.count("payment_installments"))
            .cast("decimal(4,1)")
            .alias("avg_installments"),
            F.sum("payment_value").cast(MONEY_TOTAL).alias("total_revenue"),
        )
        .orderBy(F.desc("order_count"), "payment_type")
    )


def avg_order_value_by_state(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    states: DataFrame | None = None,
    min_orders: int | None = 100,
    top_n: int | None = 10,
) -> DataFrame:
    """Top states by average item value (price + freight) of delivered orders.

    ``states`` is (state_code, state_name), by default the 27 states; a state outside
    it is left out. ``min_orders=None`` keeps every state with an order and
    ``top_n=None`` returns all of them. Each shuffle is preceded by an aggregate on
    its own key: order, then customer, then state.
    """
    states = state_names(orders.sparkSession) if states is None else states
    value = F.col("price") + F.col("freight_value")
    baskets = items.groupBy("order_id").agg(
        F.sum("price").alias("price"),
        F.count("price").alias("price_n"),
        F.sum("freight_value").alias("freight"),
        F.count("freight_value").alias("freight_n"),
        F.sum(value).alias("value"),
        F.count(value).alias("value_n"),
    )
    sums = ["price", "price_n", "freight", "freight_n", "value", "value_n"]
    delivered = orders.where(F.col("order_status") == "delivered").select("order_id", "customer_id")
    by_customer = (
        delivered.join(baskets, "order_id")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("order_count"), *[F.sum(c).alias(c) for c in sums])
    )
    by_state = (
        by_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(F.sum("order_count").alias("order_count"), *[F.sum(c).alias(c) for c in sums])
        .where(F.col("order_count") >= (1 if min_orders is None else min_orders))
    )
    named = by_state.join(states.withColumnRenamed("state_code", "customer_state"), "customer_state").select(
        "customer_state",
        "state_name",
        "order_count",
        mean(F.col("price"), F.col("price_n")).cast(MONEY).alias("avg_product_value"),
        mean(F.col("freight"), F.col("freight_n")).cast(MONEY).alias("avg_freight_value"),
        mean(F.col("value"), F.col("value_n")).cast(MONEY).alias("avg_order_value"),
    )
    ranked = named.orderBy(F.desc("avg_order_value"), "customer_state")
    return ranked if top_n is None else ranked.limit(top_n)


def category_revenue(items: DataFrame, products: DataFrame, translation: DataFrame, n: int = 10) -> DataFrame:
    """Top categories by price + freight over all orders, in English where translated."""
    by_product = items.groupBy("product_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("revenue"))
    by_category = (
        by_product.join(products.select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(F.sum("revenue").cast(MONEY_TOTAL).alias("total_revenue"))
    )
    return (
        by_category.join(translation, "product_category_name", "left")
        .orderBy(F.desc("total_revenue"), "product_category_name")
        .limit(n)
        .select(
            F.coalesce("product_category_name_english", "product_category_name").alias("category_english"),
            "total_revenue",
        )
    )
