"""The named relations as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradewind.operators.geography import order_geo
from tradewind.operators.sales import payment_method_breakdown, revenue_growth


def register_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Registers every table and the three derived views; returns the derived ones."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    orders, items = tables["orders"], tables["order_items"]
    views = {
        "vw_revenue_growth": revenue_growth(orders, items),
        "vw_payment_method_breakdown": payment_method_breakdown(tables["order_payments"]),
        "vw_geo": order_geo(orders, items, tables["customers"], tables["sellers"], tables["geolocation"]),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views
