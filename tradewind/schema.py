"""Declared tables, keys and fixed literal tables of the marketplace model.

Spark does not enforce keys. The operators rely on the primary keys below for
the parent side of their joins; ``operators.quality.check_primary_key`` and
``check_foreign_key`` verify them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(12, 2)
COORDINATE = T.DecimalType(22, 19)


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*column) for column in columns])


_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()

TABLES: dict[str, T.StructType] = {
    "orders": _table(
        ("order_id", _S, False),
        ("customer_id", _S, True),
        ("order_status", _S, True),
        ("order_purchase_timestamp", _TS, True),
        ("order_delivered_customer_date", _TS, True),
        ("order_estimated_delivery_date", _TS, True),
    ),
    "order_items": _table(
        ("order_id", _S, False),
        ("order_item_id", _I, False),
        ("product_id", _S, True),
        ("seller_id", _S, True),
        ("price", PRICE, True),
        ("freight_value", PRICE, True),
    ),
    "order_payments": _table(
        ("order_id", _S, True),
        ("payment_type", _S, True),
        ("payment_installments", _I, True),
        ("payment_value", PRICE, True),
    ),
    "order_reviews": _table(
        ("review_id", _S, True),
        ("order_id", _S, True),
        ("review_score", _I, True),
        ("review_comment_message", _S, True),
    ),
    "customers": _table(
        ("customer_id", _S, False),
        ("customer_unique_id", _S, True),
        ("customer_zip_code_prefix", _I, True),
        ("customer_city", _S, True),
        ("customer_state", _S, True),
    ),
    "sellers": _table(
        ("seller_id", _S, False),
        ("seller_zip_code_prefix", _I, True),
        ("seller_city", _S, True),
        ("seller_state", _S, True),
    ),
    "products": _table(
        ("product_id", _S, False),
        ("product_category_name", _S, True),
        ("product_weight_g", _I, True),
    ),
    "product_category_name_translation": _table(
        ("product_category_name", _S, False),
        ("product_category_name_english", _S, True),
    ),
    "geolocation": _table(
        ("geolocation_zip_code_prefix", _I, True),
        ("geolocation_lat", COORDINATE, True),
        ("geolocation_lng", COORDINATE, True),
    ),
    "leads_qualified": _table(("mql_id", _S, False), ("origin", _S, True)),
    "leads_closed": _table(
        ("mql_id", _S, True),
        ("declared_monthly_revenue", T.DecimalType(14, 2), True),
    ),
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "product_category_name_translation": ["product_category_name"],
    "leads_qualified": ["mql_id"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
    ("leads_closed", "mql_id", "leads_qualified", "mql_id"),
]

# State code and display name (27 federative units).
STATE_NAMES: list[tuple[str, str]] = [
    ("AC", "Acre"),
    ("AL", "Alagoas"),
    ("AM", "Amazonas"),
    ("AP", "Amapa"),
    ("BA", "Bahia"),
    ("CE", "Ceara"),
    ("DF", "Distrito Federal"),
    ("ES", "Espirito Santo"),
    ("GO", "Goias"),
    ("MA", "Maranhao"),
    ("MG", "Minas Gerais"),
    ("MS", "Mato Grosso do Sul"),
    ("MT", "Mato Grosso"),
    ("PA", "Para"),
    ("PB", "Paraiba"),
    ("PE", "Pernambuco"),
    ("PI", "Piaui"),
    ("PR", "Parana"),
    ("RJ", "Rio de Janeiro"),
    ("RN", "Rio Grande do Norte"),
    ("RO", "Rondonia"),
    ("RR", "Roraima"),
    ("RS", "Rio Grande do Sul"),
    ("SC", "Santa Catarina"),
    ("SE", "Sergipe"),
    ("SP", "Sao Paulo"),
    ("TO", "Tocantins"),
]

# Category name and the hand-made English label of the volume ranking.
CATEGORY_LABELS: list[tuple[str, str]] = [
    ("cama_mesa_banho", "Bed, Bath & Table"),
    ("beleza_saude", "Beauty & Health"),
    ("esporte_lazer", "Sports & Leisure"),
    ("moveis_decoracao", "Furniture & Decor"),
    ("informatica_acessorios", "Computers & Accessories"),
    ("utilidades_domesticas", "Home Essentials"),
    ("relogios_presentes", "Watches & Gifts"),
    ("telefonia", "Phone"),
    ("ferramentas_jardim", "Garden Tools"),
    ("automotivo", "Automotive"),
]


def state_names(spark: SparkSession) -> DataFrame:
    """The 27 states as (state_code, state_name); broadcast, being of fixed size."""
    return F.broadcast(spark.createDataFrame(STATE_NAMES, "state_code string, state_name string"))


def category_labels(spark: SparkSession) -> DataFrame:
    """The ten hand-made labels as (product_category_name, product_category_name_english); broadcast."""
    columns = "product_category_name string, product_category_name_english string"
    return F.broadcast(spark.createDataFrame(CATEGORY_LABELS, columns))
