"""The generated test tables in the roles of the marketplace tables.

``MAPPING`` states each role in the SQL dialect of the checking engine; ``Roles``
builds the same rows as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[str], DataFrame]

# Date window, monthly threshold and labels that suit these tables.
START, END = "1997-01-01", "1998-09-01"
MIN_MONTH_ORDERS = 60

# The translated categories. SMALL is left out to exercise the fallback.
TRANSLATION = [
    ("ECONOMY", "Economy"),
    ("MEDIUM", "Medium"),
    ("STANDARD", "Standard"),
    ("LARGE", "Large"),
    ("PROMO", "Promo"),
]


_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def _planted(orphan: Column, key: str) -> Column:
    """A key, or one that no parent has."""
    return F.when(orphan, -1 - F.col(key)).otherwise(F.col(key))


def _orders(table: Reader) -> DataFrame:
    shipped = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    return table("orders").join(shipped, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("order_id"),
        _planted(F.col("o_orderkey") % 101 == 7, "o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("processing")
        .alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("ship").alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("order_estimated_delivery_date"),
    )


def _items(table: Reader) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table("lineitem").select(
        _planted((order % 103 == 5) & (line == 2), "l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        _planted(F.col("l_partkey") % 107 == 5, "l_partkey").alias("product_id"),
        _planted((order % 109 == 5) & (line == 3), "l_suppkey").alias("seller_id"),
        F.when(~((order % 50 == 3) & (line == 1)), price).alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(12,2)").alias("freight_value"),
    )


def _places(table: Reader) -> DataFrame:
    return table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _customers(table: Reader) -> DataFrame:
    name = F.col("n_name")
    return table("customer").join(_places(table), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("c_custkey div 2").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
        F.when(F.col("c_custkey") % 3 == 0, name)
        .when(F.col("c_custkey") % 3 == 1, F.lower(name))
        .otherwise(F.concat(F.lit(" "), F.replace(name, F.lit("A"), F.lit("Ã")), F.lit(" ")))
        .alias("customer_city"),
        F.col("r_name").alias("customer_state"),
    )


def _sellers(table: Reader) -> DataFrame:
    name = F.col("n_name")
    return table("supplier").join(_places(table), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.when(F.col("s_suppkey") % 2 == 0, name)
        .otherwise(F.replace(name, F.lit("O"), F.lit("Ó")))
        .alias("seller_city"),
        F.col("r_name").alias("seller_state"),
    )


def _products(table: Reader) -> DataFrame:
    return table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") != 50, F.col("p_type")).alias("product_category_name"),
        F.when(F.col("p_size") != 49, F.col("p_size") * 150).alias("product_weight_g"),
    )


def _geolocation(table: Reader) -> DataFrame:
    balance = F.col("c_acctbal").cast("decimal(12,2)")
    zip_code = F.when(F.col("c_nationkey") == 24, 99).otherwise(F.col("c_nationkey"))
    return table("customer").select(
        zip_code.alias("geolocation_zip_code_prefix"),
        (balance / 400).cast("decimal(16,6)").alias("geolocation_lat"),
        ((balance / 300).cast("decimal(16,6)") - 50).cast("decimal(17,6)").alias("geolocation_lng"),
    )


def _payments(table: Reader) -> DataFrame:
    parts = table("orders").select("*", F.expr("explode(sequence(1L, 1 + o_orderkey % 3)) as part"))
    return parts.select(
        _planted(F.col("o_orderkey") % 113 == 5, "o_orderkey").alias("order_id"),
        F.when(F.col("part") == 2, "voucher")
        .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
        .alias("payment_type"),
        ((F.col("o_orderkey") + F.col("part")) % 10 + 1).cast("int").alias("payment_installments"),
        F.when(F.col("part") == 1, F.col("o_totalprice")).otherwise(F.col("part") * 10).cast("decimal(12,2)").alias("payment_value"),
    )


def _reviews(table: Reader) -> DataFrame:
    event = F.col("event_id")
    return table("events").select(
        event.alias("review_row_id"),
        (event % 9000).alias("review_id"),
        F.when(event % 97 == 5, -1 - event).otherwise(event % 1000).alias("order_id"),
        (event % 5 + 1).cast("int").alias("review_score"),
    )


def _qualified(table: Reader) -> DataFrame:
    return table("events").where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("mql_id"),
        F.concat(F.lit("origin_"), (F.col("user_id") % 7).cast("string")).alias("origin"),
    )


def _closed(table: Reader) -> DataFrame:
    won = table("events").where((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0))
    return won.select(
        _planted(F.col("user_id") % 5 == 0, "user_id").alias("mql_id"),
        F.col("value").cast("decimal(14,2)").alias("declared_monthly_revenue"),
    )


def _state_names(table: Reader) -> DataFrame:
    return table("region").select(
        F.col("r_name").alias("state_code"), F.concat(F.lit("Region "), F.col("r_name")).alias("state_name")
    )


_ROLES: dict[str, Callable[[Reader], DataFrame]] = {
    "orders": _orders,
    "order_items": _items,
    "order_payments": _payments,
    "order_reviews": _reviews,
    "customers": _customers,
    "sellers": _sellers,
    "products": _products,
    "geolocation": _geolocation,
    "leads_qualified": _qualified,
    "leads_closed": _closed,
    "state_names": _state_names,
}
_TRANSLATION_ROLE = "product_category_name_translation"


class Roles(Mapping[str, DataFrame]):
    """The role tables over one folder, each built when a query first asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.schema(_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    def __getitem__(self, role: str) -> DataFrame:
        if role not in self._built:
            if role == _TRANSLATION_ROLE:
                columns = "product_category_name string, product_category_name_english string"
                self._built[role] = self._spark.createDataFrame(TRANSLATION, columns)
            else:
                self._built[role] = _ROLES[role](self._table)
        return self._built[role]

    def __iter__(self) -> Iterator[str]:
        yield from _ROLES
        yield _TRANSLATION_ROLE

    def __len__(self) -> int:
        return len(_ROLES) + 1


# Role tables for the checking engine.
MAPPING = {
    "m_orders": """
        SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 101 = 7 THEN -1 - o_custkey ELSE o_custkey END AS customer_id,
          CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
          o_orderdate AS order_purchase_timestamp, ship AS order_delivered_customer_date,
          o_orderdate + INTERVAL '30' DAY AS order_estimated_delivery_date
        FROM orders LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) d
          ON l_orderkey = o_orderkey""",
    "m_items": """
        SELECT CASE WHEN l_orderkey % 103 = 5 AND l_linenumber = 2 THEN -1 - l_orderkey ELSE l_orderkey END AS order_id,
          l_linenumber AS order_item_id,
          CASE WHEN l_partkey % 107 = 5 THEN -1 - l_partkey ELSE l_partkey END AS product_id,
          CASE WHEN l_orderkey % 109 = 5 AND l_linenumber = 3 THEN -1 - l_suppkey ELSE l_suppkey END AS seller_id,
          CASE WHEN l_orderkey % 50 = 3 AND l_linenumber = 1 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price,
          CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value
        FROM lineitem""",
    "m_customers": """
        SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id, c_nationkey AS customer_zip_code_prefix,
          CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN LOWER(n_name)
            ELSE CONCAT(' ', REPLACE(n_name, 'A', 'Ã'), ' ') END AS customer_city,
          r_name AS customer_state
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "m_sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix,
          CASE s_suppkey % 2 WHEN 0 THEN n_name ELSE REPLACE(n_name, 'O', 'Ó') END AS seller_city,
          r_name AS seller_state
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "m_products": """
        SELECT p_partkey AS product_id, CASE WHEN p_size = 50 THEN NULL ELSE p_type END AS product_category_name,
          CAST(CASE WHEN p_size = 49 THEN NULL ELSE p_size * 150 END AS INTEGER) AS product_weight_g
        FROM part""",
    "m_translation": """
        SELECT * FROM (VALUES ('ECONOMY', 'Economy'), ('MEDIUM', 'Medium'), ('STANDARD', 'Standard'),
          ('LARGE', 'Large'), ('PROMO', 'Promo')) AS t(product_category_name, product_category_name_english)""",
    "m_geolocation": """
        SELECT CASE c_nationkey WHEN 24 THEN 99 ELSE c_nationkey END AS geolocation_zip_code_prefix,
          CAST(CAST(c_acctbal AS DECIMAL(12,2)) / 400 AS DECIMAL(16,6)) AS geolocation_lat,
          CAST(CAST(CAST(c_acctbal AS DECIMAL(12,2)) / 300 AS DECIMAL(16,6)) - 50 AS DECIMAL(17,6)) AS geolocation_lng
        FROM customer""",
    "m_payments": """
        SELECT CASE WHEN o_orderkey % 113 = 5 THEN -1 - o_orderkey ELSE o_orderkey END AS order_id,
          CASE WHEN part = 2 THEN 'voucher' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE o_orderpriority END AS payment_type,
          CAST(1 + (o_orderkey + part) % 10 AS INTEGER) AS payment_installments,
          CAST(CASE WHEN part = 1 THEN o_totalprice ELSE part * 10 END AS DECIMAL(12,2)) AS payment_value
        FROM (SELECT *, UNNEST(generate_series(1, 1 + o_orderkey % 3)) AS part FROM orders)""",
    "m_reviews": """
        SELECT event_id AS review_row_id, event_id % 9000 AS review_id,
          CASE WHEN event_id % 97 = 5 THEN -1 - event_id ELSE event_id % 1000 END AS order_id,
          CAST(1 + event_id % 5 AS INTEGER) AS review_score
        FROM events""",
    "m_qualified": """
        SELECT user_id AS mql_id, CONCAT('origin_', CAST(user_id % 7 AS VARCHAR)) AS origin
        FROM events WHERE event_type = 'signup'""",
    "m_closed": """
        SELECT CASE WHEN user_id % 5 = 0 THEN -1 - user_id ELSE user_id END AS mql_id,
          CAST(value AS DECIMAL(14,2)) AS declared_monthly_revenue
        FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0""",
    "m_state_names": "SELECT r_name AS state_code, CONCAT('Region ', r_name) AS state_name FROM region",
}
