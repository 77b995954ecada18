"""SQL checks: the same results from an independent engine over the same tables.

The pair-grain checks do build every pair of items of an order, so they test the
products of sums that the operators use instead.
"""

from __future__ import annotations

import re

from tradewind.checks.queries import CHOSEN, DECLARED, MERGED, PROFILE_KEYS
from tradewind.checks.testdata import END, MAPPING, MIN_MONTH_ORDERS, START
from tradewind.schema import FOREIGN_KEYS, PRIMARY_KEYS


def _rounded(value: str, output: str) -> str:
    """A DOUBLE as DECIMAL, its shortest decimal text rounded half up, as Spark does."""
    return f"CAST(CAST({value} AS VARCHAR) AS {output})"


def _avg(column: str, output: str) -> str:
    return _rounded(f"CAST(SUM({column}) AS DOUBLE) / NULLIF(COUNT({column}), 0)", output)


def _key(city: str, state: str) -> str:
    return f"strip_accents(LOWER(TRIM({city}))) || '|' || LOWER(TRIM({state}))"


_KM = "CAST(111 AS DOUBLE)"


def _distance(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    north, east = f"(({lat1} - {lat2}) * {_KM})", f"(({lng1} - {lng2}) * {_KM})"
    return f"SQRT({north} * {north} + {east} * {east})"


# Derived relations that several checks share, by name; they may use each other and the role tables.
_SHARED = {
    "months": f"""
        SELECT CAST(YEAR(order_purchase_timestamp) AS INTEGER) AS order_year,
          CAST(MONTH(order_purchase_timestamp) AS INTEGER) AS order_month,
          COUNT(DISTINCT order_id) AS order_count,
          CAST(SUM(price + freight_value) AS DECIMAL(20,2)) AS total_revenue
        FROM m_orders JOIN m_items USING (order_id)
        WHERE order_status = 'delivered' AND order_purchase_timestamp >= TIMESTAMP '{START}'
          AND order_purchase_timestamp < TIMESTAMP '{END}'
        GROUP BY 1, 2""",
    "growth": f"""
        SELECT *,
          {_rounded("CAST(total_revenue - LAG(total_revenue) OVER w AS DOUBLE) * 100 / LAG(total_revenue) OVER w",
                    "DECIMAL(12,1)")} AS mom_growth_pct,
          {_rounded("CAST(total_revenue - FIRST_VALUE(total_revenue) OVER w AS DOUBLE) * 100"
                    " / FIRST_VALUE(total_revenue) OVER w", "DECIMAL(12,1)")} AS cumulative_growth_pct
        FROM months WINDOW w AS (ORDER BY order_year, order_month)""",
    "states": f"""
        SELECT customer_state, state_name, COUNT(DISTINCT order_id) AS order_count,
          {_avg("price", "DECIMAL(12,2)")} AS avg_product_value,
          {_avg("freight_value", "DECIMAL(12,2)")} AS avg_freight_value,
          {_avg("price + freight_value", "DECIMAL(12,2)")} AS avg_order_value
        FROM m_orders JOIN m_customers USING (customer_id) JOIN m_items USING (order_id)
          JOIN m_state_names ON state_code = customer_state
        WHERE order_status = 'delivered' GROUP BY 1, 2""",
    "ranked": """
        SELECT seller_id, CAST(SUM(price) AS DECIMAL(20,2)) AS total_revenue,
          COUNT(DISTINCT order_id) AS total_orders,
          CAST(SUM(price) AS DOUBLE) / COUNT(DISTINCT order_id) AS avg_order_value,
          RANK() OVER (ORDER BY SUM(price) DESC) AS Revenue_rank
        FROM m_items GROUP BY seller_id""",
    "zips": """
        SELECT geolocation_zip_code_prefix AS zip_code_prefix,
          CAST(SUM(geolocation_lat) AS DOUBLE) / COUNT(geolocation_lat) AS lat,
          CAST(SUM(geolocation_lng) AS DOUBLE) / COUNT(geolocation_lng) AS lng
        FROM m_geolocation GROUP BY 1""",
    "geo": f"""
        SELECT o.order_id, order_status, i.seller_id, price, freight_value, customer_city, customer_state,
          c.lat AS customer_lat, c.lng AS customer_lng, seller_city, seller_state,
          s.lat AS seller_lat, s.lng AS seller_lng,
          {_distance("c.lat", "c.lng", "s.lat", "s.lng")} AS distance_km
        FROM m_orders o JOIN m_items i ON i.order_id = o.order_id
          JOIN m_customers mc ON mc.customer_id = o.customer_id JOIN m_sellers ms ON ms.seller_id = i.seller_id
          JOIN zips c ON c.zip_code_prefix = customer_zip_code_prefix
          JOIN zips s ON s.zip_code_prefix = seller_zip_code_prefix""",
    # every located item of a delivered order with every item of the same order
    "pairs": """
        SELECT g.order_id, ms.seller_city, ms.seller_state, g.seller_state AS other_state,
          g.customer_city, g.customer_state,
          i.price + i.freight_value AS value, i.freight_value AS freight, g.freight_value AS other_freight,
          g.distance_km, EXISTS (SELECT 1 FROM zips WHERE zip_code_prefix = ms.seller_zip_code_prefix) AS placed
        FROM geo g JOIN m_items i ON i.order_id = g.order_id LEFT JOIN m_sellers ms ON ms.seller_id = i.seller_id
        WHERE g.order_status = 'delivered'""",
    "single": """
        SELECT order_id, seller_city, seller_state, seller_state AS other_state, customer_city, customer_state,
          price + freight_value AS value, freight_value AS freight, freight_value AS other_freight, distance_km,
          TRUE AS placed
        FROM geo WHERE order_status = 'delivered'""",
    "people": """
        SELECT seller_city AS city, seller_state AS state, lat, lng
        FROM m_sellers JOIN zips ON zip_code_prefix = seller_zip_code_prefix
        UNION ALL
        SELECT customer_city, customer_state, lat, lng
        FROM m_customers JOIN zips ON zip_code_prefix = customer_zip_code_prefix""",
    "raw_cities": """
        SELECT seller_city AS city, seller_state AS state FROM m_sellers
        UNION SELECT customer_city, customer_state FROM m_customers""",
    "spelled": f"""
        SELECT {_key("city", "state")} AS city_key, city, state, SUM(lat) AS lats, SUM(lng) AS lngs, COUNT(*) AS seen
        FROM people GROUP BY city, state""",
    "centroids": """
        SELECT city_key, FIRST(city ORDER BY seen DESC, city, state) AS city,
          FIRST(state ORDER BY seen DESC, city, state) AS state,
          ROUND(SUM(lats) / SUM(seen), 6) AS lat, ROUND(SUM(lngs) / SUM(seen), 6) AS lng
        FROM spelled GROUP BY city_key""",
}


def _city_stats(source: str, side: str, revenue: str, min_orders: int) -> str:
    placed = "WHERE placed" if side == "seller" else ""
    return f"""
        SELECT {side}_city, {side}_state, COUNT(DISTINCT order_id) AS order_count,
          CAST(SUM(value) AS DECIMAL(20,2)) AS {revenue},
          {_avg("freight", "DECIMAL(12,2)")} AS avg_freight,
          {_avg("distance_km", "DECIMAL(12,2)")} AS avg_distance_km
        FROM {source} {placed} GROUP BY 1, 2 HAVING COUNT(DISTINCT order_id) >= {min_orders}"""


def _weighted(name: str) -> str:
    return _rounded(f"CAST(SUM({name} * order_count) AS DOUBLE) / SUM(order_count)", "DECIMAL(12,2)")


def _merged(source: str, side: str, revenue: str, min_orders: int = 1) -> str:
    city, state = f"{side}_city", f"{side}_state"
    return f"""
        SELECT {_key(city, state)} AS city_key,
          FIRST({city} ORDER BY order_count DESC, {city}, {state}) AS city,
          FIRST({state} ORDER BY order_count DESC, {city}, {state}) AS state,
          CAST(SUM(order_count) AS BIGINT) AS order_count,
          CAST(SUM({revenue}) AS DECIMAL(20,2)) AS revenue,
          {_weighted("avg_freight")} AS avg_freight,
          {_weighted("avg_distance_km")} AS avg_distance
        FROM {source} GROUP BY 1 HAVING SUM(order_count) >= {min_orders}"""


_ACTIVITY = """
        SELECT city_key, COALESCE(s.city, b.city) AS city, COALESCE(s.state, b.state) AS state, c.lat, c.lng,
          COALESCE(s.order_count, 0) AS seller_order_count, COALESCE(s.revenue, 0) AS seller_revenue,
          COALESCE(s.avg_freight, 0) AS seller_avg_freight, COALESCE(s.avg_distance, 0) AS seller_avg_distance,
          COALESCE(b.order_count, 0) AS buyer_order_count, COALESCE(b.revenue, 0) AS buyer_spend,
          COALESCE(b.avg_freight, 0) AS buyer_avg_freight, COALESCE(b.avg_distance, 0) AS buyer_avg_distance
        FROM supply s FULL JOIN demand b USING (city_key) JOIN centroids c USING (city_key)"""


def _activity(source: str, raw_min: int, merged_min: int = 1) -> dict[str, str]:
    return {
        "supply_raw": _city_stats(source, "seller", "revenue", raw_min),
        "demand_raw": _city_stats(source, "customer", "revenue", raw_min),
        "supply": _merged("supply_raw", "seller", "revenue", merged_min),
        "demand": _merged("demand_raw", "customer", "revenue", merged_min),
        "activity": _ACTIVITY,
    }


_NAMES = "seller_city, seller_state, customer_city, customer_state"


def _route_stats(source: str) -> str:
    return f"""
        SELECT {_NAMES}, COUNT(DISTINCT order_id) AS order_count,
          CAST(SUM(value) AS DECIMAL(20,2)) AS total_revenue,
          {_avg("other_freight", "DECIMAL(12,2)")} AS avg_freight,
          {_avg("distance_km", "DECIMAL(12,2)")} AS avg_distance_km
        FROM {source} GROUP BY ALL"""


def _routes(source: str) -> dict[str, str]:
    shown = ",\n          ".join(
        f"FIRST({name} ORDER BY order_count DESC, {_NAMES}) AS {name}" for name in _NAMES.split(", ")
    )
    return {
        "route_stats": _route_stats(source),
        "keyed": f"""
        SELECT *, {_key("seller_city", "seller_state")} AS seller_key,
          {_key("customer_city", "customer_state")} AS customer_key FROM route_stats""",
        "joined": f"""
        SELECT seller_key, customer_key, {shown},
          CAST(SUM(order_count) AS BIGINT) AS n, CAST(SUM(total_revenue) AS DECIMAL(20,2)) AS revenue,
          {_weighted("avg_distance_km")} AS km, {_weighted("avg_freight")} AS freight
        FROM keyed GROUP BY seller_key, customer_key""",
        "routes": """
        SELECT seller_city, seller_state, seller_key, customer_city, customer_state, customer_key,
          s.lat AS seller_lat, s.lng AS seller_lng, c.lat AS customer_lat, c.lng AS customer_lng,
          n AS order_count, km AS avg_distance_km, freight AS avg_freight, revenue AS total_revenue
        FROM joined JOIN (SELECT city_key, lat, lng FROM centroids) s ON s.city_key = seller_key
          JOIN (SELECT city_key, lat, lng FROM centroids) c ON c.city_key = customer_key""",
    }


def _top_city_routes(source: str) -> str:
    km = "SUM(distance_km) / COUNT(distance_km)"
    return f"""
        SELECT seller_city || ' (' || other_state || ') -> ' || customer_city || ' (' || customer_state || ')' AS route,
          order_count, avg_distance_km, avg_distance_mi, avg_freight_value
        FROM (
          SELECT seller_city, other_state, customer_city, customer_state, COUNT(*) AS order_count,
            {_rounded(km, "DECIMAL(10,1)")} AS avg_distance_km,
            {_rounded(km + " * CAST(0.6214 AS DOUBLE)", "DECIMAL(10,1)")} AS avg_distance_mi,
            {_avg("other_freight", "DECIMAL(12,2)")} AS avg_freight_value
          FROM {source} WHERE seller_city IS NOT NULL GROUP BY ALL
          ORDER BY order_count DESC, seller_city, other_state, customer_city, customer_state LIMIT 10)"""


def _per_city(match: str, metric: str) -> str:
    return f"""
        SELECT * EXCLUDE (place) FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY match_key ORDER BY {metric} DESC, seller_key, customer_key) AS place
          FROM (SELECT *, {match} AS match_key FROM routes) WHERE match_key IS NOT NULL)
        WHERE place <= 5"""


_CHOSEN = ", ".join(f"'{key}'" for key in CHOSEN)
_SOLD, _BOUGHT = f"seller_key IN ({_CHOSEN})", f"customer_key IN ({_CHOSEN})"

# ---- profile ----

_ROLE_NAMES = {
    "orders": "m_orders",
    "order_items": "m_items",
    "order_payments": "m_payments",
    "order_reviews": "m_reviews",
    "customers": "m_customers",
    "sellers": "m_sellers",
    "products": "m_products",
    "product_category_name_translation": "m_translation",
    "geolocation": "m_geolocation",
    "leads_qualified": "m_qualified",
    "leads_closed": "m_closed",
}

_PROFILED = {
    "customers": {
        "customer_id": "BIGINT",
        "customer_unique_id": "BIGINT",
        "customer_zip_code_prefix": "INTEGER",
        "customer_city": "VARCHAR",
        "customer_state": "VARCHAR",
    },
    "geolocation": {
        "geolocation_zip_code_prefix": "INTEGER",
        "geolocation_lat": "DECIMAL(16,6)",
        "geolocation_lng": "DECIMAL(17,6)",
    },
    "leads_closed": {"mql_id": "BIGINT", "declared_monthly_revenue": "DECIMAL(14,2)"},
    "leads_qualified": {"mql_id": "BIGINT", "origin": "VARCHAR"},
    "order_payments": {
        "order_id": "BIGINT",
        "payment_type": "VARCHAR",
        "payment_installments": "INTEGER",
        "payment_value": "DECIMAL(12,2)",
    },
    "order_reviews": {"review_row_id": "BIGINT", "review_id": "BIGINT", "order_id": "BIGINT", "review_score": "INTEGER"},
    "product_category_name_translation": {
        "product_category_name": "VARCHAR",
        "product_category_name_english": "VARCHAR",
    },
    "products": {"product_id": "BIGINT", "product_category_name": "VARCHAR", "product_weight_g": "INTEGER"},
    "sellers": {
        "seller_id": "BIGINT",
        "seller_zip_code_prefix": "INTEGER",
        "seller_city": "VARCHAR",
        "seller_state": "VARCHAR",
    },
    "order_items": {
        "order_id": "BIGINT",
        "order_item_id": "INTEGER",
        "product_id": "BIGINT",
        "seller_id": "BIGINT",
        "price": "DECIMAL(12,2)",
        "freight_value": "DECIMAL(12,2)",
    },
    "orders": {
        "order_id": "BIGINT",
        "customer_id": "BIGINT",
        "order_status": "VARCHAR",
        "order_purchase_timestamp": "TIMESTAMP",
        "order_delivered_customer_date": "TIMESTAMP",
        "order_estimated_delivery_date": "TIMESTAMP",
    },
}
_NEVER_NULL = ("order_status",)
_FULL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "nvarchar(MAX)", "TIMESTAMP": "datetime2"}


def _profiled_column(table: str, column: str, data_type: str) -> str:
    if data_type == "VARCHAR":
        shown, stat = "LEFT({0}, 100)", f"'max_len=' || MAX(LENGTH(RTRIM({column})))"
    elif data_type == "TIMESTAMP":
        shown = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
        stat = f"'range_days=' || date_diff('day', MIN({column}), MAX({column}))"
    else:
        shown, stat = "CAST({0} AS VARCHAR)", f"'avg=' || {_avg(column, 'DECIMAL(28,4)')}"
    full_type = DECLARED.get(table, {}).get(column, _FULL_TYPES.get(data_type, data_type.lower()))
    nullable = "FALSE" if column in _NEVER_NULL else "TRUE"
    keys = ", ".join(PROFILE_KEYS[table])
    samples = ", ".join(
        f"MIN(CASE WHEN place = {k} THEN {shown.format(column)} END) AS sample_{k}" for k in (1, 2, 3)
    )
    return f"""
        SELECT '{table}' AS table_name, '{column}' AS column_name, '{full_type}' AS full_type, {nullable} AS nullable,
          COUNT(*) - COUNT({column}) AS null_count, COUNT(DISTINCT {column}) AS distinct_count,
          {shown.format(f"MIN({column})")} AS min_val, {shown.format(f"MAX({column})")} AS max_val,
          {samples}, {stat} AS extra_stat
        FROM (SELECT {column}, ROW_NUMBER() OVER (ORDER BY {column} IS NULL, {keys}, {column}) AS place
              FROM {_ROLE_NAMES[table]})"""


_PROFILE = "\n        UNION ALL".join(
    _profiled_column(table, column, data_type)
    for table, columns in _PROFILED.items()
    for column, data_type in columns.items()
)
_RANGE = "' (min=' || COALESCE(min_val, 'null') || ', max=' || COALESCE(max_val, 'null') || ')'"
_LENGTH = "TRY_CAST(REPLACE(extra_stat, 'max_len=', '') AS INTEGER)"
_LOW, _HIGH = "TRY_CAST(min_val AS BIGINT)", "TRY_CAST(max_val AS BIGINT)"
_SANITY = f"""
        SELECT *, CASE
          WHEN full_type IN ('date', 'datetime2') AND (TRY_CAST(min_val AS TIMESTAMP) < TIMESTAMP '2000-01-01'
            OR TRY_CAST(max_val AS TIMESTAMP) > TIMESTAMP '2030-01-01')
            THEN 'WARN: date out of expected range 2000-2030' || {_RANGE}
          WHEN full_type LIKE 'decimal(%,%)' AND contains(max_val, '.')
            AND LENGTH(split_part(max_val, '.', 2)) > TRY_CAST(regexp_extract(full_type, ',([0-9]+)', 1) AS INTEGER)
            THEN 'WARN: fractional digits in max_val (' || max_val || ') may exceed scale in ' || full_type
          WHEN full_type = 'tinyint' AND ({_LOW} < 0 OR {_HIGH} > 255)
            THEN 'WARN: value out of TINYINT range' || {_RANGE}
          WHEN full_type = 'smallint' AND ({_LOW} < -32768 OR {_HIGH} > 32767)
            THEN 'WARN: value out of SMALLINT range' || {_RANGE}
          WHEN full_type = 'int' AND ({_LOW} < -2147483648 OR {_HIGH} > 2147483647)
            THEN 'WARN: value out of INT range' || {_RANGE}
          WHEN regexp_matches(full_type, '^n?varchar[(][0-9]+[)]$')
            AND {_LENGTH} > CAST(regexp_extract(full_type, '[0-9]+') AS INTEGER)
            THEN 'WARN: max_len ' || {_LENGTH} || ' exceeds declared ' || full_type
          ELSE 'OK' END AS sanity_check
        FROM profile"""

# ---- checks ----

_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS name, COUNT(*) AS n FROM {role}" for name, role in _ROLE_NAMES.items())
_SPAN = """COUNT(*) AS order_count, CAST(MIN(order_purchase_timestamp) AS DATE) AS first_order,
          CAST(MAX(order_purchase_timestamp) AS DATE) AS last_order,
          CAST(date_diff('month', MIN(order_purchase_timestamp), MAX(order_purchase_timestamp)) // 12 AS INTEGER)
            AS span_years,
          CAST(date_diff('month', MIN(order_purchase_timestamp), MAX(order_purchase_timestamp)) % 12 AS INTEGER)
            AS span_months"""
_SHARE = _rounded("CAST(COUNT(*) * 100 AS DOUBLE) / SUM(COUNT(*)) OVER ()", "DECIMAL(10,2)")


def _summary_row(label: str, function: str) -> str:
    def cell(name: str, output: str) -> str:
        value = f"CAST({function}({name}) AS {output})" if function != "AVG" else _avg(name, output)
        return f"{value} AS {name}"

    cells = [
        cell("order_count", "DECIMAL(18,0)"),
        cell("total_revenue", "DECIMAL(20,2)"),
        cell("mom_growth_pct", "DECIMAL(12,1)"),
        cell("cumulative_growth_pct", "DECIMAL(12,1)"),
    ]
    return f"SELECT '{label}' AS stat, {', '.join(cells)} FROM growth"


def _scaled(low: str, high: str) -> str:
    return f"""
        SELECT city_key, both_gmv,
          ROUND(CASE WHEN {high} > {low} THEN (v - {low}) / ({high} - {low}) ELSE 0 END, 9) AS intensity,
          ROUND(CASE WHEN {high} > {low} THEN 4 + 24 * (LN(1 + v) - LN(1 + {low})) / (LN(1 + {high}) - LN(1 + {low}))
            ELSE 8 END, 9) AS radius
        FROM (SELECT *, CAST(both_gmv AS DOUBLE) AS v,
                MIN(CASE WHEN both_gmv > 0 THEN CAST(both_gmv AS DOUBLE) END) OVER () AS low,
                MAX(CASE WHEN both_gmv > 0 THEN CAST(both_gmv AS DOUBLE) END) OVER () AS high
              FROM (SELECT *, seller_revenue + buyer_spend AS both_gmv FROM activity))"""


_BOTH = """SELECT *, seller_order_count + buyer_order_count AS both_order_count,
          CAST(seller_revenue + buyer_spend AS DECIMAL(21,2)) AS both_gmv FROM activity"""


def _lost(side: str, link: str) -> str:
    return f"""
        SELECT '{side}' AS side, COUNT(DISTINCT {side}_zip_code_prefix) AS missing_zips, COUNT(*) AS missing_rows,
          (SELECT COUNT(*) FROM m_items {link} JOIN m_{side}s USING ({side}_id)
           WHERE {side}_zip_code_prefix NOT IN (SELECT zip_code_prefix FROM zips)) AS lost_items
        FROM m_{side}s WHERE {side}_zip_code_prefix NOT IN (SELECT zip_code_prefix FROM zips)"""


def _checks() -> dict[str, tuple[dict[str, str], str]]:
    """Per query: relations of its own, and the final SELECT."""
    pair, item = _activity("pairs", 5), _activity("single", 5)
    routes, routes_item = _routes("pairs"), _routes("single")
    return {
        "table_row_counts": (
            {},
            f"SELECT COALESCE(name, 'TOTAL') AS table_name, CAST(SUM(n) AS BIGINT) AS row_count FROM ({_COUNTS}) "
            "GROUP BY ROLLUP (name)",
        ),
        "order_status_span": (
            {},
            f"""SELECT order_status, {_SPAN} FROM m_orders GROUP BY order_status
        UNION ALL
        SELECT 'delivered (trimmed)', {_SPAN} FROM m_orders
        WHERE order_status = 'delivered' AND date_trunc('month', order_purchase_timestamp) IN (
          SELECT date_trunc('month', order_purchase_timestamp) FROM m_orders WHERE order_status = 'delivered'
          GROUP BY 1 HAVING COUNT(*) >= {MIN_MONTH_ORDERS})""",
        ),
        "revenue_growth": ({}, "SELECT * FROM growth"),
        "revenue_growth_bucketed": ({}, "SELECT * FROM growth"),
        "revenue_growth_summary": (
            {},
            " UNION ALL ".join(
                [_summary_row("Minimum", "MIN"), _summary_row("Maximum", "MAX"), _summary_row("Average", "AVG")]
            ),
        ),
        "payment_method_breakdown": (
            {},
            f"""SELECT payment_type, COUNT(DISTINCT order_id) AS order_count,
          {_avg("payment_installments", "DECIMAL(4,1)")} AS avg_installments,
          CAST(SUM(payment_value) AS DECIMAL(20,2)) AS total_revenue
        FROM m_payments WHERE payment_type IS NOT NULL GROUP BY payment_type""",
        ),
        "avg_order_value_by_state": (
            {},
            "SELECT * FROM states WHERE order_count >= 100 ORDER BY avg_order_value DESC, customer_state LIMIT 10",
        ),
        "avg_order_value_by_state_500": (
            {},
            "SELECT * FROM states WHERE order_count >= 500 ORDER BY avg_order_value DESC, customer_state LIMIT 10",
        ),
        "avg_order_value_by_state_500_15": (
            {},
            "SELECT * FROM states WHERE order_count >= 500 ORDER BY avg_order_value DESC, customer_state LIMIT 15",
        ),
        "avg_order_value_by_state_strict": (
            {},
            "SELECT * FROM states WHERE order_count >= 1000 ORDER BY avg_order_value DESC, customer_state LIMIT 3",
        ),
        "avg_order_value_by_state_all": ({}, "SELECT * FROM states"),
        "category_revenue": (
            {},
            """SELECT COALESCE(product_category_name_english, product_category_name) AS category_english, total_revenue
        FROM (SELECT product_category_name, CAST(SUM(price + freight_value) AS DECIMAL(20,2)) AS total_revenue
              FROM m_items JOIN m_products USING (product_id) GROUP BY 1)
          LEFT JOIN m_translation USING (product_category_name)
        ORDER BY total_revenue DESC, product_category_name NULLS FIRST LIMIT 10""",
        ),
        "delivery_status": (
            {},
            f"""SELECT CASE WHEN order_delivered_customer_date IS NULL THEN 'Not Delivered Yet'
            WHEN order_delivered_customer_date <= order_estimated_delivery_date THEN 'On Time' ELSE 'Late'
            END AS DeliveryStatus, COUNT(*) AS OrderCount, {_SHARE} AS Percentage
        FROM m_orders WHERE order_status = 'delivered' GROUP BY 1""",
        ),
        "review_score_distribution": (
            {},
            f"""SELECT review_score AS ReviewScore, COUNT(*) AS TotalReviews,
          repeat('★', review_score) AS RatingLabel, {_SHARE} AS Percentage
        FROM m_reviews GROUP BY review_score""",
        ),
        "repeat_customers_by_month": (
            {
                "repeaters": """
        SELECT customer_unique_id FROM m_customers JOIN m_orders USING (customer_id)
        GROUP BY 1 HAVING COUNT(order_id) > 1"""
            },
            f"""SELECT strftime(order_purchase_timestamp, '%Y-%m') AS OrderMonth,
          COUNT(DISTINCT customer_unique_id) AS TotalCustomers,
          COUNT(DISTINCT CASE WHEN customer_unique_id IN (FROM repeaters) THEN customer_unique_id END)
            AS RepeatCustomers
        FROM m_customers JOIN m_orders USING (customer_id)
        WHERE order_purchase_timestamp >= TIMESTAMP '{START}' AND order_purchase_timestamp < TIMESTAMP '{END}'
        GROUP BY 1""",
        ),
        "order_status_breakdown": (
            {},
            "SELECT order_status, COUNT(*) AS TotalOrders FROM m_orders WHERE order_status <> 'delivered' GROUP BY 1",
        ),
        "top_sellers": (
            {},
            "SELECT 'Seller ' || Revenue_rank AS Seller_Alias, total_revenue, total_orders, avg_order_value "
            "FROM ranked WHERE Revenue_rank <= 10",
        ),
        "top_sellers_by_id": ({}, "SELECT * FROM ranked WHERE Revenue_rank <= 10"),
        "top_sellers_ties": (
            {},
            """SELECT 'Seller ' || Revenue_rank AS Seller_Alias, total_revenue, total_orders, avg_order_value FROM (
          SELECT CAST(SUM(price) AS DECIMAL(20,2)) AS total_revenue, COUNT(order_id) AS total_orders,
            CAST(SUM(price) AS DOUBLE) / COUNT(order_id) AS avg_order_value,
            RANK() OVER (ORDER BY SUM(price) DESC) AS Revenue_rank
          FROM (SELECT seller_id, MIN(order_id) AS order_id, CAST((seller_id + 2) // 3 AS DECIMAL(12,2)) AS price
                FROM m_items WHERE seller_id >= 0 GROUP BY seller_id) GROUP BY seller_id)
        WHERE Revenue_rank <= 10""",
        ),
        "top_categories_by_volume": (
            {},
            """SELECT COALESCE(c, 'Unknown') AS Category,
          COALESCE(product_category_name_english, 'Unknown') AS Category_English, n AS Total_items_sold
        FROM (SELECT product_category_name AS c, COUNT(*) AS n FROM m_items JOIN m_products USING (product_id) GROUP BY 1)
          LEFT JOIN m_translation ON product_category_name = c
        ORDER BY n DESC, c NULLS FIRST LIMIT 10""",
        ),
        "lead_conversion": (
            {},
            f"""SELECT origin, COUNT(DISTINCT c.mql_id) AS Converted_leads, COUNT(DISTINCT q.mql_id) AS Total_qualified_leads,
          {_rounded("CAST(COUNT(DISTINCT c.mql_id) * 100 AS DOUBLE) / COUNT(DISTINCT q.mql_id)", "DECIMAL(5,2)")}
            AS Conversion_rate_percent
        FROM m_qualified q LEFT JOIN m_closed c ON c.mql_id = q.mql_id GROUP BY origin
        ORDER BY Converted_leads DESC, origin LIMIT 5""",
        ),
        "converted_leads_by_origin": (
            {},
            """SELECT origin, COUNT(DISTINCT q.mql_id) AS converted_leads
        FROM m_qualified q JOIN m_closed c ON c.mql_id = q.mql_id GROUP BY origin""",
        ),
        "freight_by_weight_bucket": (
            {},
            f"""SELECT CASE WHEN product_weight_g < 500 THEN '< 500 g' WHEN product_weight_g <= 1999 THEN '500 g - 2 kg'
            WHEN product_weight_g BETWEEN 2000 AND 4999 THEN '2 - 5 kg' ELSE '5 kg +' END AS weight_bucket,
          COUNT(*) AS item_count, {_avg("product_weight_g", "DECIMAL(10,0)")} AS avg_weight_g,
          {_avg("freight_value", "DECIMAL(12,2)")} AS avg_freight_value
        FROM m_items JOIN m_products USING (product_id) WHERE product_weight_g IS NOT NULL GROUP BY 1""",
        ),
        "weight_freight_pairs": (
            {},
            "SELECT product_weight_g, freight_value FROM m_items JOIN m_products USING (product_id) "
            "WHERE product_weight_g IS NOT NULL AND freight_value IS NOT NULL",
        ),
        "weight_freight_correlation": (
            {},
            """SELECT COUNT(*) AS item_count,
          ROUND(corr(CAST(product_weight_g AS DOUBLE), CAST(freight_value AS DOUBLE)), 9) AS weight_freight_corr
        FROM m_items JOIN m_products USING (product_id) WHERE product_weight_g IS NOT NULL""",
        ),
        "zip_centroid": ({}, "SELECT * FROM zips"),
        "planar_distance_km": (
            {
                "points": f"""
        SELECT z.zip_code_prefix,
          {_distance("CAST(geolocation_lat AS DOUBLE)", "CAST(geolocation_lng AS DOUBLE)", "lat", "lng")} AS km
        FROM m_geolocation JOIN zips z ON z.zip_code_prefix = geolocation_zip_code_prefix"""
            },
            "SELECT zip_code_prefix, ROUND(MIN(km), 6) AS nearest_km, ROUND(MAX(km), 6) AS farthest_km "
            "FROM points GROUP BY 1",
        ),
        "order_geo": ({}, "SELECT * FROM geo"),
        "top_city_routes": ({}, _top_city_routes("pairs")),
        "top_city_routes_item": ({}, _top_city_routes("single")),
        "normalize_city": (
            {},
            "SELECT DISTINCT city, strip_accents(LOWER(TRIM(city))) AS normalized FROM raw_cities",
        ),
        "city_key": ({}, f"SELECT city, state, {_key('city', 'state')} AS city_key FROM raw_cities"),
        "city_observations": ({}, "SELECT * FROM people"),
        "city_centroids": ({}, "SELECT * FROM centroids"),
        "centroid_search": ({}, "SELECT * FROM centroids WHERE contains(city_key, 'nation_1')"),
        "seller_city_stats": ({}, _city_stats("pairs", "seller", "total_revenue", 5)),
        "seller_city_stats_min300": ({}, _city_stats("pairs", "seller", "total_revenue", 300)),
        "seller_city_stats_item": ({}, _city_stats("single", "seller", "total_revenue", 5)),
        "buyer_city_stats": ({}, _city_stats("pairs", "customer", "total_spend", 5)),
        "buyer_city_stats_min60": ({}, _city_stats("pairs", "customer", "total_spend", 60)),
        "buyer_city_stats_item": ({}, _city_stats("single", "customer", "total_spend", 5)),
        "merge_city_stats": (
            {"buyers": _city_stats("pairs", "customer", "total_spend", 60)},
            _merged("buyers", "customer", "total_spend"),
        ),
        "city_activity": (pair, "SELECT * FROM activity"),
        "stored_city_activity": (pair, "SELECT * FROM activity"),
        "city_activity_item": (item, "SELECT * FROM activity"),
        "city_activity_merged": (_activity("pairs", 1, 200), "SELECT * FROM activity"),
        "route_stats": ({}, _route_stats("(SELECT * FROM pairs WHERE seller_city IS NOT NULL)")),
        "trade_routes": (routes, "SELECT * FROM routes"),
        "stored_trade_routes": (routes, "SELECT * FROM routes"),
        "trade_routes_item": (routes_item, "SELECT * FROM routes"),
        "city_search": (
            pair,
            "SELECT * FROM activity WHERE contains(LOWER(city), 'nation_1') "
            "ORDER BY seller_order_count DESC, city_key LIMIT 8",
        ),
        "city_both_metrics": (pair, _BOTH),
        "cities_in_view": (
            _activity("pairs", 700),
            "SELECT * FROM activity WHERE lat <> 0 AND lng <> 0 AND seller_order_count <> 0",
        ),
        "metric_scale": (pair, _scaled("low", "high")),
        "route_scale": (
            routes,
            """SELECT seller_key, customer_key, total_revenue, ROUND(1 + LEAST(share * 6, 6), 9) AS weight,
          ROUND(share, 9) AS intensity
        FROM (SELECT *, CAST(total_revenue AS DOUBLE) / MAX(CAST(total_revenue AS DOUBLE)) OVER () AS share
              FROM (FROM routes ORDER BY total_revenue DESC, seller_key, customer_key LIMIT 50))""",
        ),
        "top_routes": (
            routes,
            "SELECT * FROM routes ORDER BY avg_distance_km DESC, seller_key, customer_key LIMIT 50",
        ),
        "top_routes_per_city": (
            routes,
            _per_city(f"CASE WHEN {_SOLD} THEN seller_key END", "order_count"),
        ),
        "top_routes_per_city_buyer": (
            routes,
            _per_city(f"CASE WHEN {_BOUGHT} THEN customer_key WHEN {_SOLD} THEN seller_key END", "avg_freight"),
        ),
        "top_routes_per_city_both": (
            routes,
            _per_city(f"CASE WHEN {_SOLD} OR {_BOUGHT} THEN seller_key END", "total_revenue"),
        ),
        "cities_on_routes": (
            pair
            | routes
            | {"busiest": "SELECT * FROM routes ORDER BY order_count DESC, seller_key, customer_key LIMIT 10"},
            "SELECT * FROM activity WHERE city_key IN "
            "(SELECT seller_key FROM busiest UNION SELECT customer_key FROM busiest)",
        ),
        "route_destinations": (
            routes
            | {"busiest": "SELECT * FROM routes ORDER BY order_count DESC, seller_key, customer_key LIMIT 40"},
            """SELECT customer_key AS key, customer_city AS city, customer_state AS state,
          customer_lat AS lat, customer_lng AS lng
        FROM busiest QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_key ORDER BY order_count DESC, seller_key) = 1""",
        ),
        "profile_table": ({"profile": _PROFILE}, "SELECT *, CAST(NULL AS VARCHAR) AS sanity_check FROM profile"),
        "profile_from_states": (
            {"profile": _PROFILE},
            f"SELECT * EXCLUDE (distinct_count) FROM profile WHERE table_name IN ({', '.join(repr(name) for name in MERGED)})",
        ),
        "sanity_rules": ({"profile": _PROFILE}, _SANITY),
        "profile_report": ({"profile": _PROFILE}, _SANITY),
        "check_primary_key": (
            {},
            """SELECT 'order_items' AS table_name, 'order_id,order_item_id' AS key_columns, COUNT(*) AS row_count,
          COUNT(DISTINCT (order_id, order_item_id)) AS distinct_keys,
          COUNT(*) - COUNT(DISTINCT (order_id, order_item_id)) AS duplicate_rows,
          CAST(0 AS BIGINT) AS null_key_rows, FALSE AS is_valid
        FROM m_items""",
        ),
        "primary_key_violations": (
            {},
            "SELECT review_id, COUNT(*) AS row_count FROM m_reviews GROUP BY review_id HAVING COUNT(*) > 1",
        ),
        "check_foreign_key": (
            {},
            """SELECT customer_zip_code_prefix AS orphan_key, COUNT(*) AS row_count FROM m_customers
        WHERE customer_zip_code_prefix NOT IN (SELECT geolocation_zip_code_prefix FROM m_geolocation) GROUP BY 1""",
        ),
        "check_primary_keys": ({}, "\n        UNION ALL".join(map(_checked_key, PRIMARY_KEYS))),
        "check_foreign_keys": ({}, "\n        UNION ALL".join(_orphans(*relation) for relation in FOREIGN_KEYS)),
        "zip_coverage": (
            {},
            _lost("customer", "JOIN m_orders USING (order_id)") + "\n        UNION ALL" + _lost("seller", ""),
        ),
        "continue_surrogate_key": (
            {},
            """SELECT review_row_id, review_id, review_key FROM m_reviews JOIN (
          SELECT review_id, ROW_NUMBER() OVER (ORDER BY odd, review_id) AS review_key
          FROM (SELECT review_id, BOOL_AND(review_row_id % 2 = 1) AS odd FROM m_reviews GROUP BY review_id)) USING (review_id)""",
        ),
        "add_surrogate_key": (
            {},
            """SELECT review_id, review_score, CAST(review_score AS VARCHAR) AS score_text,
          ROW_NUMBER() OVER (ORDER BY review_id, review_score) AS review_key FROM m_reviews""",
        ),
    }


def _checked_key(table: str) -> str:
    key = PRIMARY_KEYS[table]
    bad = " OR ".join(f"{name} IS NULL" for name in key)
    return f"""
        SELECT '{table}' AS table_name, '{",".join(key)}' AS key_columns, CAST(COALESCE(SUM(c), 0) AS BIGINT) AS row_count,
          COUNT(*) FILTER (WHERE NOT bad) AS distinct_keys,
          CAST(COALESCE(SUM(c - 1) FILTER (WHERE NOT bad), 0) AS BIGINT) AS duplicate_rows,
          CAST(COALESCE(SUM(c) FILTER (WHERE bad), 0) AS BIGINT) AS null_key_rows,
          COALESCE(bool_and(NOT bad AND c = 1), TRUE) AS is_valid
        FROM (SELECT {bad} AS bad, COUNT(*) AS c FROM {_ROLE_NAMES[table]} GROUP BY {", ".join(key)})"""


def _orphans(child: str, column: str, parent: str, parent_column: str) -> str:
    return f"""
        SELECT '{child}' AS child_table, '{column}' AS child_column, '{parent}' AS parent_table,
          CAST(x.{column} AS VARCHAR) AS orphan_key, COUNT(*) AS row_count FROM {_ROLE_NAMES[child]} x
        WHERE x.{column} IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM {_ROLE_NAMES[parent]} y WHERE y.{parent_column} = x.{column})
        GROUP BY x.{column}"""


def _used(sql: str, relations: dict[str, str]) -> list[str]:
    return [name for name in relations if re.search(rf"\b{name}\b", sql)]


def _with(relations: dict[str, str], final: str) -> str:
    """The final SELECT below a WITH clause of the relations it needs, dependencies first."""
    ordered: list[str] = []

    def add(sql: str, own: str | None = None) -> None:
        for name in _used(sql, relations):
            if name != own and name not in ordered:
                add(relations[name], name)
                ordered.append(name)

    add(final)
    clauses = ",\n".join(f"{name} AS ({relations[name].rstrip()})" for name in ordered)
    return f"WITH {clauses}\n{final.strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: _with(MAPPING | _SHARED | own, final) for name, (own, final) in _checks().items()}
