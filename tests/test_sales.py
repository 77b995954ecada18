from datetime import date
from decimal import Decimal as D

import pytest
from conftest import rows

from tradewind.operators import sales
from tradewind.schema import CATEGORY_LABELS, STATE_NAMES


def order(order_id, moment, status="delivered", customer="c1", **extra):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "order_status": status,
        "order_purchase_timestamp": moment,
        **extra,
    }


def item(order_id, price, freight=0, number=1, product="p1", seller="s1"):
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": product,
        "seller_id": seller,
        "price": price,
        "freight_value": freight,
    }


def test_row_counts_end_with_the_total(spark):
    tables = {"b": spark.range(3), "a": spark.range(2), "c": spark.range(0)}
    assert rows(sales.table_row_counts(tables)) == [("a", 2), ("b", 3), ("c", 0), ("TOTAL", 5)]


def test_span_counts_month_boundaries(table):
    orders = table("orders", [order("1", "2017-01-31 10:00:00"), order("2", "2017-02-01 09:00:00")])
    got = {row[0]: row[1:] for row in rows(sales.order_status_span(orders, 1))}
    assert got["delivered"] == (2, date(2017, 1, 31), date(2017, 2, 1), 0, 1)
    assert got["delivered (trimmed)"] == got["delivered"]


def test_span_divides_months_as_integers(table):
    orders = table("orders", [order("1", "2016-01-15 00:00:00", "shipped"), order("2", "2018-02-01 00:00:00", "shipped")])
    got = {row[0]: row[1:] for row in rows(sales.order_status_span(orders, 1))}
    assert got["shipped"][-2:] == (2, 1)


def test_trimmed_row_stays_without_busy_months(table):
    orders = table("orders", [order("1", "2017-01-31 10:00:00"), order("2", None, None)])
    got = {row[0]: row[1:] for row in rows(sales.order_status_span(orders, 2))}
    assert got["delivered (trimmed)"] == (0, None, None, None, None)
    assert got[None][0] == 1


def test_trimming_drops_quiet_months_only(table):
    orders = table(
        "orders",
        [order(str(k), f"2017-03-0{k} 00:00:00") for k in range(1, 4)]
        + [order("9", "2017-05-01 00:00:00"), order("10", "2017-03-09 00:00:00", "shipped")],
    )
    got = {row[0]: row[1:] for row in rows(sales.order_status_span(orders, 3))}
    assert got["delivered"][0] == 4
    assert got["delivered (trimmed)"] == (3, date(2017, 3, 1), date(2017, 3, 3), 0, 0)


@pytest.fixture
def gap_months(table):
    orders = table(
        "orders",
        [
            order("1", "2017-01-05 00:00:00"),
            order("2", "2017-03-05 00:00:00"),
            order("3", "2017-03-06 00:00:00"),
            order("4", "2017-04-05 00:00:00"),
            order("5", "2017-04-05 00:00:00", "shipped"),
            order("6", "2018-09-01 00:00:00"),
            order("7", "2017-04-05 00:00:00"),
        ],
    )
    items = table(
        "order_items",
        [
            item("1", 80, 20),
            item("2", 100),
            item("2", 30, 20, 2),
            item("3", 50),
            item("4", 100),
            item("5", 999),
            item("6", 999),
        ],
    )
    return orders, items


def test_growth_lags_to_the_previous_present_month(gap_months):
    assert rows(sales.revenue_growth(*gap_months)) == [
        (2017, 1, 1, D("100.00"), None, D("0.0")),
        (2017, 3, 2, D("200.00"), D("100.0"), D("100.0")),
        (2017, 4, 1, D("100.00"), D("-50.0"), D("0.0")),
    ]


def test_growth_summary_skips_missing_growth(gap_months):
    growth = sales.revenue_growth(*gap_months)
    assert rows(sales.revenue_growth_summary(growth)) == [
        ("Minimum", D("1"), D("100.00"), D("-50.0"), D("0.0")),
        ("Maximum", D("2"), D("200.00"), D("100.0"), D("100.0")),
        ("Average", D("1"), D("133.33"), D("25.0"), D("33.3")),
    ]


def test_payment_types_without_null(table):
    payments = table(
        "order_payments",
        [
            {"order_id": "1", "payment_type": "card", "payment_installments": 1, "payment_value": 10},
            {"order_id": "1", "payment_type": "card", "payment_installments": 2, "payment_value": 5},
            {"order_id": "2", "payment_type": "card", "payment_installments": None, "payment_value": 1},
            {"order_id": "2", "payment_type": None, "payment_installments": 9, "payment_value": 9},
        ],
    )
    assert rows(sales.payment_method_breakdown(payments)) == [("card", 2, D("1.5"), D("16.00"))]


@pytest.fixture
def states(table):
    places = {"SP": 3, "RJ": 2, "AM": 1, "XX": 5}
    orders, customers, items = [], [], []
    for state, count in places.items():
        customers.append({"customer_id": state, "customer_state": state})
        for k in range(count):
            orders.append(order(f"{state}{k}", "2017-05-01 00:00:00", customer=state))
            items += [item(f"{state}{k}", 10 * count, 1), item(f"{state}{k}", 20, 1, 2)]
    return table("orders", orders), table("customers", customers), table("order_items", items)


def test_state_averages_are_per_item(states):
    got = rows(sales.avg_order_value_by_state(*states, min_orders=2))
    assert got == [
        ("SP", "Sao Paulo", 3, D("25.00"), D("1.00"), D("26.00")),
        ("RJ", "Rio de Janeiro", 2, D("20.00"), D("1.00"), D("21.00")),
    ]


@pytest.mark.parametrize(
    ("min_orders", "top_n", "expected"),
    [(100, 10, []), (1, 1, ["SP"]), (2, 15, ["SP", "RJ"]), (None, None, ["SP", "RJ", "AM"])],
)
def test_state_parameters(states, min_orders, top_n, expected):
    got = sales.avg_order_value_by_state(*states, min_orders=min_orders, top_n=top_n)
    assert [row[0] for row in rows(got)] == expected


def test_fixed_tables_are_complete():
    assert len(STATE_NAMES) == len(dict(STATE_NAMES)) == 27
    assert len(CATEGORY_LABELS) == len(dict(CATEGORY_LABELS)) == 10


def test_category_revenue_counts_every_status_and_falls_back(table):
    items = table("order_items", [item("1", 5, 1), item("2", 7, 0, product="p2"), item("3", 1, 0, product="p3")])
    products = table(
        "products",
        [{"product_id": "p1", "product_category_name": "a"}, {"product_id": "p2", "product_category_name": "b"}, {"product_id": "p3"}],
    )
    words = table(
        "product_category_name_translation",
        [{"product_category_name": "a", "product_category_name_english": "A!"}],
    )
    assert rows(sales.category_revenue(items, products, words)) == [
        ("b", D("7.00")),
        ("A!", D("6.00")),
        (None, D("1.00")),
    ]
    assert sales.category_revenue(items, products, words, n=2).count() == 2
