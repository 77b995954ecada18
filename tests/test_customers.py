from decimal import Decimal as D

from conftest import rows
from test_sales import order

from tradewind.operators import customers as ops


def test_delivery_outcomes(table):
    def delivered(key, actual, promised="2017-02-01 00:00:00", status="delivered"):
        return order(
            key,
            "2017-01-01 00:00:00",
            status,
            order_delivered_customer_date=actual,
            order_estimated_delivery_date=promised,
        )

    orders = table(
        "orders",
        [
            delivered("1", "2017-02-01 00:00:00"),
            delivered("2", "2017-02-01 00:00:01"),
            delivered("3", None),
            delivered("4", "2017-01-20 00:00:00"),
            delivered("5", "2017-01-20 00:00:00", status="shipped"),
        ],
    )
    assert sorted(rows(ops.delivery_status(orders))) == [
        ("Late", 1, D("25.00")),
        ("Not Delivered Yet", 1, D("25.00")),
        ("On Time", 2, D("50.00")),
    ]


def test_review_scores(table):
    reviews = table("order_reviews", [{"review_id": str(k), "review_score": s} for k, s in enumerate([5, 5, 1, None])])
    assert rows(ops.review_score_distribution(reviews)) == [
        (5, 2, "★★★★★", D("50.00")),
        (1, 1, "★", D("25.00")),
        (None, 1, None, D("25.00")),
    ]


def test_repeaters_count_over_all_time(table):
    people = table(
        "customers",
        [{"customer_id": f"c{k}", "customer_unique_id": p} for k, p in enumerate(["ana", "ana", "bia", "eva", "eva"])],
    )
    orders = table(
        "orders",
        [
            order("1", "2017-01-01 00:00:00", customer="c0"),
            order("2", "2019-01-01 00:00:00", customer="c1"),  # outside the window, makes ana a repeater
            order("3", "2017-01-02 00:00:00", "canceled", customer="c2"),
            order("4", "2017-02-01 00:00:00", customer="c3"),
            order("5", "2017-02-02 00:00:00", customer="c4"),
        ],
    )
    assert rows(ops.repeat_customers_by_month(people, orders)) == [("2017-01", 2, 1), ("2017-02", 1, 1)]


def test_status_breakdown_leaves_one_out(table):
    orders = table(
        "orders",
        [order(str(k), None, s) for k, s in enumerate(["delivered", "shipped", "shipped", "canceled", None])],
    )
    assert rows(ops.order_status_breakdown(orders)) == [("shipped", 2), ("canceled", 1)]
