from decimal import Decimal as D

import numpy as np
import pytest
from conftest import rows
from test_sales import item

from tradewind.operators import sellers as ops


@pytest.fixture
def tied_sellers(table):
    # nine distinct revenues, then three sellers tied at rank 10
    revenues = [100 - k for k in range(9)] + [50, 50, 50, 1]
    return table("order_items", [item(str(k), v, seller=f"s{k:02d}") for k, v in enumerate(revenues)])


def test_rank_keeps_ties(tied_sellers):
    got = rows(ops.top_sellers(tied_sellers, alias=False))
    assert len(got) == 12
    assert [row[-1] for row in got] == [*range(1, 10), 10, 10, 10]
    assert rows(ops.top_sellers(tied_sellers))[-1] == ("Seller 10", D("50.00"), 1, 50.0)


def test_rank_when_all_tie(table):
    items = table("order_items", [item(str(k), 5, seller=f"s{k:02d}") for k in range(30)])
    assert {row[-1] for row in rows(ops.top_sellers(items, n=3, alias=False))} == {1}
    assert ops.top_sellers(items, n=3).count() == 30


def test_seller_value_is_per_order(table):
    items = table("order_items", [item("1", 10), item("1", 20, number=2), item("2", 30)])
    assert rows(ops.top_sellers(items, alias=False)) == [("s1", D("60.00"), 2, 30.0, 1)]


def test_volume_labels(table):
    items = table("order_items", [item(str(k), 1, product=p) for k, p in enumerate(["a", "a", "a", "b", "b", "c"])])
    products = table(
        "products",
        [
            {"product_id": "a", "product_category_name": "telefonia"},
            {"product_id": "b", "product_category_name": "outra"},
            {"product_id": "c"},
        ],
    )
    assert rows(ops.top_categories_by_volume(items, products)) == [
        ("telefonia", "Phone", 3),
        ("outra", "Unknown", 2),
        ("Unknown", "Unknown", 1),
    ]


@pytest.fixture
def leads(table):
    qualified = table(
        "leads_qualified",
        [{"mql_id": m, "origin": o} for m, o in [("1", "web"), ("2", "web"), ("3", "web"), ("4", "mail"), ("5", None), ("6", "fair")]],
    )
    # repeated closings must not multiply leads
    closed = table("leads_closed", [{"mql_id": m} for m in ["1", "1", "1", "2", "4", "5", "99", None]])
    return qualified, closed


def test_lead_conversion(leads):
    assert rows(ops.lead_conversion(*leads)) == [
        ("web", 2, 3, D("66.67")),
        (None, 1, 1, D("100.00")),
        ("mail", 1, 1, D("100.00")),
        ("fair", 0, 1, D("0.00")),
    ]
    assert ops.lead_conversion(*leads, n=2).count() == 2


def test_converted_leads_leave_out_origins_without_one(leads):
    assert rows(ops.converted_leads_by_origin(*leads)) == [("web", 2), (None, 1), ("mail", 1)]


@pytest.fixture
def weighed(table):
    weights = {"a": 499, "b": 500, "c": 1999, "d": 2000, "e": 4999, "f": 5000, "g": None}
    products = table("products", [{"product_id": p, "product_weight_g": w} for p, w in weights.items()])
    items = table(
        "order_items",
        [item(str(k), 1, freight, product=p) for k, (p, freight) in enumerate(zip("aabcdefg", [1, 4, 2, 3, 9, 5, None, 7], strict=True))],
    )
    return items, products


def test_weight_buckets(weighed):
    assert rows(ops.freight_by_weight_bucket(*weighed)) == [
        ("< 500 g", 2, D("499"), D("2.50")),
        ("500 g - 2 kg", 2, D("1250"), D("2.50")),
        ("2 - 5 kg", 2, D("3500"), D("7.00")),
        ("5 kg +", 1, D("5000"), None),
    ]


def test_weight_freight_pairs(weighed):
    pairs = [(2000, D("9.00")), (4999, D("5.00")), (499, D("4.00")), (1999, D("3.00")), (500, D("2.00")), (499, D("1.00"))]
    assert rows(ops.weight_freight_pairs(*weighed)) == pairs
    assert rows(ops.weight_freight_pairs(*weighed, n=2)) == pairs[:2]


def test_correlation_equals_that_of_the_pairs(weighed, table):
    pairs = np.array(rows(ops.weight_freight_pairs(*weighed)), dtype=float)
    n, value = rows(ops.weight_freight_correlation(*weighed))[0]
    assert n == len(pairs)
    assert value == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-12)
    flat = table("order_items", [item("1", 1, 5, product="a"), item("2", 1, 5, product="f")])
    assert rows(ops.weight_freight_correlation(flat, weighed[1])) == [(2, None)]
