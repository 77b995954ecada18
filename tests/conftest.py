from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tradewind.schema import TABLES  # noqa: E402
from tradewind.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[4]",
        cores=4,
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def cell(value, data_type):
    """Readable literals for the typed tables: text for moments, numbers for decimals."""
    if value is None:
        return None
    kind = data_type.typeName()
    if kind == "timestamp":
        return datetime.fromisoformat(value)
    if kind == "decimal":
        return Decimal(str(value))
    return value


@pytest.fixture
def table(spark):
    """table(name, [{column: value}]) with the declared schema; missing columns are NULL."""

    def build(name: str, rows: list[dict]):
        schema = TABLES[name]
        filled = [tuple(cell(row.get(f.name), f.dataType) for f in schema) for row in rows]
        return spark.createDataFrame(filled, schema)

    return build


def rows(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
