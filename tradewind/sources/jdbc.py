"""Tables over JDBC, read in parallel ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("url", "user", "password", "driver")


@dataclass(frozen=True)
class Split:
    """A numeric or date column by whose range the reads of a table are divided."""

    column: str
    lower: str
    upper: str
    partitions: int


def jdbc_options(settings: dict[str, str | None], table: str, split: Split | None = None) -> dict[str, str]:
    """Reader options of one table; missing settings are named together in one error."""
    missing = [name for name in REQUIRED if not settings.get(name)]
    if missing:
        raise ValueError(f"missing connection settings: {', '.join(missing)}")
    options = {name: value for name, value in settings.items() if value}
    options["dbtable"] = table
    options.setdefault("fetchsize", "10000")
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.partitions),
        }
    return options


def read_jdbc_tables(
    spark: SparkSession,
    settings: dict[str, str | None],
    tables: list[str],
    splits: dict[str, Split] | None = None,
) -> dict[str, DataFrame]:
    """The named tables; one with an entry in ``splits`` is read by that many tasks."""
    splits = splits or {}
    return {
        table: spark.read.format("jdbc").options(**jdbc_options(settings, table, splits.get(table))).load()
        for table in tables
    }
