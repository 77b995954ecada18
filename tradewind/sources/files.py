"""Parquet and CSV tables in, JSON out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.schema import TABLES
from tradewind.sources.records import csv_records

_RAGGED = "_corrupt_record"


@dataclass(frozen=True)
class CsvTable:
    """Typed rows, and the raw rows that do not fit the declared types."""

    rows: DataFrame
    quarantine: DataFrame


def read_parquet_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The declared tables from ``folder/<table>.parquet``."""
    return {
        name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet") for name in names or TABLES
    }


def _typed(text: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return text
    return F.nullif(F.trim(text), F.lit("")).try_cast(data_type)


def read_csv_table(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = True, whole_files: bool = False
) -> CsvTable:
    """One CSV table, typed by ``schema``.

    With ``multi_line`` cells may hold quoted newlines; large files are split all the same, by
    ``csv_records``, which takes lines to end in a newline, alone or after a carriage return, and
    every quote to open, close or (doubled) stand in a quoted cell. ``whole_files`` reads files that
    break these rules, each in one task.

    Columns are found by the names in the header, whatever their order, and others are
    left out; without a header the file holds the columns of ``schema`` in order. Cells
    are read as text and cast one by one, which also takes numbers in scientific
    notation. A row with a cell that does not cast, without a required value or with
    the wrong number of cells goes to quarantine, as text.
    """
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAGGED}
    reader = spark.read.option("header", header).option("multiLine", multi_line).options(**options)
    names = reader.csv(path).columns if header else schema.names
    missing = [name for name in schema.names if name not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _RAGGED]])
    if multi_line and not whole_files:
        parsed = F.from_csv("record", ", ".join(f"`{f.name.replace('`', '``')}` string" for f in as_text), options)
        raw = csv_records(spark, path, header).select(parsed.alias("row")).select("row.*")
    else:
        raw = reader.schema(as_text).csv(path)
    bad = F.col(_RAGGED).isNotNull()
    for field in schema:
        text, value = F.col(field.name), _typed(F.col(field.name), field.dataType)
        bad = bad | (value.isNull() & (F.trim(F.coalesce(text, F.lit(""))) != ""))
        if not field.nullable:
            bad = bad | value.isNull()
    typed = [_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema]
    return CsvTable(rows=raw.where(~bad).select(*typed), quarantine=raw.where(bad))


def read_csv_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, CsvTable]:
    """The declared tables from ``folder/<table>.csv`` (a file or a folder of files)."""
    return {name: read_csv_table(spark, f"{folder}/{name}.csv", TABLES[name]) for name in names or TABLES}


def export_json(df: DataFrame, path: str) -> None:
    """Writes JSON Lines, one file per partition."""
    df.write.mode("overwrite").json(path)
