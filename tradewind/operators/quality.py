"""Sanity rules over profiles, key checks and coverage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.operators.profile import PROFILE_COLUMNS, contains_unordered, profile_table, profile_tables, quoted
from tradewind.sources.checkpoints import checkpointed

__all__ = [
    "PROFILE_COLUMNS",
    "add_surrogate_key",
    "check_foreign_key",
    "check_foreign_keys",
    "check_primary_key",
    "check_primary_keys",
    "primary_key_violations",
    "profile_report",
    "profile_table",
    "profile_tables",
    "sanity_rules",
    "zip_coverage",
]


def _whole_number(text: Column, width: str = "bigint") -> Column:
    return text.try_cast(width)


def _out_of_range(kind: str, low: int, high: int) -> tuple[Column, Column]:
    smallest, largest = _whole_number(F.col("min_val")), _whole_number(F.col("max_val"))
    condition = (F.col("full_type") == kind.lower()) & ((smallest < low) | (largest > high))
    return condition, _range_warning(f"value out of {kind} range")


def _range_warning(text: str) -> Column:
    return F.concat(
        F.lit(f"WARN: {text} (min="),
        F.coalesce("min_val", F.lit("null")),
        F.lit(", max="),
        F.coalesce("max_val", F.lit("null")),
        F.lit(")"),
    )


def _too_long(kind: str) -> tuple[Column, Column]:
    declared = _whole_number(F.regexp_extract("full_type", rf"^{kind}\(([0-9]+)\)", 1), "int")
    observed = _whole_number(F.replace("extra_stat", F.lit("max_len="), F.lit("")), "int")
    condition = F.col("full_type").rlike(rf"^{kind}\([0-9].*\)$") & (observed > declared)
    message = F.concat(
        F.lit("WARN: max_len "), observed.cast("string"), F.lit(" exceeds declared "), F.col("full_type")
    )
    return condition, message


def sanity_rules(profile: DataFrame) -> DataFrame:
    """Sets ``sanity_check`` from the measured values and the declared types.

    Of several rules that fire the last one listed counts, and errors outrank all.
    """
    # Texts of the warnings, ranges of the integer types and of plausible dates.
    rules = [
        _too_long("nvarchar"),
        _too_long("varchar"),
        _out_of_range("INT", -(2**31), 2**31 - 1),
        _out_of_range("SMALLINT", -(2**15), 2**15 - 1),
        _out_of_range("TINYINT", 0, 255),
    ]
    digits = F.length(F.regexp_extract("max_val", r"\.(.*)$", 1))
    scale = _whole_number(F.regexp_extract("full_type", r"^decimal\([^,]*,([^)]*)\)", 1), "int")
    rules.append(
        (
            F.col("full_type").rlike(r"^decimal\(.*,.*\)$") & F.col("max_val").contains(".") & (digits > scale),
            F.concat(
                F.lit("WARN: fractional digits in max_val ("),
                F.col("max_val"),
                F.lit(") may exceed scale in "),
                F.col("full_type"),
            ),
        )
    )
    earliest, latest = F.col("min_val").try_cast("timestamp_ntz"), F.col("max_val").try_cast("timestamp_ntz")
    rules.append(
        (
            F.col("full_type").isin("date", "datetime2")
            & ((earliest < F.lit("2000-01-01")) | (latest > F.lit("2030-01-01"))),
            _range_warning("date out of expected range 2000-2030"),
        )
    )
    rules.append((F.col("extra_stat").startswith("ERROR:"), F.col("extra_stat")))
    verdict = F.lit("OK")
    for condition, message in rules:
        verdict = F.when(condition, message).otherwise(verdict)
    return profile.withColumn("sanity_check", verdict)


def profile_report(profile: DataFrame) -> DataFrame:
    """Warnings and errors first, then by table and column."""
    raised = F.col("sanity_check").startswith("WARN") | F.col("sanity_check").startswith("ERROR")
    return profile.orderBy(F.when(raised, 0).otherwise(1), "table_name", "column_name")


def check_primary_key(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Rows, distinct keys, surplus rows and rows with a NULL in the key, as one row."""
    null_key = reduce(lambda a, b: a | b, [F.col(quoted(name)).isNull() for name in key])
    counted = df.groupBy(*[quoted(name) for name in key]).agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(null_key.alias("null_key"), "copies").agg(
        F.lit(table).alias("table_name"),
        F.lit(",".join(key)).alias("key_columns"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count_if(~F.col("null_key")).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(~F.col("null_key"), F.col("copies") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("null_key"), F.col("copies"))), F.lit(0)).alias("null_key_rows"),
    ).withColumn("is_valid", (F.col("duplicate_rows") == 0) & (F.col("null_key_rows") == 0))


def check_primary_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]]) -> DataFrame:
    """``check_primary_key`` of every declared key, one row each."""
    return reduce(DataFrame.unionByName, [check_primary_key(tables[name], name, key) for name, key in keys.items()])


def primary_key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL, with their number of rows."""
    null_key = reduce(lambda a, b: a | b, [F.col(quoted(name)).isNull() for name in key])
    counted = df.groupBy(*[quoted(name) for name in key]).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where((F.col("row_count") > 1) | null_key)


def _counted_in_batches(df: DataFrame, column: str) -> DataFrame:
    """Non-null values of a column as ``orphan_key`` with their rows, equal ones of an Arrow batch as one row.

    A value of many rows leaves its task as few, and nothing but a batch is held.
    """
    values = df.select(F.col(quoted(column)).alias("orphan_key")).where(F.col("orphan_key").isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            try:
                found = keys.value_counts()
                keys, counts = found.field("values"), found.field("counts")
            except pa.ArrowNotImplementedError:  # structs and the like
                counts = pa.array([1] * len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, counts], ["orphan_key", "row_count"])

    return values.mapInArrow(counted, T.StructType([values.schema["orphan_key"], T.StructField("row_count", T.LongType())]))


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null child values without a parent, with their number of child rows.

    Values of one type on both sides are counted a batch at a time, dealt out over all shuffle partitions
    and meet in one aggregate: a task holds each value of its partition once, and adaptive execution does not
    put partitions together by their packed size. Other types are joined, as Spark compares them.
    """
    uses, keys = _counted_in_batches(child, column), _counted_in_batches(parent, parent_column)
    if uses.schema["orphan_key"].dataType == keys.schema["orphan_key"].dataType:
        partitions = int(child.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        values = uses.unionByName(keys.withColumn("row_count", F.lit(0).cast("long")))  # a key counts for no row
        counted = values.repartition(partitions, "orphan_key").groupBy("orphan_key")
        found = counted.agg(F.sum("row_count").alias("row_count"), F.min("row_count").alias("least"))
        return found.where(F.col("least") > 0).drop("least")
    used = (
        child.where(F.col(quoted(column)).isNotNull())
        .groupBy(F.col(quoted(column)).alias("orphan_key"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    known = parent.select(F.col(quoted(parent_column)).alias("orphan_key")).distinct()
    return used.join(known, "orphan_key", "left_anti")


def check_foreign_keys(
    tables: Mapping[str, DataFrame], relations: Iterable[tuple[str, str, str, str]]
) -> DataFrame:
    """``check_foreign_key`` of every declared relation: child, column and parent, the key as text, its child rows."""
    found = [
        check_foreign_key(tables[child], column, tables[parent], parent_column).select(
            F.lit(child).alias("child_table"),
            F.lit(column).alias("child_column"),
            F.lit(parent).alias("parent_table"),
            F.col("orphan_key").cast("string").alias("orphan_key"),
            "row_count",
        )
        for child, column, parent, parent_column in relations
    ]
    return reduce(DataFrame.unionByName, found)


def zip_coverage(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    geolocation: DataFrame,
) -> DataFrame:
    """Zip codes of customers and sellers that geolocation lacks, their rows and the order items lost with them.

    A missing zip code of its own, NULL, counts as one. People and their items are
    summed per zip code before the comparison.
    """
    known = geolocation.select(F.col("geolocation_zip_code_prefix").alias("zip")).distinct()
    per_order = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("items"))
    per_customer = (
        orders.select("order_id", "customer_id")
        .join(per_order, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("items").alias("items"))
    )
    per_seller = items.groupBy("seller_id").agg(F.count(F.lit(1)).alias("items"))

    def summary(side: str, people: DataFrame, sold: DataFrame) -> DataFrame:
        per_zip = (
            people.join(sold, f"{side}_id", "left")
            .groupBy(F.col(f"{side}_zip_code_prefix").alias("zip"))
            .agg(F.count(F.lit(1)).alias("people"), F.sum("items").alias("items"))
        )
        return per_zip.join(known, "zip", "left_anti").agg(
            F.lit(side).alias("side"),
            F.count(F.lit(1)).alias("missing_zips"),
            F.expr("coalesce(sum(people), 0) as missing_rows"),
            F.expr("coalesce(sum(items), 0) as lost_items"),
        )

    return summary("customer", customers, per_customer).unionByName(summary("seller", sellers, per_seller))


_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def add_surrogate_key(df: DataFrame, name: str, order_by: list[str]) -> DataFrame:
    """Adds a dense row number from 1 in the stated order, without bringing rows into one task.

    Rows are range-sorted once and cut off by a checkpoint, so both uses below see
    the same partitions. A row's number is its place in its partition plus the rows
    of all partitions before it; only one count per partition is ranked centrally.
    """
    hashable = [quoted(f.name) for f in df.schema.fields if not contains_unordered(f.dataType)]
    tie = F.expr(f"xxhash64({', '.join(hashable)})")  # splits a frequent order value over partitions
    ordered = checkpointed(df.orderBy(*order_by, tie)).withColumn("_place", F.monotonically_increasing_id())
    partition = F.shiftright("_place", _ROW_BITS)
    offsets = (
        ordered.groupBy(partition.alias("_partition"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "_partition",
            (F.sum("rows").over(Window.orderBy("_partition")) - F.col("rows")).alias("_before"),
        )
    )
    return (
        ordered.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")  # one row per partition
        .withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1)
        .drop("_place", "_partition", "_before")
    )
