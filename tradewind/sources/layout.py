"""Tables stored in buckets of a key, so that tables of one layout join on it without a shuffle."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

LAYOUT = "_layout"


def write_bucketed_tables(tables: dict[str, DataFrame], key: str, buckets: int, folder: str) -> None:
    """Write tables that have ``key`` to ``folder``, each in the same number of buckets, sorted by it.

    Rows are dealt by the hash that Spark's joins use, so a bucket is one file. The layout is
    noted beside the tables; nothing of it depends on a catalog that outlives the session.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        dealt.mode("overwrite").option("path", f"{folder}/{name}").format("parquet").saveAsTable(_registered(folder, name))
    notes = [{"name": n, "key": key, "buckets": buckets, "schema": json.loads(df.schema.json())} for n, df in tables.items()]
    spark.createDataFrame([(json.dumps(note),) for note in notes], "value string").coalesce(1).write.mode("overwrite").text(
        f"{folder}/{LAYOUT}"
    )


def _registered(folder: str, name: str) -> str:
    """A table name for this place; the catalog only lasts as long as the session."""
    return f"bucketed_{abs(hash(folder)) % 10**12}_{name}"


def read_bucketed_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a layout, with their buckets known to the planner."""
    found = {}
    for row in spark.read.text(f"{folder}/{LAYOUT}").collect():  # one row for each table
        note = json.loads(row.value)
        name, key = _registered(folder, note["name"]), note["key"]
        columns = ", ".join(f"`{f['name']}` {_ddl(f['type'])}" for f in note["schema"]["fields"])
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) "
            f"SORTED BY (`{key}`) INTO {note['buckets']} BUCKETS LOCATION '{folder}/{note['name']}'"
        )
        found[note["name"]] = spark.table(name)
    return found


def _ddl(kind: str | dict) -> str:
    """A column type in SQL from its JSON form."""
    from pyspark.sql.types import StructField

    return StructField.fromJson({"name": "c", "type": kind, "nullable": True, "metadata": {}}).dataType.simpleString()
