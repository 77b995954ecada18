"""Lookup of a keyed table from a much larger one whose keys may be skewed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT, SPREAD = "_salt", "_spread"
HOT_KEYS = 1024  # keys that are spread at most; any other holds less than this part of the facts
TRACKED = 16 * HOT_KEYS  # counters of a sketch
BRANCHES = 64  # sketches merged side by side before the last merge
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def broadcast_threshold(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes; negative when broadcasting is off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text).groups()
    return int(number) * _UNITS.get(unit, 1)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is below the session's broadcast threshold."""
    if not hasattr(df, "_jdf"):  # no local plan to ask, e.g. a remote session
        return False
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= broadcast_threshold(df.sparkSession)


def heavy_hitters(df: DataFrame, on: str) -> tuple[list[tuple[object, int]], int]:
    """Keys that hold more rows than an average shuffle partition, each with the partitions its rows would fill.

    The second figure says so of NULL. Every task keeps a bounded frequent-items sketch of its
    keys, sketches are merged in branches and then together, and at most HOT_KEYS keys reach the
    driver. Counts are estimates, off by a small share of all rows.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = df.select(F.col(f"`{on}`").alias("key"))
    nulls = keys.where("key is null").count()
    sketched = (
        keys.where("key is not null")
        .groupBy((F.spark_partition_id() % BRANCHES).alias("branch"))
        .agg(F.expr(f"approx_top_k_accumulate(key, {TRACKED}) as sketch"), F.count(F.lit(1)).alias("known"))
    )
    # Grouped, so that no keys at all make no row: there is no empty sketch to merge.
    merged = sketched.groupBy(F.lit(1)).agg(
        F.expr(f"approx_top_k_combine(sketch, {TRACKED}) as sketch"), F.sum("known").alias("known")
    )
    totals = merged.selectExpr(f"approx_top_k_estimate(sketch, {HOT_KEYS}) as found", "known").first()
    rows = nulls + (totals.known if totals else 0)

    def fills(part: int) -> int:
        return -(-part * partitions // max(rows, 1))

    share = min(partitions, HOT_KEYS)
    found = totals.found if totals else []
    return [(f["item"], fills(f["count"])) for f in found if f["count"] * share > rows], max(1, fills(nulls))


def spread_hot_keys(
    facts: DataFrame, keyed: DataFrame, on: str, spread: list[str], hot: list[tuple[object, int]], nulls: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: rows of a hot key take one of as many as the key is spread over, from a hash of
    their ``spread`` columns (stable across task retries), and only the keyed rows of hot keys are copied.
    """
    spark, key = facts.sparkSession, T.StructField(on, keyed.schema[on].dataType)
    # At most HOT_KEYS rows, fixed once: both sides must see the same list.
    listed = F.broadcast(spark.createDataFrame(hot, T.StructType([key, T.StructField(SPREAD, T.IntegerType())])))
    columns = ", ".join(f"`{name}`" for name in spread)
    over = f"if(`{on}` is null, {nulls}, coalesce({SPREAD}, 1))"
    salted = facts.join(listed, on, "left").withColumn(SALT, F.expr(f"int(pmod(xxhash64({columns}), {over}))"))
    copied = keyed.join(listed, on, "left").withColumn(SALT, F.expr(f"explode(sequence(0, coalesce({SPREAD}, 1) - 1))"))
    return salted.drop(SPREAD), copied.drop(SPREAD)


def lookup(
    facts: DataFrame,
    keyed: DataFrame,
    on: str,
    spread: list[str],
    how: str = "inner",
    sized_by: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``keyed`` (unique on ``on``), whatever the skew of the key.

    A ``keyed`` side estimated below the broadcast threshold is joined plainly and
    Catalyst broadcasts it. Estimates of joins and aggregates are loose, so ``sized_by`` may name
    the stored table that ``keyed`` has a row of like width of at most for each row; if that
    is below the threshold, ``keyed`` is broadcast. Beyond that the join is shuffled, and a job
    finds the heavy hitters among the keys first: from ``facts``, or from ``counted``, a cheaper table
    with the same key and like frequencies. Only their facts are spread and only their keyed
    rows copied, to no more copies in all than there are shuffle partitions and hot keys.
    Both sides are exchanged directly below the join, so adaptive execution can still split a
    partition or, once the true size is known, broadcast a side after all.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type for a lookup: {how}")
    if sized_by is not None and fits_broadcast(sized_by):
        return facts.join(F.broadcast(keyed), on, how)
    if fits_broadcast(keyed):
        return facts.join(keyed, on, how)
    hot, nulls = heavy_hitters(facts if counted is None else counted, on)
    nulls = nulls if how == "left" else 1  # an inner join drops them
    if not hot and nulls == 1:
        return facts.join(keyed, on, how)
    salted, copied = spread_hot_keys(facts, keyed, on, spread, hot, nulls)
    return salted.join(copied, [on, SALT], how).drop(SALT)
