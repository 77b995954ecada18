"""Session settings for cluster and local runs."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

ADAPTIVE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Row-preserving joins (order_geo, orders to customers) leave hot keys to this.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_PARTITION_BYTES = 192 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Partition count that keeps a shuffle partition near 192 MB and every core busy."""
    return max(cores, math.ceil(shuffled_bytes / SHUFFLE_PARTITION_BYTES))


def build_session(
    app: str = "tradewind",
    master: str | None = None,
    shuffled_bytes: int = 0,
    cores: int = 8,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution; shuffle partitions follow the expected shuffle volume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": str(shuffle_partitions(shuffled_bytes, cores)),
        **(extra or {}),
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
