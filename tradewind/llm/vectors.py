"""Rows of a table of vectors that vector operators can use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_column: str, vector_column: str, limit: float = float("inf")) -> DataFrame:
    """``id`` (long) and ``vector`` of the rows whose vector is neither null nor empty nor holds a null or non-finite entry.

    Entries of ``limit`` and more in size drop a row too. Vectors must have one length; where
    they have several, those of the commonest (of equally common ones the longest) take part,
    for which the lengths are counted by a job while the plan is built.
    """
    sound = f"forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('{limit}'))"
    rows = df.select(F.col(_quoted(id_column)).cast("long").alias("id"), F.col(_quoted(vector_column)).alias("vector"))
    rows = rows.where("size(vector) > 0").where(sound)
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows if lengths is None else rows.where(F.size("vector") == lengths.length)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def matrix(column: pa.ListArray, kind: type = np.float64) -> np.ndarray:
    """A column of equally long vectors without nulls as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
