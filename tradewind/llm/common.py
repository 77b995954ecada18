"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.sources.checkpoints import shared_folder

# Words are runs of anything but these; written for regular expressions of Java, RE2 and Python alike.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to reach."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives the loss of executors and gives the optimizer the
    true size. Runs a job while the plan is built; the folder belongs to the caller's
    ``spark.checkpoint.dir`` and is cleaned with it.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_by_hash(rows: DataFrame, label: str, n: int) -> DataFrame:
    """(``label``, ``hash``, ``place``) of the ``n`` least hashes of every label among distinct ones.

    A bound on the hash, taken from each label's number of distinct hashes, keeps all other rows
    in their tasks, so about ``2 * n`` a label are ranked, however many there are.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("distinct"))
    span = float(1 << 64)
    # Twice as many as needed are expected below the bound.
    bound = F.expr(f"-9.223372036854775808E18D + least(1D, {2 * n + 50}D / distinct) * {span!r}D")
    near = rows.join(F.broadcast(counts), label).where(F.col("hash").cast("double") <= bound)  # a row for each label
    place = F.row_number().over(Window.partitionBy(label).orderBy("hash"))
    return near.select(label, "hash", place.alias("place")).where(F.col("place") <= n)


def give_back() -> None:
    """Hands freed memory back to the system; a Python worker that waits for its next task would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType
) -> DataFrame:
    """mapInArrow with a function from batches to columns of values (dict of name to sequence)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            arrays = [
                values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type)
                for field, values in ((f, columns[f.name]) for f in target)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
        give_back()

    return df.mapInArrow(run, schema)


def spans_text(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of the kinds, comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)
