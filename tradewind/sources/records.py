"""Records of CSV files with quoted newlines, from byte ranges that are read side by side.

Whether a line begins inside a quoted cell depends on all quotes before it. Each range of a
file therefore reports the parity of its quotes, and what it holds of records that reach over
its borders, for both cases: beginning outside a quoted cell and inside one. A running sum of
the parities along each file settles which case holds; records over borders are put
together from what was reported, and a second pass cuts the ranges into their own records.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.sources.checkpoints import stored

RANGE = ["file", "start"]
_REPORT = "file long, start long, inside boolean, parity int, head string, tail string, opens boolean, closed boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their range, in order within it, and the parity of their quotes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"),
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[pa.RecordBatch]]]:
    """The batches cut where a new range begins, grouped by range."""

    def cut() -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        for batch in batches:
            files, starts = batch.column("file").to_numpy(), batch.column("start").to_numpy()
            if not len(starts):
                continue
            new = np.flatnonzero(np.append(True, (files[1:] != files[:-1]) | (starts[1:] != starts[:-1])))
            for i, j in zip(new, np.append(new[1:], len(starts)), strict=True):
                yield (int(files[i]), int(starts[i])), batch.slice(i, j - i)

    for name, parts in groupby(cut(), key=lambda x: x[0]):
        yield name, (part for _, part in parts)


def _open_before(odd: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside a quoted cell, and whether the line after the last does."""
    state = (np.cumsum(odd) + inside) % 2 == 1
    return np.append(inside, state[:-1]), bool(state[-1])


class _Borders:
    """What a range holds of records over its borders, if it begins outside (or inside) a quoted cell."""

    def __init__(self, inside: bool):
        self.inside, self.open = inside, inside
        self.head: list[str] = []  # lines of the record that began before the range
        self.tail: list[str] = []  # lines of the record that is not closed yet
        self.in_head = inside
        self.closed = False  # whether the range closes a record of its own that is not empty

    def add(self, values: pa.Array, odd: np.ndarray) -> None:
        before, self.open = _open_before(odd, self.open)
        first = 0
        if self.in_head:
            ends = np.flatnonzero(~np.append(before[1:], self.open))  # lines that close a record
            first = int(ends[0]) + 1 if len(ends) else len(before)
            self.head += values.slice(0, first).to_pylist()
            self.in_head = not len(ends)
        if first == len(before):
            return
        begins = np.flatnonzero(~before[first:]) + first
        if len(begins):
            last = begins[-1] if self.open else len(before)
            own = [*self.tail, *values.slice(first, last - first).to_pylist()] if not self.closed else []
            self.closed = self.closed or any(map(_content, own))
            self.tail = values.slice(last).to_pylist()
        else:
            self.tail += values.slice(first).to_pylist()
            if not self.open:
                self.closed, self.tail = True, []

    def report(self) -> dict:
        return {
            "inside": self.inside,
            "head": "\n".join(self.head) if self.inside else None,
            "tail": "\n".join(self.tail) if self.open and not self.in_head else None,
            "opens": self.open and not self.in_head,
            "closed": self.closed,
        }


def _content(line: str) -> bool:
    """Whether a record has any; empty lines are none."""
    return line not in ("", "\r")


def _reported(lines: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_REPORT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), parts in _ranges(batches):
            cases, parity = (_Borders(False), _Borders(True)), 0
            for part in parts:
                odd = part.column("odd").to_numpy()
                parity = (parity + int(odd.sum())) % 2
                for case in cases:
                    case.add(part.column("value"), odd)
            rows = [{"file": file, "start": start, "parity": parity, **case.report()} for case in cases]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return lines.mapInArrow(run, _REPORT)


def _own_records(lines: DataFrame, header: bool) -> DataFrame:
    """Records that lie in one range, from lines with the settled case ``inside`` of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, start), parts in _ranges(batches):
            state, skip, first, held = None, False, True, []
            for part in parts:
                odd, values = part.column("odd").to_numpy(), part.column("value")
                if state is None:
                    state = skip = bool(part.column("inside")[0].as_py())
                before, state = _open_before(odd, state)
                after = np.append(before[1:], state)
                if not held and not skip and not after.any():  # every line is a record
                    records = values
                else:
                    found = []
                    for value, closes in zip(values.to_pylist(), ~after, strict=True):
                        held.append(value)
                        if closes:
                            if not skip:
                                found.append("\n".join(held))
                            skip, held = False, []
                        elif skip:
                            held = []
                    records = pa.array(found, pa.string())
                if header and start == 0 and first:
                    named = next((k for k, r in enumerate(records.to_pylist()) if _content(r)), None)
                    if named is not None:
                        records, first = records.slice(named + 1), False
                yield pa.RecordBatch.from_arrays([records.cast(pa.string())], names=["record"])

    return lines.mapInArrow(run, "record string")


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: the text of every record of a CSV file or folder, without its line end, in many tasks a file.

    Lines end in a newline, alone or after a carriage return. Every quote must open, close or,
    doubled, stand in a quoted cell; a file whose quotes don't pair up ends in a record that takes
    the rest of it. Empty lines are no records. With ``header`` the first record of each file is left
    out. Three passes: two reports in one, settled by a window along each file's ranges, and the
    records. What is kept between them is one row a range; a record over borders is put together
    in one task.
    """
    lines = _lines(spark, path)
    reports = stored(_reported(lines), "csv-ranges")
    along = Window.partitionBy("file").orderBy("start")
    parities = reports.where("not inside").select(
        *RANGE, (F.coalesce(F.sum("parity").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1).alias("inside")
    )
    settled = stored(reports.join(parities, [*RANGE, "inside"]), "csv-borders")
    # A range that opens a record begins a run; ranges wholly inside the record and the one that closes it belong to it.
    runs = settled.withColumn("run", F.sum(F.col("opens").cast("int")).over(along) - F.col("opens").cast("int"))
    # The header may reach over the first range: it opens there, and nothing was closed before it.
    named = F.lit(header) & (F.col("start") == 0) & ~F.col("closed")
    heads = runs.where("inside").select("file", "run", "start", F.col("head").alias("text"), F.lit(False).alias("named"))
    begun = runs.where("opens").select(
        "file", (F.col("run") + 1).alias("run"), "start", F.col("tail").alias("text"), named.alias("named")
    )
    over = (
        heads.unionByName(begun)
        .groupBy("file", "run")
        .agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("texts"), F.max("named").alias("named"))
        .where("not named")
        .select(F.array_join(F.transform("texts", lambda t: t["text"]), "\n").alias("record"))
    )
    # One row for each range, of which the driver keeps a list anyway.
    inside = F.broadcast(settled.where("inside").select(*RANGE, "inside"))
    own = _own_records(lines.join(inside, RANGE, "left").withColumn("inside", F.coalesce("inside", F.lit(False))), header)
    records = own.unionByName(over)
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
