"""Texts that hold passages of a benchmark, found by the q-gram lemma.

Benchmark items are cut into overlapping windows. A window of L characters and a region of
a text within k edits share at least L + 1 - q * (k + 1) q-grams, all of them on at most
k + 1 neighbouring diagonals. So the shared q-grams of a text and a window are counted in
bands of 2 * (k + 1) diagonals that overlap by half, bands that reach the bound are kept as
regions, and a banded alignment verifies them. Every window within k edits is found.

Long windows find passages with scattered edits; short ones start so close to each other
that every passage of ``PASSAGE`` characters holds one whole, wherever it begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import give_back, map_batches, written
from tradewind.sources.checkpoints import shared_folder

WINDOW = 80  # characters; a shorter item is one window of its own length
STEP = 40  # an item's windows start so far apart, and one ends with the item
PASSAGE = 50  # every passage of so many characters holds a short window, wherever it begins
SHORT_STEP = 3  # short windows start so far apart, and one ends with the item
SHORT = PASSAGE - SHORT_STEP + 1  # characters of a short window
EDIT_SHARE = 0.075  # edits allowed per character of a window
Q = 10  # the bound stays positive for every window of MIN_LENGTH or more
MIN_LENGTH = 40  # shorter items are no evidence
BLOCK_CHARS = 4 << 20  # benchmark text sent to the tasks at once; a larger benchmark takes one pass per block
VERIFIED = 1 << 14  # regions aligned at once
CHUNK_CHARS = 256 << 10  # text searched at once; longer texts are cut in overlapping stretches
GAP = np.full(2 * WINDOW, 0x110000, np.uint32)  # between texts: a letter that no text has

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalized(text: str | None) -> str:
    """Lower case, any white space as one blank."""
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(points) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for k in range(Q):
        found = (found + points[k : k + n]) * MULTIPLIER
    return found ^ (found >> np.uint64(29))


def window_starts(length: int) -> list[tuple[int, range | list[int]]]:
    """Lengths and starts of an item's windows: long ones, and short ones so close that no passage lies between them."""
    whole = min(WINDOW, length)
    if whole < MIN_LENGTH:
        return [(whole, []), (SHORT, [])]
    short = sorted({*range(0, length - SHORT + 1, SHORT_STEP), length - SHORT}) if length > SHORT else []
    return [(whole, sorted({*range(0, length - whole + 1, STEP), length - whole})), (SHORT, short)]


def often(keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which keys stand in ``keys`` as often as ``least`` asks."""
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[place] >= least


class Windows:
    """The windows of one block of benchmark items and the inverted index of the items' q-grams.

    An item's q-grams are held once; the windows that hold one are a run of those in order
    of their starts, for long and short windows each.
    """

    FILTER_BITS = 20

    def __init__(self, items: list[tuple[int, str]]):
        self.item: list[int] = []
        texts: list[np.ndarray] = []
        kinds: tuple[list, list] = ([], [])  # of long and short windows: start, length, number of the item
        at = 0
        for item, text in items:
            points = code_points(normalized(text))
            if len(points) < MIN_LENGTH:
                continue
            for kind, (length, starts) in zip(kinds, window_starts(len(points)), strict=True):
                kind += [(at + start, length, len(texts)) for start in starts]
            self.item.append(item)
            texts.append(points)
            at += len(points)
        self.flat = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        self.begin, self.length, self.owner = np.array([*kinds[0], *kinds[1]], np.int64).reshape(-1, 3).T
        self.runs = [slice(0, len(kinds[0])), slice(len(kinds[0]), None)]
        self.edits = (self.length * EDIT_SHARE).astype(np.int64)
        self.bound = np.maximum(self.length + 1 - Q * (self.edits + 1), 1)
        self.least = np.full(len(texts), 1 << 30)  # the lowest bound of an item's windows
        np.minimum.at(self.least, self.owner, self.bound)
        hashes = [grams(p) for p in texts]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        text = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        where = np.arange(len(flat)) + (Q - 1) * text  # every item before has Q - 1 letters without a q-gram
        order = np.argsort(flat, kind="stable")
        self.where, self.text = where[order], text[order]
        self.values, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << self.FILTER_BITS, bool)
        self.known[self.values >> np.uint64(64 - self.FILTER_BITS)] = True

    @property
    def points(self) -> list[np.ndarray]:
        """The letters of every window."""
        return [self.flat[a : a + n] for a, n in zip(self.begin.tolist(), self.length.tolist(), strict=True)]

    def holding(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of places and of windows that hold the q-gram there."""
        found = []
        for run in self.runs:
            begin, end = self.begin[run], self.begin[run] + self.length[run]
            low = np.searchsorted(end, where + Q)
            size = np.maximum(np.searchsorted(begin, where, side="right") - low, 0)
            window = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            found.append((np.repeat(np.arange(len(where)), size), window + run.start))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def regions(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first diagonals of the bands that reach the bound."""
        hashes = grams(points)
        if not len(self.values) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.known[hashes >> np.uint64(64 - self.FILTER_BITS)])
        slot = np.searchsorted(self.values, hashes[at])
        slot[slot == len(self.values)] = 0
        same = self.values[slot] == hashes[at]
        at, slot = at[same], slot[same]
        size = self.count[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at = np.repeat(at, size)
        # Items, then windows, that share too few q-grams with a whole text have no band in it that shares enough.
        text = np.searchsorted(starts, at, side="right") - 1
        chosen = often(text * len(self.item) + self.text[entry], self.least[self.text[entry]])
        at, text, where = at[chosen], text[chosen], self.where[entry[chosen]]
        hit, window = self.holding(where)
        chosen = often(text[hit] * len(self.bound) + window, self.bound[window])
        if not chosen.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hit, window = hit[chosen], window[chosen]
        at, place = at[hit], where[hit] - self.begin[window]
        # Diagonals are counted from the band below the text's start, so none is negative.
        diagonal = at - place + WINDOW
        half = self.edits[window] + 1
        bands = np.concatenate([diagonal // half, diagonal // half - 1])
        window, place = np.tile(window, 2), np.tile(place, 2)
        keys = (window * (2 * (len(points) + 2 * WINDOW) + 2) + bands + 1) * WINDOW + place
        # A q-gram of the window counts once in a band, however often the text repeats it.
        keys = np.unique(keys) // WINDOW
        keys, counts = np.unique(keys, return_counts=True)
        span = 2 * (len(points) + 2 * WINDOW) + 2
        window, bands = keys // span, keys % span - 1
        reached = counts >= self.bound[window]
        window, bands = window[reached], bands[reached]
        return window, bands * (self.edits[window] + 1) - WINDOW

    def search(self, points: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], int]:
        """Least edits by (text, window), for every window with a region within its edits.

        ``points`` are texts with gaps between them, ``starts`` where each begins. No region
        within the edits reaches over a gap, and its middle lies in its text.
        """
        window, diagonal = self.regions(points, starts)
        best: dict[tuple[int, int], int] = {}
        for length in np.unique(self.length[window]).tolist():
            edits = int(length * EDIT_SHARE)
            width = 2 * (edits + 1)
            of_length = np.flatnonzero(self.length[window] == length)
            for first in range(0, len(of_length), VERIFIED):
                chosen = of_length[first : first + VERIFIED]
                pattern = self.flat[self.begin[window[chosen]][:, None] + np.arange(length)]
                least = banded_edits(pattern, points, diagonal[chosen], width, edits)
                middle = diagonal[chosen] + width // 2 + length // 2
                text = np.searchsorted(starts, middle, side="right") - 1
                for t, w, found in zip(text.tolist(), window[chosen].tolist(), least.tolist(), strict=True):
                    if found <= edits:
                        best[t, w] = min(found, best.get((t, w), found))
        return best


def banded_edits(
    patterns: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, edits: int
) -> np.ndarray:
    """Least edits of each pattern against any region of the text near its band of diagonals.

    Row i of the alignment looks at text positions first + i - edits to first + i + width +
    edits; the region may start and end anywhere among them.
    """
    n, length = patterns.shape
    span = width + 2 * edits + 1
    padded = np.concatenate([text, np.full(1, 0xFFFFFFFF, np.uint32)])
    # cost[:, d]: least edits of the pattern's start against a region that ends on diagonal first - edits + d.
    offset = (first - edits)[:, None] + np.arange(span)[None, :]
    outside = 1 << 20
    cost = np.where((offset >= 0) & (offset <= len(text)), 0, outside).astype(np.int32)
    steps = np.arange(span, dtype=np.int32)[None, :]
    for i in range(length):
        at = offset + i
        inside = (at >= 0) & (at < len(text))
        letters = padded[np.where(inside, at, len(text))]
        step = cost + np.where(inside & (letters == patterns[:, i : i + 1]), 0, np.where(inside, 1, outside))
        drop = np.full_like(cost, outside)
        drop[:, :-1] = cost[:, 1:] + 1  # the pattern's letter is missing in the text
        step = np.minimum(step, drop)
        ends = offset + i + 1
        step = np.where((ends >= 0) & (ends <= len(text)), step, outside)
        # Letters of the text that the pattern lacks: best of all smaller diagonals plus their distance.
        cost = np.minimum(np.minimum.accumulate(step - steps, axis=1) + steps, outside).astype(np.int32)
    return cost.min(axis=1)


HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("n_windows", T.LongType()),
        T.StructField("edits", T.LongType()),
    ]
)


def stretches(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts in chunks: the numbers of the texts, their characters with gaps between them, and where each starts."""
    numbers: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for k, text in enumerate(texts):
        points = code_points(normalized(text))
        for start in range(0, max(len(points) - len(GAP), 1), CHUNK_CHARS):
            part = points[start : start + CHUNK_CHARS + len(GAP)]
            numbers.append(k)
            parts += [part, GAP]
            size += len(part)
            if size >= CHUNK_CHARS:
                yield numbers, np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1:2]
                numbers, parts, size = [], [], 0
    if numbers:
        yield numbers, np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1:2]


def text_hits(windows: Windows, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
    """Items found in each text: how many of their windows, and the least edits of one."""
    found: list[dict[int, dict[int, int]]] = [{} for _ in texts]
    for numbers, points, starts in stretches(texts):
        for (t, window), edits in windows.search(points, starts).items():
            own = found[numbers[t]].setdefault(windows.item[windows.owner[window]], {})
            own[window] = min(edits, own.get(window, edits))
    return [{item: (len(own), min(own.values())) for item, own in items.items()} for items in found]


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, read row by row, in blocks of at most ``BLOCK_CHARS`` characters of text."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.selectExpr("cast(item_id as bigint) as item_id", "text").where("text is not null")
    for row in rows.toLocalIterator():
        if block and size + len(row.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def with_last(blocks: Iterator[list[tuple[int, str]]]) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Each block and whether it is the last one."""
    before = None
    for block in blocks:
        if before is not None:
            yield before, False
        before = block
    if before is not None:
        yield before, True


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text and benchmark item of which it holds a window: doc_id, item_id, n_windows, edits.

    Case and the kind of white space do not matter. ``edits`` is the least number over the
    windows found. Null and empty texts and items hold nothing; items under ``MIN_LENGTH``
    characters are no evidence; rows that repeat an id give rows of their own; ids may be
    null; other columns are ignored; an empty table on either side gives an empty result.

    Each block of the benchmark is one pass over the texts, which are never shuffled. A
    benchmark of several blocks has the passes run one after the other, each written to the
    shared folder and its block released before the next one is read, so driver, executors
    and plan hold no more than two blocks at a time.
    """
    chosen = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    spark = docs.sparkSession

    def hits(block: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        items = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            windows = Windows(items.value)
            for batch in batches:
                found = [
                    (doc, item, *counts)
                    for doc, own in zip(
                        batch.column("doc_id").to_pylist(),
                        text_hits(windows, batch.column("text").to_pylist()),
                        strict=True,
                    )
                    for item, counts in own.items()
                ]
                if found:
                    yield dict(zip(HITS.names, map(list, zip(*found, strict=True)), strict=True))

        return map_batches(chosen, rows, HITS), items

    folder = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    several = False
    for block, last in with_last(benchmark_blocks(benchmark)):
        found, items = hits(block)
        if last and not several:
            return found
        several = True
        found.write.mode("append").parquet(folder)
        items.unpersist()
    return spark.read.schema(HITS).parquet(folder) if several else spark.createDataFrame([], HITS)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark; same rules and passes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(docs.schema)

    def clean(kept: DataFrame, block: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
        items = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(items.value)
            for batch in batches:
                clean = pa.array([not h for h in text_hits(windows, batch.column("text").to_pylist())], pa.bool_())
                yield pc.filter(batch, clean).cast(target)
            give_back()

        return kept.mapInArrow(run, docs.schema), items

    kept = docs
    for block, last in with_last(benchmark_blocks(benchmark)):
        kept, items = clean(kept, block)
        if not last:
            kept = written(kept, "clean")
            items.unpersist()
    return kept
