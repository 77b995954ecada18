"""Nearest neighbours by inner product with a forest of random-projection trees.

Rows are scaled by the largest length and given one more coordinate that makes all of them
equally long, queries are scaled to the same length; the largest inner product is then the
least distance. A tree splits by one random direction a level, directions of a tree being
orthogonal, at medians of a bounded sample; every row falls to one leaf of every tree.

A query walks all trees through one priority queue. A leaf's priority is the sum of the
squared margins by which its path leaves the query's side, so the nearest leaves of the
whole forest come first. The first leaves, its own in every tree, give a bound: its k-th best
so far, at squared distance r2. Rows at that distance differ by r2 / dimensions on average in
one random direction, so the queue is walked on to a priority of SLACK * levels * r2 /
dimensions. No number of leaves or candidates is set: queries with near neighbours end
early, those without look far. All rows of the leaves are compared by their exact inner product.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import map_batches, written
from tradewind.llm.vectors import matrix, usable_vectors

NEAREST = 20
QUERY_STEP = 20  # ids that it divides are queries
TREES = 3
LEAF_ROWS = 1024
SLACK = 0.2
SAMPLE = 16_384  # vectors from which medians are taken, at most
NODE_SAMPLE = 32  # of them for one median; deeper levels take the median of their last ancestor with so many
UNIT_ROWS, UNIT_QUERIES = 8192, 16_384  # of one comparison; leaves with more are compared in blocks, each with each
SEED = 12


@dataclass(frozen=True)
class Forest:
    """Directions by tree and level, and the median of every node of the fitted levels."""

    directions: np.ndarray  # trees, levels, dimensions + 1
    medians: list[list[np.ndarray]]
    largest: float  # entry of any row, in size
    length: float  # of the longest row, after division by that

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        """Rows with one length, the last coordinate making up for what each lacks."""
        scaled = rows / self.largest / self.length
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def projected(self, points: np.ndarray) -> np.ndarray:
        """Coordinates by point, tree and level."""
        trees, levels, dims = self.directions.shape
        return (points @ self.directions.reshape(-1, dims).T).reshape(len(points), trees, levels)

    def medians_at(self, tree: int, level: int, codes):
        """Medians of the nodes with these codes; ``level`` bits each, a bit for every side taken."""
        known = self.medians[tree][level]
        return known[codes >> max(0, level - (len(known).bit_length() - 1))]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        places = self.projected(self.augmented(rows))
        codes = np.zeros(places.shape[:2], np.int64)
        for tree in range(places.shape[1]):
            for level in range(self.levels):
                right = places[:, tree, level] > self.medians_at(tree, level, codes[:, tree])
                codes[:, tree] = 2 * codes[:, tree] + right
        return codes

    def walk(self, places: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(priority, tree, leaf) of all leaves of the forest, nearest first, for one query's coordinates."""
        queue = [(0.0, tree, 0, 0) for tree in range(len(places))]
        while queue:
            priority, tree, level, code = heapq.heappop(queue)
            while level < self.levels:
                margin = places[tree, level] - float(self.medians_at(tree, level, code))
                right = int(margin > 0)
                heapq.heappush(queue, (priority + margin * margin, tree, level + 1, 2 * code + 1 - right))
                level, code = level + 1, 2 * code + right
            yield priority, tree, code


def fit_forest(sample: np.ndarray, rows: int, largest: float, length: float, trees: int = TREES) -> Forest:
    """Trees for so many rows, with medians from the sample."""
    levels = max(0, math.ceil(math.log2(max(rows, 1) / LEAF_ROWS)))
    dims = sample.shape[1] + 1
    rng = np.random.default_rng(SEED)
    trees = trees if levels else 1
    directions = np.empty((trees, levels, dims))
    for tree in range(trees):
        bases = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-levels // dims))]
        if bases:
            directions[tree] = np.concatenate(bases)[:levels]
    forest = Forest(directions, [[] for _ in range(trees)], largest, length)
    places = forest.projected(forest.augmented(sample))
    fitted = max(0, int(math.log2(max(len(sample), 1) / NODE_SAMPLE)))
    for tree in range(trees):
        codes = np.zeros(len(sample), np.int64)
        for level in range(levels):
            column, width = places[:, tree, level], min(level, fitted)
            groups = codes >> (level - width)
            order = np.lexsort((column, groups))
            starts = np.searchsorted(groups[order], np.arange((1 << width) + 1))
            middle = np.median(column)
            forest.medians[tree].append(
                np.array(
                    [np.median(column[order[i:j]]) if j > i else middle for i, j in zip(starts, starts[1:], strict=False)]
                )
            )
            codes = 2 * codes + (column > forest.medians_at(tree, level, codes))
    return forest


KEY = ["key_1", "key_2"]
VISIT = T.StructType(
    [
        *[T.StructField(name, T.LongType()) for name in KEY],
        T.StructField("tree", T.IntegerType()),
        T.StructField("leaf", T.LongType()),
    ]
)
HIT = T.StructType(
    [
        *[T.StructField(name, T.LongType()) for name in KEY],
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)


def _keyed(vectors: DataFrame) -> DataFrame:
    return vectors.selectExpr("id", "vector", "xxhash64(vector) as key_1", "xxhash64(1, vector) as key_2")


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Every distinct vector once, with the least ``k`` of its ids; those are all that k neighbours can need."""
    kept = vectors.select(*KEY, "id", "vector").withColumn(
        "place", F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    )
    return (
        kept.where(F.col("place") <= k)
        .groupBy(*KEY)
        .agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids"))
    )


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most SAMPLE vectors, those with the least hashes; a bound on the hash keeps the others in their tasks."""
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    place = F.expr(f"pmod(xxhash64(2, key_1, key_2), {1 << 40}L)")
    few = rows.where(place < math.ceil(share * (1 << 40))).orderBy(place, *KEY).limit(SAMPLE)
    return np.array([r[0] for r in few.select("vector").collect()], float)


def _leaf_rows(rows: DataFrame, forest: Forest) -> DataFrame:
    """A row for each vector and tree: ``tree``, ``leaf``, ``vector``, ``ids``, ``at`` to part large leaves."""
    schema = T.StructType(
        [
            T.StructField("tree", T.IntegerType()),
            T.StructField("leaf", T.LongType()),
            T.StructField("at", T.LongType()),
            rows.schema["vector"],
            T.StructField("ids", T.ArrayType(T.LongType())),
        ]
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches):
            codes = forest.leaves(matrix(batch.column("vector")))
            for tree in range(codes.shape[1]):
                yield {
                    "tree": np.full(len(codes), tree, np.int32),
                    "leaf": codes[:, tree],
                    "at": batch.column("key_1"),
                    "vector": batch.column("vector"),
                    "ids": batch.column("ids"),
                }

    return map_batches(rows, placed, schema)


def _visits(queries: DataFrame, forest: Forest, first: bool) -> DataFrame:
    """The leaves that every query visits: its own in all trees, or those that come after, up to its bound."""
    schema = T.StructType([*VISIT.fields, T.StructField("floor", T.DoubleType()), queries.schema["vector"]])
    trees = forest.directions.shape[0]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches, 256):
            vectors = matrix(batch.column("vector"))
            lengths = np.sqrt(((vectors / forest.largest) ** 2).sum(axis=1))
            unit = vectors / forest.largest / lengths[:, None]
            places = forest.projected(np.concatenate([unit, np.zeros((len(unit), 1))], axis=1))
            floors = batch.column("floor").to_pylist()
            own, found = [], []
            for k, floor in enumerate(floors):
                limit = math.inf
                if floor is not None:
                    near = floor / forest.largest / forest.largest / forest.length / lengths[k]
                    limit = SLACK * forest.levels * max(0.0, 2 - 2 * near) / vectors.shape[1]
                for n, (priority, tree, leaf) in enumerate(forest.walk(places[k])):
                    if n >= trees if first else priority > limit:
                        break
                    if first or n >= trees:
                        own.append(k)
                        found.append((tree, leaf))
            own = pa.array(own, pa.int64())
            yield {
                **{name: batch.column(name).take(own) for name in (*KEY, "vector", "floor")},
                "tree": np.array([t for t, _ in found], np.int32),
                "leaf": np.array([leaf for _, leaf in found], np.int64),
            }

    return map_batches(queries, visits, schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def best_of(rows: np.ndarray, ids: list[list[int]], queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[list[int], list[float]]]:
    """For every query the ``k`` nearest ids among rows, by score and then id, none below its floor.

    A product of matrices finds candidates; their scores are then summed one by one in one order,
    so a pair of vectors has the same score wherever it is met.
    """
    scores = queries @ rows.T
    # What the order of a sum can change.
    blur = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0.0)
    least = floors
    if len(rows) > k:
        least = np.maximum(least, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
    for own, query, score, bound, floor in zip(scores >= (least - blur)[:, None], queries, scores, least, floors, strict=True):
        at = np.flatnonzero(own | ~np.isfinite(score))
        exact = (rows[at] * query).sum(axis=1)
        best: dict[int, float] = {}
        for value, place in zip(exact.tolist(), at.tolist(), strict=True):
            if not value < floor:
                for i in ids[place]:
                    if value > best.get(i, -math.inf) or i not in best:
                        best[i] = value
        chosen = heapq.nsmallest(k, ((-value, i) for i, value in best.items()))
        yield [i for _, i in chosen], [-value for value, _ in chosen]


def _compared(rows: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The best of every visited leaf for every query (HIT)."""
    leaf = ["tree", "leaf"]
    sizes = rows.groupBy(*leaf).agg(F.ceil(F.count("at") / UNIT_ROWS).alias("row_blocks"))
    asked = visits.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / UNIT_QUERIES).alias("query_blocks"))
    large = written(sizes.join(asked, leaf).where("row_blocks > 1 or query_blocks > 1"), "large-leaves")
    units = [*leaf, "row_block", "query_block"]

    def dealt(side: DataFrame, own: str, other: str, at: str) -> DataFrame:
        return (
            side.join(large, leaf, "left")
            .withColumn(f"{own}_block", F.expr(f"pmod({at}, coalesce({own}_blocks, 1))"))
            .withColumn(f"{other}_block", F.expr(f"explode(sequence(0L, coalesce({other}_blocks, 1) - 1))"))
            .drop("row_blocks", "query_blocks")
        )

    def compare(own: pa.Table, asked: pa.Table) -> pa.Table:
        hits = {name: [] for name in HIT.names}
        if own.num_rows and asked.num_rows:
            own, asked = own.combine_chunks(), asked.combine_chunks()
            vectors, ids = matrix(own.column("vector").combine_chunks()), own.column("ids").to_pylist()
            queries = matrix(asked.column("vector").combine_chunks())
            floors = asked.column("floor").to_numpy(zero_copy_only=False).astype(float)
            floors = np.where(np.isnan(floors), -math.inf, floors)
            keys = [asked.column(name).to_pylist() for name in KEY]
            for at in range(0, len(queries), 256):
                part = slice(at, at + 256)
                found = best_of(vectors, ids, queries[part], floors[part], k)
                for key_1, key_2, (best, scores) in zip(keys[0][part], keys[1][part], found, strict=True):
                    if best:
                        for name, value in zip(HIT.names, (key_1, key_2, best, scores), strict=True):
                            hits[name].append(value)
        return pa.table(hits, schema=_arrow(HIT))

    left = dealt(rows, "row", "query", "at").groupBy(*units)
    right = dealt(visits, "query", "row", "key_1").groupBy(*units)
    return left.cogroup(right).applyInArrow(compare, HIT)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` ids of every query: KEY, ``id``, ``score``, ``place``."""
    pairs = hits.selectExpr(*KEY, "inline(arrays_zip(ids, scores))").withColumnsRenamed({"ids": "id", "scores": "score"})
    best = pairs.groupBy(*KEY, "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_vectors(
    df: DataFrame,
    k: int = NEAREST,
    query_step: int = QUERY_STEP,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    trees: int = TREES,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, id and ``score`` of the ``k`` nearest rows found for every id that ``query_step`` divides.

    Nearness is the inner product in double precision, ties go to the smaller id. Rows whose
    vector is null, empty or zero, holds a null or non-finite entry or has not the commonest length,
    and rows with a null id, take no part. A query never finds its own id. Rows that repeat an id
    count by the best pair of their vectors; other columns are ignored; an empty table gives an
    empty result. Queries get all other ids where there are fewer than ``k``.

    Equal vectors (by 128 bits of hash) are one candidate and one query, with as many of their
    ids as an answer can hold, so copies cost nothing. The rest is approximate: rows in leaves beyond
    a query's bound are not seen.
    """
    usable = usable_vectors(df, id_column, vector_column).where("id is not null and exists(vector, c -> c <> 0)")
    keyed = _keyed(usable)
    rows = written(distinct_vectors(keyed, k + 1), "vectors")
    asked = keyed.where(F.col("id") % query_step == 0)
    queries = written(
        asked.groupBy(*KEY).agg(F.first("vector").alias("vector")).withColumn("floor", F.lit(None).cast("double")),
        "queries",
    )
    entry = "double(array_max(transform(vector, c -> abs(c))))"
    n, largest = rows.agg(F.count("key_1"), F.max(F.expr(entry))).first()
    schema = f"query_id long, rank int, `{id_column}` long, score double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    part = f"double(c) / double('{largest!r}')"
    square = f"aggregate(vector, 0D, (s, c) -> s + {part} * {part})"
    length = math.sqrt(rows.agg(F.max(F.expr(square))).first()[0])
    forest = fit_forest(_sample(rows, n), n, largest, length, trees)

    placed = written(_leaf_rows(rows, forest), "leaves")
    near = written(_ranked(_compared(placed, _visits(queries, forest, True), k + 1), k + 1), "near")
    # The k + 1 best so far bound what else is worth seeing; with fewer there is no bound.
    floors = near.where(F.col("place") == k + 1).select(*KEY, F.col("score").alias("bound"))
    bounded = queries.join(floors, KEY, "left").select(*KEY, "vector", F.col("bound").alias("floor"))
    visits = written(_visits(bounded, forest, False), "visits")
    more = _compared(placed, visits, k + 1)
    all_hits = more.unionByName(near.select(*KEY, F.array("id").alias("ids"), F.array("score").alias("scores")))
    found = (
        _ranked(all_hits, k + 1)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    )
    answers = asked.select("id", *KEY).distinct().join(found, KEY)
    ids = answers.groupBy("id").agg(F.count(F.lit(1)).alias("vectors"), F.first("found").alias("found"))
    single = ids.where("vectors = 1").selectExpr("id as query_id", f"slice(filter(found, f -> f.id <> id), 1, {k}) as found")
    # Ids with several vectors: the best pair counts.
    several = answers.join(ids.where("vectors > 1").select("id"), "id").selectExpr("id as query_id", "inline(found)")
    several = several.where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    several = several.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    listed = single.selectExpr("query_id", "posexplode(found) as (at, f)").selectExpr(
        "query_id", "at + 1 as rank", "f.id as id", "f.score as score"
    )
    return listed.unionByName(several.select("query_id", "rank", "id", "score")).withColumnRenamed("id", id_column)
