"""Near copies by n-gram Jaccard similarity, found with T-occurrence search.

Two texts link when their sets of word n-grams reach a Jaccard similarity. Exact copies of
a set are one node. Links of nodes are found by T-occurrence search in small collections
("cells"): inverted lists from shingle to nodes, of which a node's short ones are merged
with a heap and its long ones probed by binary search (DivideSkip), keeping nodes that
reach the required overlap.

Cells are chosen so that no link crosses them, in two exact steps. A set of n shingles that links
with any other shares at least ``needed(n)`` of them, so it has at most n - needed(n) that no
other set has. Those of a fixed third of all shingles are counted first, and sets with too many
are done with: most texts of a corpus. Of the sets that stay, shingles are ordered by the number of
sets that have them; the first that two linked sets share is among the first n - needed(n) + 1
of either, its prefix. Nodes that share a shingle of their prefixes hang together, and a cell is what
hangs together.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import map_batches, written
from tradewind.llm.components import components

WORDS = 3
PERCENT = 90
CELL_SHINGLES = 4 << 20  # shingles of one task's collection; larger cells are split in blocks, each pair of which is one
WORDS_KEPT = 1 << 20  # distinct words whose hash a worker keeps
MU = 0.0085  # weight of the long lists in choosing their number
SAMPLED = (1 << 64) // 3  # shingles below are counted first
FILTER_BITS = 1 << 27  # of the bitmap of ids whose texts are read again
LEADERS = 8  # nodes that a new one is compared with before lists are searched

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def word_hashes() -> dict[bytes, int]:
    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            found = xxhash.xxh3_64_intdigest(word)
            if len(self) < WORDS_KEPT:
                self[word] = found
            return found

    return Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    A-Z are lower-cased; words are runs without blank, tab, line feed, vertical tab, form
    feed and carriage return. Fewer words than n make one shingle, no words none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed((total ^ hashes[k : len(hashes) - n + 1 + k]) * MIX[k % 3])
    return np.unique(total)


def needed(size: int, percent: int) -> int:
    """Shingles that a set shares at least with any that it links to."""
    return -(-percent * size // 100)


def set_key(found: np.ndarray) -> int:
    """A hash of a whole set."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


class Forest:
    """Union-find over nodes 0..n-1, with every node's root in an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = {k: [k] for k in range(n)}

    def join(self, a: int, b: int) -> None:
        a, b = self.root[a], self.root[b]
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of the sets that link, as many as join all that hang together; no set is empty.

    Nodes are taken in order of size. Each is first compared with a few leaders, nodes that
    joined none before them, those first that others joined last, and then with those that most
    have joined. The largest class that this leaves is kept out of the inverted lists:
    its members search the lists of the others, so many near copies of one text cost no
    more than their comparisons with leaders. T is the least overlap with any set that
    links; the long lists are as many as DivideSkip chooses from T and the longest list.
    Nodes already joined to the searched one are left out of its lists before these are merged.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sets = [sets[k] for k in order]
    sizes = [len(s) for s in sets]
    forest, found = Forest(len(sets)), []
    leaders: list[int] = []
    drawn: Counter[int] = Counter()

    def joined(x: int, y: int) -> None:
        forest.join(x, y)
        found.append((order[x], order[y]))

    def compared(x: int, leaders: list[int]) -> list[int]:
        """The leaders that x links to."""
        linked = []
        for y in leaders:
            small, large = sorted((sizes[x], sizes[y]))
            if forest.root[x] != forest.root[y] and 100 * small >= percent * large:
                shared = overlap(sets[x], sets[y])
                if 100 * shared >= percent * (small + large - shared):
                    joined(x, y)
                    linked.append(y)
        return linked

    for x in range(len(sets)):
        linked = compared(x, leaders[-LEADERS:])
        # Leaders that were of use stay among the last, however many nodes stand alone; a node that
        # joins several is one itself.
        useful = [*linked, x] if len(linked) != 1 else linked
        drawn.update(linked)
        drawn[x] += len(linked) if len(linked) > 1 else 0
        leaders = [*(y for y in leaders[-4 * LEADERS :] if y not in linked), *useful]
    # Those that drew most come too late for nodes before them.
    best = [y for y, n in drawn.most_common(LEADERS) if n]
    for x in range(len(sets)):
        compared(x, best)
    if len(forest.members) <= 1:
        return found

    largest = max(forest.members.values(), key=len)
    listed = np.ones(len(sets), bool)
    listed[largest] = False
    outside = np.flatnonzero(listed)
    nodes = np.repeat(outside, [sizes[k] for k in outside])
    flat = np.concatenate([sets[k] for k in outside])
    by_value = np.argsort(flat, kind="stable")  # inside a list, nodes ascend
    values, starts, lengths = np.unique(flat[by_value], return_index=True, return_counts=True)
    nodes = nodes[by_value]

    for x, own in enumerate(sets):
        # Of two listed nodes the later one searches; members of the largest class search all that is listed.
        end = x if listed[x] else len(sets)
        at = np.searchsorted(values, own)
        at[at == len(values)] = 0
        at = at[values[at] == own]
        if listed[x]:
            at = at[lengths[at] > 1]  # a list of one has x alone
        least = -(-percent * sizes[x] // 100)
        if len(at) < least:
            continue
        longest = int(lengths[at].max())
        n_long = min(least - 1, int(least / (MU * math.log2(longest) + 1)), len(at))
        at = at[np.argsort(lengths[at], kind="stable")]
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        lists = []
        for k in short:
            row = nodes[starts[k] : starts[k] + lengths[k]]
            row = row[: np.searchsorted(row, end)]
            row = row[forest.root[row] != forest.root[x]]
            if len(row):
                lists.append(row.tolist())
        for y, seen in merged(lists, least - n_long):
            small, large = sorted((sizes[x], sizes[y]))
            if forest.root[x] == forest.root[y] or 100 * small < percent * large:
                continue
            need = -(-percent * (small + large) // (100 + percent))
            left = n_long
            for k in long:
                if seen >= need or seen + left < need:
                    break
                left -= 1
                row = nodes[starts[k] : starts[k] + lengths[k]]
                place = np.searchsorted(row, y)
                seen += bool(place < len(row) and row[place] == y)
            if seen >= need:
                joined(x, y)
    return found


def merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Values that stand in at least so many of the ascending lists, with their count, by a heap of list heads."""
    heap = [(row[0], k, 0) for k, row in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        value, seen = heap[0][0], 0
        while heap and heap[0][0] == value:
            _, k, at = heap[0]
            seen += 1
            if at + 1 < len(lists[k]):
                heapq.heapreplace(heap, (lists[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if seen >= least:
            yield value, seen


NODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("sample", T.ArrayType(T.LongType())),
    ]
)
SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """Every row's number of shingles and node, and once a task the node's sampled shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        none = np.empty(0, np.uint64)
        seen: set[int | None] = {None}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                nodes = [set_key(s) if len(s) else None for s in sets]
                samples = []
                for own, node in zip(sets, nodes, strict=True):
                    samples.append(none if node in seen else own[: np.searchsorted(own, np.uint64(SAMPLED))])
                    seen.add(node)
                yield {
                    "id": part.column("id"),
                    "n_shingles": [len(s) for s in sets],
                    "node": nodes,
                    "sample": _lists(samples),
                }

    return map_batches(docs, rows, NODES)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """The shingles of the nodes named beside the texts (node, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                named = zip(part.column("node").to_pylist(), part.column("text").to_pylist(), strict=True)
                found = [(node, shingles(text, words)) for node, text in named]
                # A repeated id may bring other texts along.
                found = [(node, own) for node, own in found if len(own) and set_key(own) == node]
                yield {"node": [node for node, _ in found], "shingles": _lists([own for _, own in found])}

    return map_batches(texts, rows, SETS)


def _needed(percent: int) -> str:
    return f"((n * {percent} + 99) div 100)"


def _alone(each: DataFrame) -> DataFrame:
    """(node, alone): how many of its shingles (node, shingle) no other node has; nodes without such are left out."""
    return (
        each.groupBy("shingle")
        .agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .where("node = other")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("alone"))
    )


def _linkable(rows: DataFrame, percent: int) -> DataFrame:
    """(node, id, n) of the nodes whose sampled shingles leave room for a link; ``id`` is the least of the node's rows."""
    alone = _alone(rows.select("node", F.explode("sample").alias("shingle")))
    nodes = (
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("at"), F.min("n_shingles").alias("n"))
    )
    left = nodes.join(alone, "node", "left").where(f"coalesce(alone, 0) <= n - {_needed(percent)}")
    return left.select("node", "at.id", "n")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the rows of ``docs`` (id, text) whose id is among ``wanted`` (node, id).

    A bitmap of FILTER_BITS hashed ids, of fixed size, keeps most other texts out of the shuffle.
    """
    bit = F.expr(f"pmod(xxhash64(id), {FILTER_BITS})")
    maps = (
        wanted.select(bit.alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    )
    known = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in maps.toLocalIterator():  # FILTER_BITS in all, whatever the number of ids
        at = (bucket - 1) * len(bits)
        known[at : at + len(bits)] = np.frombuffer(bytes(bits), np.uint8)[: len(known) - at]
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            place = batch.column("bit").to_numpy()
            hit = (sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            own = batch.filter(pa.array(hit.astype(bool)))
            if own.num_rows:
                yield {"id": own.column("id"), "text": own.column("text")}

    near = map_batches(docs.select("id", "text", bit.alias("bit")), rows, schema)
    return near.join(wanted, near["id"].eqNullSafe(wanted["id"])).select("node", "text")


def _needy(sets: DataFrame, percent: int) -> DataFrame:
    """The sets that all their shingles leave room for a link, counted among these sets alone."""
    alone = _alone(sets.select("node", F.explode("shingles").alias("shingle")))
    left = sets.join(alone, "node", "left").withColumn("n", F.size("shingles"))
    return left.where(f"coalesce(alone, 0) <= n - {_needed(percent)}").select("node", "shingles")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(part, node) for the shingles of every set's prefix that another set has too."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("part"))
    frequent = each.groupBy("part").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    own = Window.partitionBy("node")
    shared = each.join(frequent, "part").select(
        "part",
        "node",
        "n",
        F.row_number().over(own.orderBy("sets", "part")).alias("place"),
        F.count(F.lit(1)).over(own).alias("shared"),
    )
    # Shingles of one set alone come first: the prefix has n - shared of them.
    return shared.where(f"place <= shared - {_needed(percent)} + 1").select("part", "node")


def _hanging(parts: DataFrame) -> DataFrame:
    """Edges (a, b) by which nodes with an equal part hang together.

    Rows are dealt by ranges of (part, node), so the nodes of one part may lie in many
    partitions; each partition names its first node of its last and first part, and those
    are tied afterwards.
    """
    dealt = parts.repartitionByRange("part", "node").sortWithinPartitions("part", "node")
    schema = T.StructType([*EDGES.fields, T.StructField("part", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last_part = last_node = None
        first_part = None
        ties: dict[int, int] = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            node = batch.column("node").to_numpy()
            if not len(part):
                continue
            if first_part is None:
                first_part = int(part[0])
                ties[first_part] = int(node[0])
            new = np.append(part[0] != last_part if last_part is not None else True, part[1:] != part[:-1])
            head = np.where(new, np.arange(len(part)), -1)
            head = np.maximum.accumulate(head)
            lead = np.where(head >= 0, node[head], last_node if last_node is not None else 0)
            differs = lead != node
            if differs.any():
                pairs = np.unique(np.stack([lead[differs], node[differs]], axis=1), axis=0)
                yield {"a": pairs[:, 0], "b": pairs[:, 1], "part": [None] * len(pairs)}
            last_part, last_node = part[-1], lead[-1]
        if last_part is not None:
            ties[int(last_part)] = int(last_node)
            yield {"a": list(ties.values()), "b": list(ties.values()), "part": list(ties)}

    found = written(map_batches(dealt, rows, schema), "hanging")
    ends = found.where("part is not null")
    first = ends.groupBy("part").agg(F.min("a").alias("root"))
    tied = ends.join(first, "part").select(F.col("root").alias("a"), "b")
    return found.where("part is null").select("a", "b").union(tied).where("a <> b").distinct()


def _cell_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes from rows (unit, node, shingles), every unit's rows in one partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unit, own = None, {}
        for row in chain(chain.from_iterable(_rows(b) for b in batches), [(None, None, None)]):
            if row[0] != unit:
                names = list(own)
                pairs = links(list(own.values()), percent) if len(own) > 1 else []
                if pairs:
                    yield {"a": [names[a] for a, _ in pairs], "b": [names[b] for _, b in pairs]}
                unit, own = row[0], {}
            if row[0] is not None:
                own[row[1]] = row[2]

    return map_batches(sets, rows, EDGES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    units, nodes = batch.column("unit").to_pylist(), batch.column("node").to_pylist()
    sets = (x.values.to_numpy().view(np.uint64) for x in batch.column("shingles"))
    return zip(units, nodes, sets, strict=True)


def ngram_classes(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` of every row: the least id it is linked to, directly or not.

    Two rows link when 100 * shared >= ``percent`` * all of their distinct word n-grams.
    Null and empty texts have no shingles and link with nothing, also not with each other.
    Rows that repeat an id are texts of their own that share it; rows with a null id take part
    and get the least known id of their class, or null. Other columns are ignored, an empty
    table gives an empty result. Shingles and whole sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    chosen = docs.selectExpr(f"cast(`{id_column}` as bigint) as id", f"`{text_column}` as text")
    rows = written(_nodes(chosen, words), "sets")
    linkable = written(_linkable(rows, percent), "linkable")
    sets = written(_sets(_texts_of(chosen, linkable), words).dropDuplicates(["node"]), "shingles")
    sets = written(_needy(sets, percent), "shingles")
    cells = components(_hanging(_prefixes(sets, percent)))

    known = sets.join(cells.withColumnRenamed("root", "cell"), "node")
    blocks = known.groupBy("cell").agg(F.ceil(F.sum(F.size("shingles")) / CELL_SHINGLES).alias("blocks"))
    sized = known.join(blocks, "cell").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    # A cell of b blocks is searched as the b * (b + 1) / 2 pairs of its blocks.
    placed = sized.select(
        "node",
        "shingles",
        F.explode(
            F.expr(
                "transform(sequence(0, blocks - 1), o -> xxhash64(cell, least(block, o), greatest(block, o)))"
            )
        ).alias("unit"),
    )
    n_units = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = placed.repartition(n_units, "unit").sortWithinPartitions("unit")
    roots = components(written(_cell_links(dealt, percent), "links"))

    own = rows.select("id", "n_shingles", "node").join(roots, "node", "left")
    own = own.withColumn("class", F.coalesce("root", "node"))
    least = own.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    return own.join(least, "class", "left").select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


def one_of_each_class(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with the least id of their class, one of each class.

    Of rows that repeat such an id one stays, the least by its text; rows without shingles
    are classes of their own by id, and rows with a null id all stay.
    """
    classes = ngram_classes(docs, words, percent).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    # Rows travel as one column, so that no name of theirs can clash.
    row = F.struct(*[F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]).alias("row")
    rows, own = docs.select(row), F.col("row.doc_id")
    first = Window.partitionBy(own).orderBy(F.xxhash64("row.text"), "row.text")
    kept = rows.where(own.isNotNull()).join(classes, own.cast("long") == F.col("id"), "left_semi")
    kept = kept.withColumn("place", F.row_number().over(first)).where("place = 1").select("row")
    return kept.unionByName(rows.where(own.isNull())).select("row.*")


def oracle(words: int = WORDS, percent: int = PERCENT) -> str:
    """The query over ``documents`` in DuckDB's SQL."""
    gram = f"list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT doc_id, {gram} AS words FROM d),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[k + 1 : k + {words}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - {words - 1}, 1))) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id"""
