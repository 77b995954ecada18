"""Alignment of two tokenizers' tokens over the same texts, by merge-path partitioning.

Tokens of A and B over one text are two ascending arrays of byte ends. Merging them is cut
into pieces of equal work: piece k has the ends between diagonals k * PIECE and
(k + 1) * PIECE of the merge, and a binary search along each diagonal finds how many of
them are A's. Pieces need nothing of each other, whatever the length of the texts in them:
each emits the overlaps of its tokens and the ends that both share. A shared end whose two
tokens fall to both sides of a diagonal is found when neighbouring pieces are stitched, and
groups of tokens run from one shared end to the next, through as many pieces as it takes.

A text is encoded in stretches before which both tokenizers always cut: a single blank,
followed by anything but white space. Equal stretches are encoded once. Ends meet at all such
cuts, so texts of any length are merged block by block in bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tradewind.llm.common import map_batches, written

PIECE = 8192  # ends of one piece
BLOCK_CHARS = 2 << 20  # characters merged at once; a longer stretch without a cut is merged whole
STRETCHES_KEPT = 1 << 19  # distinct stretches whose tokens a worker keeps; beyond, or with so many tokens, it starts anew
TOKENS_KEPT = 1 << 22
FREQUENT = 50_000  # pairs over this share of all links are at most so many, and are broadcast
CUT = re.compile(r"(?<=[^ ]) (?=\S)")


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and of ``b`` lie before each diagonal of their merge; of equal ends a's comes first.

    All diagonals are searched at once, each by halving.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # a[middle] comes before the diagonal if it is not above the b that would stand there instead.
        mine = a[np.minimum(middle, max(len(a) - 1, 0))]
        theirs = b[np.clip(diagonals - middle - 1, 0, max(len(b) - 1, 0))]
        before = mine <= theirs
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low, diagonals - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The overlaps of one piece's tokens, in order: places in ``a`` and places in ``b``.

    Every end closes a run of bytes that lies in one token of each side; those two overlap.
    The place after the last means the side's next token, which ends in a later piece.
    """
    under, over = np.searchsorted(b, a), np.searchsorted(a, b)
    both = np.append(b, -1)[under] == a
    alone = np.ones(len(b), bool)
    alone[under[both]] = False
    # An end of a stands after those of a before it and the ends of b alone that are less.
    place_a = np.arange(len(a)) + np.append(0, np.cumsum(alone))[under]
    place_b = np.arange(int(alone.sum())) + over[alone]
    left, right = np.empty(len(place_a) + len(place_b), np.int64), np.empty(len(place_a) + len(place_b), np.int64)
    left[place_a], left[place_b] = np.arange(len(a)), over[alone]
    right[place_a], right[place_b] = under, np.flatnonzero(alone)
    return left, right


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in ``a`` and in ``b`` of the ends that both have, ascending, and the number of overlaps of their tokens.

    A piece's overlaps whose two tokens end together are shared ends; where the two fall to
    both sides of a diagonal, its pieces are stitched.
    """
    cut_a, cut_b = diagonal_cuts(a, b, piece)
    found_a, found_b, total = [], [], 0
    for k in range(len(cut_a) - 1):
        own, other = a[cut_a[k] : cut_a[k + 1]], b[cut_b[k] : cut_b[k + 1]]
        if cut_a[k] and len(other) and a[cut_a[k] - 1] == other[0]:
            found_a.append([cut_a[k] - 1])
            found_b.append([cut_b[k]])
            total -= 1  # one run of bytes, closed in both pieces
        left, right = overlaps(own, other)
        together = np.append(own, -1)[left] == np.append(other, -2)[right]
        found_a.append(left[together] + cut_a[k])
        found_b.append(right[together] + cut_b[k])
        total += len(left)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(found_a + empty).astype(np.int64), np.concatenate(found_b + empty).astype(np.int64), total


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    others = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Side:
    """One tokenizer: ids of texts that follow a blank, and every id's bytes."""

    encode: Callable[[list[str]], list[list[int]]]
    token_bytes: list[bytes]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sizes = np.array([len(t) for t in self.token_bytes], np.int64)


@lru_cache(maxsize=2)
def byte_level_side(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; strings of its special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    alphabet = byte_alphabet()
    size = loaded.get_vocab_size()
    tokens = [loaded.id_to_token(k) or "" for k in range(size)]
    decoded = [
        bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens
    ]

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in loaded.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Side(encode, decoded)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A sentencepiece model that puts a blank before a text and changes nothing else."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    inner = [p for p in pieces if "▁" in p.lstrip("▁")]
    if inner:
        raise ValueError(f"pieces reach over blanks, as {inner[0]!r}: texts can't be encoded in stretches")
    decoded = [
        bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()
        for k, p in enumerate(pieces)
    ]
    blank = [model.piece_to_id("▁")]

    def encode(texts: list[str]) -> list[list[int]]:
        # An empty text has no blank put before it.
        return [ids or list(blank) for ids in model.encode(texts, num_threads=1)]

    return Side(encode, decoded)


class Stretches(dict):
    """Numbers of distinct stretches of text (without the blank before them), whose tokens of both sides it keeps."""

    def __init__(self, a: Side, b: Side):
        super().__init__()
        self.sides = (a, b)
        self.new: list[str] = []
        self._start_anew()

    def _start_anew(self) -> None:
        self.clear()
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # of every stretch, and the end of the last
        self.spelled = np.empty(0, bool)

    def __missing__(self, stretch: str) -> int:
        self[stretch] = number = len(self)
        self.new.append(stretch)
        return number

    def numbers(self, runs: list[list[str]]) -> list[np.ndarray]:
        """The numbers of every run's stretches; earlier numbers may not be used afterwards."""
        if len(self) > STRETCHES_KEPT or max(map(len, self.ids)) > TOKENS_KEPT:
            self._start_anew()
        found = [np.fromiter(map(self.__getitem__, run), np.int64, len(run)) for run in runs]
        new, self.new = self.new, []
        if new:
            self._encode(new)
        return found

    def _encode(self, texts: list[str]) -> None:
        wanted = [b" " + text.encode() for text in texts]
        spelled = np.ones(len(texts), bool)
        for k, side in enumerate(self.sides):
            ids = side.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            parts = list(map(side.token_bytes.__getitem__, flat.tolist()))
            if b"".join(parts) != b"".join(wanted) or not self._same_sizes(side, flat, sizes, wanted):
                ends = np.cumsum(sizes).tolist()
                spelled &= [
                    b"".join(parts[i:j]) == want for i, j, want in zip([0, *ends], ends, wanted, strict=False)
                ]
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(sizes)])
            self.ids[k] = np.concatenate([self.ids[k], flat])
        self.spelled = np.concatenate([self.spelled, spelled])

    @staticmethod
    def _same_sizes(side: Side, flat: np.ndarray, sizes: np.ndarray, wanted: list[bytes]) -> bool:
        ends = np.append(0, np.cumsum(side.sizes[flat]))[np.cumsum(sizes)]
        return bool((ends == np.cumsum(list(map(len, wanted)))).all())

    def tokens(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these stretches, end to end, and how many each has."""
        starts = self.starts[side][numbers]
        sizes = self.starts[side][numbers + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.ids[side][np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))], sizes


@dataclass
class Aligned:
    """What is known of one text after the stretches merged so far."""

    valid: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    begun: bool = False
    pairs: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    groups: list[tuple[np.ndarray, ...]] = field(default_factory=list)


@lru_cache(maxsize=2)
def written_ids(size: int, inner: str, last: str) -> tuple[np.ndarray, np.ndarray]:
    """Every id in decimal, followed by the sign inside a group and by that after the side's last."""
    ids = [str(k) for k in range(size)]
    return np.array([k + inner for k in ids], object), np.array([k + last for k in ids], object)


def merge_block(parts: list[tuple[Aligned, np.ndarray]], stretches: Stretches, keep_groups: bool) -> None:
    """Merge runs of stretches of several texts at once and add what comes out to each text."""
    if not parts:
        return
    sides, numbers = stretches.sides, np.concatenate([run for _, run in parts])
    of_run = np.cumsum([len(run) for _, run in parts])
    ids, of_text = [], []
    for k in (0, 1):
        own, sizes = stretches.tokens(numbers, k)
        ids.append(own)
        of_text.append(np.append(0, np.cumsum(sizes)[of_run - 1]))
    ends = [np.cumsum(side.sizes[own]) for side, own in zip(sides, ids, strict=True)]
    at_a, at_b, _ = shared_ends(*ends)
    last_group = np.searchsorted(at_a, of_text[0][1:] - 1) + 1  # groups up to the end of each text

    code = (ids[0][at_a].astype(np.int64) << 32) | ids[1][at_b]
    # A token stands after all tokens of its side and the other side's tokens of the groups before (A) or up to its own (B).
    groups_a = np.searchsorted(at_a, np.arange(len(ids[0])))
    groups_b = np.searchsorted(at_b, np.arange(len(ids[1])))
    place_a = np.arange(len(ids[0])) + np.append(0, at_b + 1)[groups_a]
    place_b = np.arange(len(ids[1])) + (at_a + 1)[groups_b]
    signs_a = written_ids(len(sides[0].token_bytes), ",", "|")
    signs_b = written_ids(len(sides[1].token_bytes), ",", ";")
    line = np.empty(len(ids[0]) + len(ids[1]), object)
    line[place_a] = signs_a[0][ids[0]]
    line[place_b] = signs_b[0][ids[1]]
    line[place_a[at_a]] = signs_a[1][ids[0][at_a]]
    line[place_b[at_b]] = signs_b[1][ids[1][at_b]]

    first = 0
    for k, (text, _) in enumerate(parts):
        a, b = of_text[0][k : k + 2], of_text[1][k : k + 2]
        own = slice(first, first := int(last_group[k]))
        text.n_a += int(a[1] - a[0])
        text.n_b += int(b[1] - b[0])
        text.n_groups += own.stop - own.start
        # Groups are parted by ";": the one after a stretch's last group belongs before the next.
        text.digest.update((";" * text.begun + "".join(line[a[0] + b[0] : a[1] + b[1]].tolist())[:-1]).encode())
        text.begun = True
        pairs, counts = np.unique(code[own], return_counts=True)
        text.pairs.append(pairs)
        text.counts.append(counts)
        if keep_groups:
            text.groups.append((ids[0][a[0] : a[1]], ids[1][b[0] : b[1]], at_a[own] - a[0] + 1, at_b[own] - b[0] + 1))


def stretches_of(text: str) -> Iterator[list[str]]:
    """The stretches of a blank and a text, without the blank before each, in runs of about a block."""
    start = 0
    while len(text) - start > BLOCK_CHARS:
        cut = CUT.search(text, start + BLOCK_CHARS - 1)
        if cut is None:
            break
        yield CUT.split(text[start : cut.start()])
        start = cut.end()  # the next stretch's own blank
    yield CUT.split(text[start:])


def aligned(texts: list[str | None], stretches: Stretches, keep_groups: bool) -> list[Aligned]:
    """Every text aligned, block by block."""
    results = [Aligned(valid=bool(t)) for t in texts]
    block: list[tuple[Aligned, list[str]]] = []
    size = 0

    def merge() -> None:
        runs = stretches.numbers([run for _, run in block])
        known = []
        for (result, _), run in zip(block, runs, strict=True):
            result.valid = result.valid and bool(stretches.spelled[run].all())
            if result.valid:
                known.append((result, run))
        merge_block(known, stretches, keep_groups)
        block.clear()

    for text, result in zip(texts, results, strict=True):
        for run in stretches_of(text) if text else ():
            block.append((result, run))
            size += sum(map(len, run)) + len(run)
            if size >= BLOCK_CHARS:
                merge()
                size = 0
    merge()
    return results


@lru_cache(maxsize=1)
def stretches_for(a_path: str, b_path: str) -> Stretches:
    return Stretches(byte_level_side(a_path), piece_side(b_path))


GROUP = T.StructType([T.StructField(side, T.ArrayType(T.IntegerType())) for side in ("a", "b")])
ALIGNED = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("id", T.LongType()),
        *[T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
        T.StructField("groups", T.ArrayType(GROUP)),
    ]
)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([*parts, np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))


def _group_rows(text: Aligned) -> list[dict]:
    rows = []
    for ids_a, ids_b, to_a, to_b in text.groups:
        from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
        for i, j, k, m in zip(from_a, to_a, from_b, to_b, strict=True):
            rows.append({"a": ids_a[i:j].tolist(), "b": ids_b[k:m].tolist()})
    return rows


def _aligned_texts(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stretches = stretches_for(a_path, b_path)
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = aligned(part.column("text").to_pylist(), stretches, keep_groups)
                found = [t if t.valid else Aligned(valid=False) for t in found]
                pairs, counts = [], []
                for text in found:
                    known, back = np.unique(np.concatenate([*text.pairs, np.empty(0, np.int64)]), return_inverse=True)
                    times = np.zeros(len(known), np.int64)
                    np.add.at(times, back, np.concatenate([*text.counts, np.empty(0, np.int64)]))
                    pairs.append(known)
                    counts.append(times)
                yield {
                    "place": np.arange(place, place + len(found)),
                    "id": part.column("id"),
                    "n_a": [t.n_a for t in found],
                    "n_b": [t.n_b for t in found],
                    "n_groups": [t.n_groups for t in found],
                    "n_links": [int(c.sum()) for c in counts],
                    "groups_sha256": [t.digest.hexdigest() if t.begun else "" for t in found],
                    "pairs": _lists(pairs, pa.int64()),
                    "times": _lists(counts, pa.int64()),
                    "groups": [_group_rows(t) if keep_groups else None for t in found],
                }
                place += len(found)

    return map_batches(docs, rows, ALIGNED)


def align_tokens(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_groups: bool = True,
) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and ``groups``.

    A is a byte-level vocabulary and B a sentencepiece model, both over a blank and the text,
    without special tokens. A group is a run of tokens between two byte offsets where both
    sides end a token (``groups``: its ids of A and of B). The last tokens of a group end together
    and are linked. A pair of ids counts as often as the corpus links it; ``count_sum`` adds that
    over a text's links, ``n_best`` is the number of its links whose pair counts most of all with
    the same id of B. Texts that are null or empty, or whose tokens don't spell them (as those
    with U+2581, which B reads as a blank), have no tokens: zeros, no groups, an empty digest.
    Repeated ids and null ids keep their rows; other columns are ignored; an empty table
    gives an empty result.

    Texts are encoded once and written with their distinct pairs; counts are joined back to
    those. Pairs that hold over 1 / FREQUENT of all links can only be FREQUENT many and are
    broadcast; the others, each rare, are shuffled by pair.
    """
    chosen = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    texts = written(_aligned_texts(chosen, a_path, b_path, with_groups), "aligned")
    links = texts.select("place", F.expr("inline(arrays_zip(pairs, times))")).withColumnRenamed("pairs", "pair")
    counted = written(links.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    best = counted.groupBy(F.expr("pair & 4294967295").alias("b")).agg(F.max("count").alias("most"))
    total = texts.agg(F.sum("n_links")).first()[0] or 0
    known = counted.withColumn("b", F.expr("pair & 4294967295")).join(F.broadcast(best), "b")  # a row for each id of B
    known = written(known.select("pair", "count", (F.col("count") == F.col("most")).alias("is_best")), "known")
    often = known.where(F.col("count") * FREQUENT > total)
    rare = known.where(F.col("count") * FREQUENT <= total)
    near = links.join(F.broadcast(often), "pair", "left")
    met = near.where("count is not null").select("place", "times", "count", "is_best")
    far = near.where("count is null").select("pair", "place", "times").join(rare, "pair")
    sums = (
        met.unionByName(far.select("place", "times", "count", "is_best"))
        .groupBy("place")
        .agg(F.sum(F.expr("if(is_best, times, 0)")).alias("n_best"), F.expr("sum(times * count)").alias("count_sum"))
    )
    found = texts.join(sums, "place", "left").select(
        F.col("id").alias(id_column),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.expr("coalesce(n_best, 0)").alias("n_best"),
        F.expr("coalesce(count_sum, 0)").alias("count_sum"),
        "groups_sha256",
        "groups",
    )
    return found if with_groups else found.drop("groups")
