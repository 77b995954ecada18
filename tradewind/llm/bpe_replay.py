"""Byte-level BPE by replaying the merges over all distinct words of a block of texts at once.

A block of texts is cut into the words of the split pattern; its distinct words lie end to
end in one array of symbols. An inverted index leads from a pair's rank to the positions
where that pair stands, and every merge is applied in rank order to all its positions,
updating only the touched neighbours. The ids of a text are those of its words.

The split pattern makes the ids of a word independent of its text, so blocks only bound the
memory: the result is the same for any block size, and a task reuses the words it knows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import map_batches

BLOCK_CHARS = 32 << 20  # code points of texts whose distinct words are merged together
RUN_CHARS = 1 << 20  # code points of texts whose ids and bytes are made at once
NEW_PIECES, NEW_CHARS = 1 << 18, 4 << 20  # distinct pieces, and their code points, that are learned at once
PIECES_KEPT, CHARS_KEPT = 1 << 19, 8 << 20  # those that a task keeps; beyond, it starts anew with the next block
LEVEL = 512  # ranks whose positions are sorted together
PAIRS_AT_ONCE = 1 << 18  # pairs looked up together; bounds what a long array needs besides its ranks
NONE = np.int32(2**31 - 1)

# White space of the split pattern, each followed by a space.
SPACE_AFTER_SPACE = [f"{c} " for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"]
SPACE_AFTER_SPACE += [f"{chr(c)} " for c in range(0x2000, 0x200B)]

SCHEMA = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class Ranks:
    """A rank file: token bytes by id, and the rank of every pair whose bytes joined are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        lefts, rights, ids = [], [], []
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    lefts.append(left)
                    rights.append(right)
                    ids.append(rank)
        keys = np.array(lefts, np.int64) * (self.size + 1) + np.array(rights, np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.pair_ranks = np.append(np.array(ids, np.int32)[order], NONE)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.widths = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.starts = np.cumsum(self.widths) - self.widths
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where the joined bytes are no token."""
        if len(left) > PAIRS_AT_ONCE:
            cuts = range(0, len(left), PAIRS_AT_ONCE)
            return np.concatenate([self.pairs(left[a : a + PAIRS_AT_ONCE], right[a : a + PAIRS_AT_ONCE]) for a in cuts])
        wanted = left.astype(np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.pair_ranks[at], NONE)

    def word(self, word: bytes) -> list[int]:
        """Ids of one word by the definition: merge the leftmost pair of lowest rank until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, NONE) for a, b in itertools.pairwise(parts)]
            best = min(range(len(found)), key=found.__getitem__)
            if found[best] == NONE:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the number of ids of each word. No word is empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(words) else 0
    if not n:
        return np.empty(0, np.int32), lengths
    sym = np.empty(n + 1, np.int32)
    sym[:n] = ranks.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    sym[n] = ranks.size  # right of a word's end; pairs with nothing
    after = np.arange(1, n + 2, dtype=np.int32)
    after[ends - 1] = n
    before = np.arange(-1, n, dtype=np.int32)
    before[ends[:-1]] = -1
    rank_at = np.full(n + 1, NONE, np.int32)
    rank_at[:n] = ranks.pairs(sym[:n], sym[after[:n]])
    odd: list[np.ndarray] = []

    for top in range(LEVEL, ranks.size + LEVEL, LEVEL):
        # The inverted index of the next ranks; nothing of lower rank is left.
        places = np.flatnonzero(rank_at < top)
        held = rank_at[places]
        order = np.argsort(held, kind="stable")
        places, held = places[order], held[order]
        if not len(places):
            continue
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        index: dict[int, list[np.ndarray]] = {
            int(held[a]): [places[a:b]] for a, b in itertools.pairwise([*starts, len(held)])
        }
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            gone = after[at]
            chained = gone[:-1] == at[1:]
            if chained.any():  # overlapping pairs, as in aaa: every second one of a run, from the left
                run = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.append(False, chained), 0, run))
                at = at[(run - first) % 2 == 0]
                gone = after[at]
            right = after[gone]
            sym[at] = rank
            sym[gone] = -1
            rank_at[gone] = NONE
            after[at] = right
            before[right] = at
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            new = ranks.pairs(sym[touched], sym[after[touched]])
            rank_at[touched] = new
            soon = new < top
            if soon.any():
                now, new = touched[soon], new[soon]
                if (new <= rank).any():  # only in a vocabulary that no training gives: such words are done one by one
                    odd.append(now[new <= rank])
                for value in np.unique(new):
                    if int(value) not in index:
                        heapq.heappush(heap, int(value))
                    index.setdefault(int(value), []).append(now[new == value])

    alive = sym[:n] >= 0
    counts = np.add.reduceat(alive, ends - lengths, dtype=np.int64)
    ids = sym[:n][alive]
    if odd:
        cut = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")):
            cut[k] = np.array(ranks.word(words[k]), np.int32)
        ids, counts = np.concatenate(cut), np.fromiter(map(len, cut), np.int64, len(cut))
    return ids, counts


class Waiting:
    """New pieces in the order of their numbers, until they are learned."""

    def __init__(self):
        self.learned = self.chars = 0
        self.pieces: list[str] = []

    def add(self, piece: str) -> int:
        self.pieces.append(piece)
        self.chars += len(piece)
        return self.learned + len(self.pieces) - 1

    def take(self) -> list[str]:
        pieces, self.pieces, self.chars = self.pieces, [], 0
        self.learned += len(pieces)
        return pieces


class Numbers(dict):
    """Numbers of pieces; one that is asked for the first time is put to the waiting ones."""

    def __init__(self, waiting: Waiting, lead: str):
        super().__init__()
        self.waiting, self.lead = waiting, lead

    def __missing__(self, piece: str) -> int:
        self[piece] = number = self.waiting.add(self.lead + piece)
        return number


class Vocabulary:
    """Pieces of texts met so far with their ids; a task keeps it from block to block."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.waiting, self.chars = Waiting(), 0
        self.spaced, self.plain = Numbers(self.waiting, " "), Numbers(self.waiting, "")  # spaced: without their leading space
        self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, np.int32)

    def cut(self, text: str) -> np.ndarray:
        """Numbers of a text's pieces; those not met before wait for ``learn``.

        Where no space follows white space, a word of the pattern can only hold a space as its
        first character, so such a text is first cut before its spaces, which is cheap, and the
        pattern is run on new pieces only. Other texts are cut by the pattern itself.
        """
        if any(gap in text for gap in SPACE_AFTER_SPACE):
            pieces = self.pattern.findall(text)
            return np.fromiter(map(self.plain.__getitem__, pieces), np.int32, len(pieces))
        pieces = text.split(" ")
        part = np.empty(len(pieces), np.int32)
        part[0] = self.plain[pieces[0]]
        part[1:] = np.fromiter(map(self.spaced.__getitem__, itertools.islice(pieces, 1, None)), np.int32, len(pieces) - 1)
        return part

    def is_full(self) -> bool:
        """Whether the waiting pieces are to be learned before more texts are cut."""
        return len(self.waiting.pieces) >= NEW_PIECES or self.waiting.chars >= NEW_CHARS

    def learn(self) -> None:
        """Ids of the waiting pieces: those of their words, end to end."""
        numbering = itertools.count()
        words: dict[str, int] = defaultdict(lambda: next(numbering))
        flat, ends = array("q"), array("q", [0])
        self.chars += self.waiting.chars
        for piece in self.waiting.take():
            flat.extend([words[word] for word in self.pattern.findall(piece)])
            ends.append(len(flat))
        spelled = [word.encode() for word in words]
        del words
        ids, counts = replay(spelled, self.ranks)
        used, edges = np.frombuffer(flat, np.int64), np.frombuffer(ends, np.int64)
        self.ids = np.append(self.ids, gather(ids, np.cumsum(counts) - counts, counts, used))
        self.sizes = np.append(self.sizes, np.diff(np.append(0, np.cumsum(counts[used]))[edges]))

    def ids_of(self, parts: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Ids of every text that was cut; all its pieces are learned."""
        starts = np.cumsum(self.sizes) - self.sizes
        return (gather(self.ids, starts, self.sizes, part) for part in parts)

    def start_block(self) -> None:
        if len(self.sizes) > PIECES_KEPT or self.chars > CHARS_KEPT:
            self.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text of one block."""
        self.start_block()
        parts = [self.cut(text) for text in texts]
        self.learn()
        return list(self.ids_of(parts))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted segments of ``values`` end to end; segment k has ``sizes[k]`` values from ``starts[k]``."""
    size = sizes[wanted]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[wanted] - (ends - size), size) + np.arange(total)]


def decode_ids(ids: np.ndarray, ranks: Ranks) -> bytes:
    return gather(ranks.flat, ranks.starts, ranks.widths, ids).tobytes()


def blocks(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[list[tuple[pa.Array, list[np.ndarray]]]]:
    """Learned blocks of rows in runs of about ``RUN_CHARS`` code points: the rows' ids and their texts, cut (null: empty).

    A block ends within a batch too, after ``BLOCK_CHARS`` code points or when the vocabulary is full. One text at a
    time is a string of its own.
    """
    known.start_block()
    block: list[tuple[pa.Array, list[np.ndarray]]] = []
    size = 0
    for batch in batches:
        keys, texts = batch.column("id"), batch.column("text")
        parts: list[np.ndarray] = []
        run = start = 0
        for row in range(batch.num_rows):
            text = texts[row].as_py() or ""
            parts.append(known.cut(text))
            run += len(text)
            whole = size + run >= BLOCK_CHARS or known.is_full()
            if whole or run >= RUN_CHARS or row == batch.num_rows - 1:
                # A copy, as a slice would hold the whole batch.
                block.append((keys.take(pa.array(np.arange(start, row + 1))), parts))
                size += run
                parts, run, start = [], 0, row + 1
            if whole:
                known.learn()
                yield block
                known.start_block()
                block, size = [], 0
    if block:
        known.learn()
        yield block


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Ids, counts and the decoded text of every text; one row per row of ``docs``.

    Columns: the id column, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` (of the bytes the ids decode to) and,
    with ``with_ids``, ``ids`` (array of int) and ``decoded`` (binary). Nulls and empty
    texts have no ids, null ids of rows stay null, repeated rows stay, an empty table
    gives an empty result and other columns are ignored.

    ``ranks_path`` must be readable on every executor. Memory of a task: one batch, the cut
    texts of a block (``BLOCK_CHARS`` code points, four bytes a piece), the new pieces of it
    (``NEW_PIECES``, ``NEW_CHARS``) and those kept (``PIECES_KEPT``, ``CHARS_KEPT``), each
    exceeded by one text at most.
    """
    chosen = docs.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text")
    kind = chosen.schema["id"].dataType
    fields = [T.StructField(id_column, kind), *SCHEMA.fields]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ranks = ranks_of(ranks_path)
        known = Vocabulary(ranks, pattern)  # of this task only: a worker that waits for its next one holds no pieces
        for block in blocks(batches, known):
            for keys, parts in block:
                ids = list(known.ids_of(parts))
                decoded = [decode_ids(i, ranks) for i in ids]
                columns = {
                    id_column: keys,
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
                }
                if with_ids:
                    columns |= {"ids": ids, "decoded": decoded}
                yield columns

    return map_batches(chosen, rows, T.StructType(fields))
