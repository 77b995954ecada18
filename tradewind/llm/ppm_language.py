"""Language of a text by prediction by partial matching.

Every language has a context tree over the bytes of a sample of its texts: counts of the
byte after each context of up to ``ORDER`` bytes. A byte is coded in its longest known
context; if it has not been seen there, an escape is coded and the context is shortened,
down to equal chances for all bytes (escape estimate C, without exclusions). The counts are
frozen after training, so a text's code length is a sum of costs that depend on the last
bytes only, and the costs of all contexts are tabulated once. The language with the
shortest code is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import held_out, map_batches, sample_by_hash, written

ORDER = 3
SAMPLE_TEXTS = 300  # of each language; those with the least hash of their text
SAMPLE_CHARS = 20_000  # of a longer text its first so many characters are trained on
CHUNK_BYTES = 1 << 20
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
START = b"\n" * ORDER  # the context of a text's first byte

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class Model:
    """Cost in bits of every byte class after every context, by language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        seen = np.unique(np.frombuffer(START + b"".join(t for x in samples.values() for t in x), np.uint8))
        self.size = len(seen) + 1  # class 0: bytes no sample has
        self.class_of = np.zeros(256, np.int64)
        self.class_of[seen] = np.arange(1, self.size)
        chains = [self.class_of[np.frombuffer(b"".join(START + t for t in samples[x]), np.uint8)] for x in self.languages]
        uses = [
            np.concatenate([np.arange(ORDER + len(t)) >= ORDER for t in samples[x]]) if samples[x] else np.empty(0, bool)
            for x in self.languages
        ]
        costs = np.full((1, self.size, len(self.languages)), 8.0, np.float32)  # below order 0: one of 256 bytes
        rows = np.zeros(1, np.int64)  # context of the present order to its row or that of its longest known ending
        for order in range(ORDER + 1):
            found = []
            for chain, use in zip(chains, uses, strict=True):
                at = np.flatnonzero(use)
                context = np.zeros(len(at), np.int64)
                for k in range(order, 0, -1):
                    context = context * self.size + chain[at - k]
                found.append(np.unique(context * self.size + chain[at], return_counts=True))
            known = np.unique(np.concatenate([keys // self.size for keys, _ in found]))
            endings = known % max(self.size ** (order - 1), 1) if order else np.zeros(len(known), np.int64)
            own = costs[rows[endings]].copy()
            for language, (keys, counts) in enumerate(found):
                context, symbol = np.searchsorted(known, keys // self.size), keys % self.size
                total = np.bincount(context, counts, len(known))
                distinct = np.bincount(context, minlength=len(known))
                here = total > 0
                escape = np.zeros(len(known), np.float32)
                escape[here] = np.log2((total[here] + distinct[here]) / distinct[here])
                own[:, :, language] += escape[:, None]
                own[context, symbol, language] = np.log2((total + distinct)[context] / counts)
            row = np.arange(len(known)) + len(costs)
            wider = np.tile(rows, self.size) if order > 1 else np.full(self.size**order, rows[0], np.int64)
            wider[known] = row
            costs, rows = np.concatenate([costs, own]), wider
        self.rows = rows.astype(np.int32)
        self.costs = costs.reshape(-1, len(self.languages))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text under every language, in bits."""
        full = np.array([bool(t) for t in texts], bool)
        found = np.zeros((len(texts), len(self.languages)))
        texts = [t for t in texts if t]
        if not texts:
            return found
        chain = self.class_of[np.frombuffer(b"".join(START + t for t in texts), np.uint8)]
        row = np.zeros(len(chain) - ORDER, np.int64)
        for k in range(ORDER):
            row = row * self.size + chain[k : len(row) + k]
        cost = self.costs.take(self.rows[row] * np.int64(self.size) + chain[ORDER:], axis=0)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        # The positions of a start are no bytes of a text; the first one lies before the array.
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(cost, np.stack([starts, ends - ORDER], axis=1).ravel()[:-1], axis=0, dtype=np.float64)
        found[full] = sums[::2]
        return found


def training_texts(docs: DataFrame) -> dict[str, list[bytes]]:
    """Samples of every language from rows that are not held out; at most ``SAMPLE_TEXTS`` texts each."""
    learnable = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    texts = learnable.select("lang", F.xxhash64("text").alias("hash"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    chosen = sample_by_hash(written(texts.select("lang", "hash").distinct(), "languages"), "lang", SAMPLE_TEXTS)
    sample = (
        texts.join(F.broadcast(chosen), ["lang", "hash"])  # SAMPLE_TEXTS for each language
        .groupBy("lang", "place")
        .agg(F.first("text").alias("text"))
    )
    found: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "place").collect():  # SAMPLE_TEXTS of SAMPLE_CHARS for each language
        found.setdefault(row.lang, []).append(row.text.encode())
    return found


def chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of texts, about ``CHUNK_BYTES`` of them at a time."""
    numbers, size = [], 0
    for k, text in enumerate(texts):
        numbers.append(k)
        size += len(text or "")
        if size >= CHUNK_BYTES:
            yield numbers
            numbers, size = [], 0
    if numbers:
        yield numbers


def language_of(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Predicted languages and their share of all languages' probability."""
    languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return languages, scores
    for numbers in chunks(texts):
        numbers = [k for k in numbers if LETTER.search(texts[k] or "")]
        lengths = model.lengths([texts[k].encode() for k in numbers])
        if not numbers:
            continue
        best = lengths.argmin(axis=1)
        least = lengths[np.arange(len(numbers)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
        for k, language, score in zip(numbers, best.tolist(), share.tolist(), strict=True):
            languages[k], scores[k] = model.languages[language], score
    return languages, scores


def predict_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, ``held_out``, ``lang_pred`` and ``score`` of every row.

    Without a ``model`` one is trained on rows of ``docs`` (doc_id, text, lang) that are not
    held out; lang, source and doc_id are no inputs of a prediction. Null texts and texts
    without a letter are ``und`` with a score of 0, so is every text where no language could
    be learned; equal code lengths go to the first language by name. Null ids stay and are
    not held out, repeated rows stay, an empty table gives an empty result.

    Training gathers at most ``SAMPLE_TEXTS`` texts of ``SAMPLE_CHARS`` of each language on
    the driver; the tables sent to the tasks are bounded by that sample and grow with the
    number of languages. No language is left out for being rare or having long texts only.
    """
    if model is None:
        samples = training_texts(docs)
        model = Model(samples) if samples else None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            languages, scores = language_of(sent.value, batch.column("text").to_pylist())
            yield {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "lang_pred": languages,
                "score": scores,
            }

    return map_batches(chosen, rows, RESULT)
