"""Toxicity of texts by a logistic classifier with a counterfactual penalty.

The classifier sees which words of a learned vocabulary a text has, and how many different
words with each of a learned set of beginnings, so that new forms of a stem count. Besides the likelihood
of the labels it is fitted to give sentences the same score when an identity term in them
is swapped for another of its group: the squared change of the score is penalised, so that
mentioning a group is no sign of toxicity by itself. Few weights stay, as their sum is
penalised too, and the sum of their squares keeps single ones small.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import held_out, map_batches, sample_by_hash, written

SAMPLE_TEXTS = 1000  # distinct ones of each label; those with the least hash
SAMPLE_CHARS = 20_000  # longer texts are not trained on
VOCABULARY = 1500  # words and beginnings that tell the labels apart best, besides the identity terms
STEMS = (5, 7)  # lengths of beginnings
MIN_TEXTS = 4  # texts of the sample that have a word, at least
COUNTERFACTUAL = 10.0  # weight of the squared score change of a swap, against the mean log loss
SPARSITY = 0.0005  # weight of the sum of absolute weights
SHRINKAGE = 0.0005  # weight of the sum of squared weights: words that tell the same share what they tell
STEPS = 400
THRESHOLD = 0.3

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Terms by which groups of people are named, by what they have in common.
IDENTITY_TERMS = {
    "gender": "woman women man men female male girl girls boy boys frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres transgender",
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics protestant protestants",
    "origin": "black white asian african european american arab latino mexican chinese indian turkish polish immigrant immigrants refugee refugees",
    "orientation": "gay lesbian bisexual straight homosexual heterosexual queer",
    "ability": "disabled blind deaf autistic old young elderly",
}
GROUPS = [terms.split() for terms in IDENTITY_TERMS.values()]

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ]
)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(words: set[str]) -> dict[str, float]:
    """1 for each word, and log2(1 + n) for each beginning (marked by ^) of n different words."""
    found = dict.fromkeys(words, 1.0)
    for length in STEMS:
        for stem, n in Counter([w[:length] for w in words if len(w) >= length]).items():
            found["^" + stem] = math.log2(1 + n)
    return found


class Model:
    """Weights of words and a bias; a text's score is the chance of label 1."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.stems = {n: {name[1:] for name in weights if name[0] == "^" and len(name) == n + 1} for n in STEMS}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        own = dict.fromkeys(words & self.weights.keys(), 1.0)
        for length, stems in self.stems.items():
            for stem, n in Counter(filter(stems.__contains__, [w[:length] for w in words])).items():
                own["^" + stem] = math.log2(1 + n)
        # Sorted, as a sum of floats depends on its order.
        total = self.bias + sum(self.weights[name] * own[name] for name in sorted(own))
        return 1 / (1 + math.exp(-max(min(total, 500.0), -500.0)))


def swaps(sentences: list[set[str]], place: dict[str, int]) -> np.ndarray:
    """Mean over all swaps, of an identity term of a sentence for any other of its group, of the
    outer product of the change of the features: what squares the change of a score."""
    total, n = np.zeros((len(place), len(place)), np.float32), 0
    for words in sentences:
        before = features(words)
        for group in GROUPS:
            for term in words.intersection(group):
                for other in group:
                    if other == term:
                        continue
                    after = features(words - {term} | {other})
                    names = [w for w in before.keys() | after.keys() if before.get(w) != after.get(w) and w in place]
                    change = np.array([after.get(w, 0.0) - before.get(w, 0.0) for w in names], np.float32)
                    at = [place[w] for w in names]
                    total[np.ix_(at, at)] += np.outer(change, change)
                    n += 1
    return total / max(n, 1)


def fit(texts: list[str], labels: list[int], positive_share: float) -> Model:
    """Proximal gradient descent on texts of both labels; ``positive_share`` is that of all labelled rows."""
    bags = [features(words_of(t)) for t in texts]
    y = np.array(labels, np.float32)
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    ones = Counter(w for bag, label in zip(bags, labels, strict=True) if label for w in bag)
    zeros = Counter(w for bag, label in zip(bags, labels, strict=True) if not label for w in bag)

    def tells(word: str) -> float:
        a, b = ones[word] / n1, zeros[word] / n0
        pooled = (ones[word] + zeros[word]) / (n1 + n0)
        return abs(a - b) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-9)

    common = sorted(w for w in ones.keys() | zeros.keys() if ones[w] + zeros[w] >= MIN_TEXTS)
    chosen = sorted(common, key=lambda w: (-tells(w), w))[:VOCABULARY]
    names = sorted({*chosen, *features({term for group in GROUPS for term in group})})
    place = {w: k for k, w in enumerate(names)}
    x = np.zeros((len(bags), len(names)), np.float32)
    for row, bag in enumerate(bags):
        for name, value in bag.items():
            if name in place:
                x[row, place[name]] = value
    sentences = [
        words
        for text in texts
        for words in map(words_of, SENTENCE.findall(text))
        if any(term in words for group in GROUPS for term in group)
    ]
    change = swaps(sentences, place)
    # Both labels count alike while fitting; the bias is moved to their true share afterwards.
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    w, bias = np.zeros(len(names), np.float32), 0.0
    ahead, ahead_bias = w.copy(), 0.0
    scale = 0.25 * float(np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2) + 0.25 + SHRINKAGE
    scale += COUNTERFACTUAL * float(np.linalg.norm(change, 2))
    for step in range(STEPS):
        error = share * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -50, 50))) - y)
        gradient = x.T @ error + SHRINKAGE * ahead
        gradient += COUNTERFACTUAL * (change @ ahead)
        moved = ahead - gradient / scale
        moved = np.sign(moved) * np.maximum(np.abs(moved) - SPARSITY / scale, 0)
        moved_bias = ahead_bias - float(error.sum()) / scale
        pace = step / (step + 3)
        ahead, ahead_bias = moved + pace * (moved - w), moved_bias + pace * (moved_bias - bias)
        w, bias = moved, moved_bias
    kept = min(max(positive_share, 1e-3), 1 - 1e-3)
    bias += math.log(kept / (1 - kept))
    return Model({name: round(float(w[k]), 6) for name, k in place.items() if w[k]}, round(bias, 6))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that are not held out; the bias alone where a label is missing."""
    learnable = (
        labels.where("toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # Texts are found by their hashes: only ids and hashes are shuffled, then the few chosen texts are read.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).where(~held_out(F.col("doc_id")))
    texts = texts.where(F.length("text") <= SAMPLE_CHARS)
    labelled = texts.select("doc_id", "hash").join(learnable, "doc_id")
    found = written(labelled.groupBy("toxic", "hash").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id")), "labelled")
    counts = {r.toxic: r["rows"] for r in found.groupBy("toxic").agg(F.sum("rows").alias("rows")).collect()}
    chosen = sample_by_hash(found, "toxic", SAMPLE_TEXTS).join(found, ["toxic", "hash"])
    sample = (
        texts.join(F.broadcast(chosen), ["doc_id", "hash"])  # SAMPLE_TEXTS for each of two labels
        .groupBy("toxic", "place")
        .agg(F.first("text").alias("text"))
    )
    rows = sample.orderBy("toxic", "place").collect()  # SAMPLE_TEXTS of SAMPLE_CHARS for each label
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len({r.toxic for r in rows}) < 2:
        return Model({}, -math.log(99) if share < 0.5 else math.log(99))
    return fit([r.text for r in rows], [r.toxic for r in rows], share)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row of ``docs``.

    Without a ``model`` one is trained on ``labels`` (doc_id, toxic) joined to ``docs``
    (doc_id, text), held-out rows left out; only the text is an input of a score. Null and
    empty texts have the score of a text without known words; labels other than 0 and 1 and
    rows without a text are not learned from; an id labelled both ways counts as toxic. Null
    ids stay, repeated rows stay, empty tables are allowed, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            scores = [sent.value.score(t.as_py()) for t in batch.column("text")]
            yield {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": scores,
                "predicted": [int(s >= THRESHOLD) for s in scores],
            }

    return map_batches(chosen, rows, RESULT)
