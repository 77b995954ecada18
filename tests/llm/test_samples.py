"""Training samples, and the toxicity fit against its objective written out."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tradewind.llm import toxicity
from tradewind.llm.common import sample_by_hash, table
from tradewind.llm.queries import queries


def test_sample_is_the_least_hashes_of_every_label(spark):
    rows = [(k % 3 if k % 50 else 7, random.Random(k).getrandbits(64) - (1 << 63)) for k in range(20_000)]
    found = sample_by_hash(spark.createDataFrame(rows, "label int, hash long"), "label", 40).collect()
    for label in (0, 1, 2, 7):
        want = sorted(h for own, h in rows if own == label)[:40]
        assert [r.hash for r in sorted(found, key=lambda r: r.place) if r.label == label] == want
    assert sample_by_hash(spark.createDataFrame([], "label int, hash long"), "label", 5).count() == 0


def test_swap_matrix_is_the_mean_squared_score_change():
    rng = np.random.default_rng(2)
    sentences = [toxicity.words_of(t) for t in ("the old woman sings", "a muslim and a christian man", "black cats", "no term")]
    names = sorted({n for words in sentences for n in toxicity.features(words)} | {t for g in toxicity.GROUPS for t in g})
    place = {n: k for k, n in enumerate(names)}
    weights = rng.normal(size=len(names))

    def score(words):
        return sum(weights[place[n]] * v for n, v in toxicity.features(words).items() if n in place)

    changes = [
        (score(words - {term} | {other}) - score(words)) ** 2
        for words in sentences for group in toxicity.GROUPS for term in words & set(group) for other in group if other != term
    ]
    matrix = toxicity.swaps(sentences, place).astype(float)
    assert weights @ matrix @ weights == pytest.approx(np.mean(changes), rel=1e-4)


def objective(weights, bias, texts, labels):
    """Balanced log loss, swap penalty and both shrinkages, one text at a time."""
    total = 0.0
    for text, label in zip(texts, labels):
        own = toxicity.features(toxicity.words_of(text))
        z = bias + sum(weights.get(n, 0.0) * v for n, v in own.items())
        total += 0.5 / labels.count(label) * math.log1p(math.exp(-z if label else z))
    changes = []
    for text in texts:
        for words in map(toxicity.words_of, toxicity.SENTENCE.findall(text)):
            for group in toxicity.GROUPS:
                for term in words & set(group):
                    for other in set(group) - {term}:
                        a, b = toxicity.features(words), toxicity.features(words - {term} | {other})
                        changes.append(sum(weights.get(n, 0.0) * (b.get(n, 0.0) - a.get(n, 0.0)) for n in a.keys() | b.keys()) ** 2)
    penalty = toxicity.COUNTERFACTUAL / 2 * sum(changes) / max(len(changes), 1)
    return total + penalty + sum(toxicity.SPARSITY * abs(w) + toxicity.SHRINKAGE / 2 * w * w for w in weights.values())


def test_fit_is_at_the_least_of_its_objective():
    rng = random.Random(6)
    bad, good = ["scum", "idiot", "hate"], ["garden", "music", "train", "letter"]
    texts, labels = [], []
    for k in range(80):
        label = k % 2
        words = [rng.choice(bad if label and rng.random() < 0.5 else good) for _ in range(6)]
        words += [rng.choice(["woman", "muslim", "black"])] if rng.random() < (0.8 if label else 0.2) else []
        texts.append(" ".join(words) + ".")
        labels.append(label)
    model = toxicity.fit(texts, labels, 0.5)
    least = objective(model.weights, model.bias, texts, labels)
    names = sorted(model.weights) + ["woman", "scum", "garden", "^music"]
    for name in names:
        for step in (-0.05, 0.05):
            moved = model.weights | {name: model.weights.get(name, 0.0) + step}
            assert objective(moved, model.bias, texts, labels) > least - 1e-4, name
    assert objective(model.weights, model.bias + 0.05, texts, labels) > least - 1e-4
    plain = objective({}, 0.0, texts, labels)
    assert least < plain - 0.1


def test_toxicity_query_scores_as_written_out(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries()["op8_toxicity"](spark, folder).collect():
        own = toxicity.features(toxicity.words_of(texts[r.doc_id]))
        z = model.bias + sum(w * own.get(n, 0.0) for n, w in model.weights.items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.3)


def test_token_files_take_special_strings_as_the_library_does(spark, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from tradewind.llm import token_files
    from tradewind.llm.queries import WORD_VOCABULARY

    path = public_tokenizers.path(WORD_VOCABULARY)
    texts = [
        "<|endoftext|>", "a<|endoftext|>b c", " <|startoftext|>  x ", "<|ENDOFTEXT|> <|endoftext", "x <|endoftext|><|endoftext|>\ny", "plain",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_token_files(docs, f"{tmp_path}/t", path)
    found = sorted(token_files.read_token_files(spark, f"{tmp_path}/t").collect())
    library = Tokenizer.from_file(path)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [r.n_tokens for r in found] == [len(i) for i in ids]
    assert [r.ids_crc32 for r in found] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]


def test_pieces_encode_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tradewind.llm import token_files
    from tradewind.llm.queries import WORD_VOCABULARY

    path = public_tokenizers.path(WORD_VOCABULARY)
    rng = random.Random(9)
    parts = ["Don't", "..'s", "x2y", "Straße", "ÀÉÎ", "…", "日本", "e\u0301", "\x1c", "\t", "\n", "  ", "½", "<|endoftext|>", "<|x", "'re'd", "\xa0z", "İ"]
    texts = ["".join(rng.choice([*parts, " ", "a", "B", "9"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    got = token_files.Words(path, "<u2").encode(texts)
    assert [t for t, g, w in zip(texts, got, want) if g != np.array(w.ids, "<u2").tobytes()] == []


def test_unbroken_texts_take_time_in_proportion():
    import time

    from tradewind.llm import pii_crf

    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    text = "".join(rng.choices(letters, k=1_000_000)) + " mail jane.doe [at] example [dot] org"
    began = time.process_time()
    spans = [segment for start, end in pii_crf.stretches(text) for segment in pii_crf.segments(text, start, end)[1]]
    field = pii_crf.Field({"email:bias": 1.0})
    found = [s for start, end in pii_crf.stretches(text) for s in field.best(text, start, end)]
    assert time.process_time() - began < 20 and spans
    assert [s for s in found if s[0] == "email" and s[1] >= 1_000_000]
    assert pii_crf.base_spans(text) == []


def test_new_pieces_are_encoded_in_few_calls(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tradewind.llm import token_files
    from tradewind.llm.queries import WORD_VOCABULARY

    path = public_tokenizers.path(WORD_VOCABULARY)
    texts = [" ".join(f"Word{i}\x1e\x1ex{i % 7}" if i % 3 else "" for i in range(k, k + 60)) + "\x1e" for k in range(0, 6000, 60)]
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    words, calls = token_files.Words(path, "<u2"), []
    encode = words.separated.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return encode(texts, **options)

    words.separated = Counted()
    assert words.encode(texts) == want and len(calls) == -(-len(words) // token_files.PIECES_AT_ONCE)
    # A separator that does not come back leaves the pieces to be encoded one by one.
    monkeypatch.setattr(token_files, "SEPARATOR", "|")
    assert token_files.Words(path, "<u2").encode(["a b", "a|b c|"]) == [
        np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(path).encode_batch(["a b", "a|b c|"], add_special_tokens=False)
    ]


def test_pairs_of_a_long_array_need_little_besides_their_ranks():
    import tracemalloc

    import public_tokenizers

    from tradewind.llm import bpe_replay
    from tradewind.llm.queries import BYTE_RANKS

    ranks = bpe_replay.ranks_of(public_tokenizers.path(BYTE_RANKS))
    symbols = ranks.of_byte[np.random.default_rng(3).integers(0, 256, 4_000_000)]
    few = np.concatenate([ranks.pairs(symbols[a : a + 9], symbols[a + 1 : a + 10]) for a in range(0, 9_000, 9)])
    tracemalloc.start()
    found = ranks.pairs(symbols[:-1], symbols[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found[:9_000] == few).all() and peak < 3 * found.nbytes


def test_lines_lose_white_space_at_their_very_ends_only(spark):
    from tradewind.llm import line_frequency

    lines = ["", " \t\x0b\x0c\r ", " a b\t", "a \u2028", "a \x85", "\xa0a ", None]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r[0] for r in df.select(line_frequency.trimmed(df.line)).collect()]
    assert got == [None if line is None else line.strip(" \t\n\x0b\x0c\r") for line in lines]
