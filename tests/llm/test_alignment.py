"""Token alignment against whole-text encoding and a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tradewind.llm import alignment
from tradewind.llm.common import table
from tradewind.llm.queries import queries

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))

AWKWARD = [
    "", None, " ", "  ", "a", "a ", " a", "a  b", "a   b", "a \n b", "a\n  b\t c", "\n\n", "x y 　z", "don't we'll",
    "<|endoftext|> <s> </s> <unk>", "naïve Ünïcödé straße", "日本語 のテキスト", "🙂🙂 emoji 👩‍👩‍👧", "a▁b", "▁", "tab\x1c x",
    "a  \n b", "x\u00a0 y", "▁ b", "two \u2003 kinds \u2003z",
    "0x41 12345 6.7e-8", "mixed   runs    of     blanks ", "zero\x00byte y", "x" * 3000, "ab " * 5000, "é" * 500 + " " * 40 + "z",
]


def plain_tokens(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = alignment.byte_alphabet()
    result = []
    for text in texts:
        if not text:
            result.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in ((k, b.id_to_piece(k)) for k in ids_b)
        ]
        want = (" " + text).encode()
        same = b"".join(bytes_a) == want and b"".join(bytes_b) == want
        result.append((ids_a, ids_b, bytes_a, bytes_b) if same else None)
    return result


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest, groups) of every text."""
    rows, links = [], []
    for found in plain_tokens(texts):
        if found is None:
            rows.append((0, 0, 0, "", []))
            links.append([])
            continue
        ids_a, ids_b, bytes_a, bytes_b = found
        i = j = at_a = at_b = 0
        groups, own, linked = [], ([], []), []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                at_a += len(bytes_a[i])
                own[0].append(ids_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                own[1].append(ids_b[j])
                j += 1
            if at_a == at_b:
                groups.append(own)
                linked.append((own[0][-1], own[1][-1]))
                own = ([], [])
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(text.encode()).hexdigest(), groups))
        links.append(linked)
    counts = Counter(pair for own in links for pair in own)
    most = Counter()
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    return [
        (n_a, n_b, n, len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), digest, groups)
        for (n_a, n_b, n, digest, groups), own in zip(rows, links)
    ]


def test_query_equals_a_plain_walk(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").collect()
    want = {d.doc_id: row[:7] for d, row in zip(docs, plain([d.text for d in docs]))}
    found = queries()["op11_token_alignment"](spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == want


@pytest.mark.parametrize("frequent", [1, 50_000])
def test_awkward_texts_repeats_and_clashing_columns(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    texts = AWKWARD + ["a b", "a b"]
    rows = [(None if k == 3 else k // 2, t, "p", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, place int")
    found = alignment.align_tokens(df, A, B).collect()
    got = Counter((r.doc_id, *r[1:8], str([(g.a, g.b) for g in r.groups])) for r in found)
    want = Counter((row[0], *own[:7], str([(x, y) for x, y in own[7]])) for row, own in zip(rows, plain(texts)))
    assert got == want
    assert alignment.align_tokens(df.limit(0), A, B).count() == 0


def test_blocks_and_pieces_of_any_size_agree(monkeypatch):
    stretches = alignment.stretches_for(A, B)
    texts = [t for t in AWKWARD if t] + ["one two  three\n\nfour " * 50]
    whole = [(t.n_a, t.n_b, t.n_groups, t.digest.hexdigest(), t.valid) for t in alignment.aligned(texts, stretches, False)]
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 7)
    monkeypatch.setattr(alignment, "STRETCHES_KEPT", 3)
    small = alignment.aligned(texts, alignment.Stretches(*stretches.sides), False)
    assert [(t.n_a, t.n_b, t.n_groups, t.digest.hexdigest(), t.valid) for t in small if t.valid] == [w for w in whole if w[4]]
    assert [t.valid for t in small] == [w[4] for w in whole]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_stitch_to_the_whole_merge(piece):
    rng = np.random.default_rng(piece)
    for _ in range(60):
        a = np.unique(rng.integers(1, 60, rng.integers(0, 40)))
        b = np.unique(rng.integers(1, 60, rng.integers(0, 40)))
        cut_a, cut_b = alignment.diagonal_cuts(a, b, piece)
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        for k, (i, j) in enumerate(zip(cut_a, cut_b)):
            before = merged[: min(k * piece, len(merged))] if k < len(cut_a) - 1 else merged
            assert (i, j) == (sum(s == 0 for _, s in before), sum(s == 1 for _, s in before))
        at_a, at_b, overlaps = alignment.shared_ends(a, b, piece)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a) & set(b))
        assert overlaps == len(set(a) | set(b))
