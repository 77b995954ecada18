"""Secrets in texts: known forms, and random strings by their token efficiency.

A byte-pair vocabulary spends few tokens on words and many on random strings, so strings
with few characters per token are reported, once digests and identifiers, which look as
random but are no secrets, are set aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import map_batches, spans_text

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the whole run, as a run of 16 begins at its first character
MIN_VALUE, MIN_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MAX_CHARS_PER_TOKEN = 2.0
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # of hexadecimal digests in common use
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
MAX_FIGURES = 4  # of a name
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # parts of names: runs of letters up to signs, figures and capitals


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known forms, leftmost and non-overlapping within each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def efficient(value: str, encoding: tiktoken.Encoding) -> bool:
    return len(value) >= MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(value))


def is_name(value: str, encoding: tiktoken.Encoding) -> bool:
    """Words by their token efficiency, joined by signs or capitals, with few figures.

    Most letters are in words of three letters or more: pairs of letters are often tokens.
    """
    if sum(c.isdigit() for c in value) > MAX_FIGURES:
        return False
    parts = PART.findall(value)
    if 2 * sum(len(part) for part in parts if len(part) >= 3) <= sum(map(len, parts)):
        return False
    return all(efficient(part.lower(), encoding) for part in parts)


def is_known(value: str, encoding: tiktoken.Encoding) -> bool:
    """Digests of common lengths, unique identifiers and names."""
    return bool(
        (len(value) in DIGEST_LENGTHS and DIGEST.fullmatch(value))
        or UUID.fullmatch(value)
        or is_name(value, encoding)
    )


def random_spans(text: str, encoding: tiktoken.Encoding, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings of low token efficiency outside the spans already taken."""
    found = []
    for match in CANDIDATE.finditer(text):
        value = match[0]
        start, end = match.span()
        if any(a < end and start < b for _, a, b in taken):
            continue
        if not efficient(value, encoding) and not is_known(value, encoding):
            found.append(("random", start, end))
    return found


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS[:3]],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_random", T.LongType()),
    ]
)


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts and spans of secrets in every text of ``docs`` (doc_id, text).

    ``spans`` holds kind:start:end in code points, by start, then kind; ``base_sha256`` is
    the hash of that list without the random strings. Null and empty texts have no spans,
    null ids and repeated rows stay, other columns are ignored, an empty table gives an
    empty result. ``ranks_path`` must be readable on every executor.
    """
    chosen = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in RESULT.names[1:]}
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, encoding, base)
                kinds = [kind for kind, *_ in base]
                for kind in KINDS[:3]:
                    columns[f"n_{kind}"].append(kinds.count(kind))
                columns["base_sha256"].append(hashlib.sha256(spans_text(base, KINDS).encode()).hexdigest())
                columns["spans"].append(spans_text(base + more, KINDS))
                columns["n_random"].append(len(more))
            yield {"doc_id": batch.column("doc_id"), **columns}

    return map_batches(chosen, rows, RESULT)
