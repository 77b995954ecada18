"""Personal data in texts: fixed forms, and a semi-Markov conditional random field for the rest.

The field scores whole candidate segments, not single tokens: how many figures in which
groups, which signs between them, whether check digits and octets hold, what stands next to
the segment. A dynamic program over a stretch of text chooses boundaries and kinds together;
segments are bounded by ``MAX_TOKENS``. It is trained by maximum likelihood on texts whose
labels are the fixed forms, together with copies in which these are rewritten as people
disguise them (labelled too) or spoiled (not labelled). Its segments are added where no
fixed form lies.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import map_batches, spans_text

KINDS = ("email", "ip", "card", "phone")

SAMPLE_TEXTS = 1500  # for training: those with the least hash of their text
SAMPLE_CHARS = 20_000  # longer texts are not trained on
SAMPLE_STRETCHES = 800  # of the sample, besides rewritten ones
MAX_TOKENS = 24
EPOCHS = 12
RATE = 0.1
PENALTY = 1e-3

Span = tuple[str, int, int]

# The fixed forms. A match of one cannot begin inside a run of its first class, so those are
# anchored there: each has the leftmost non-overlapping matches of the plain pattern.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
FIGURES = re.compile(r"[0-9+][\x20().0-9+-]*")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    at, taken = text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            taken = match.end()
            yield "email", start, taken
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms; matches that fail their test are dropped."""
    found = list(emails(text))
    for run in FIGURES.finditer(text):
        at, part = run.start(), run[0]
        if len(part) < 7:
            continue
        for m in IP.finditer(part):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", at + m.start(), at + m.end()))
        for m in CARD.finditer(part):
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at + m.start(), at + m.end()))
        for m in PHONE.finditer(part):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", at + m.start(), at + m.end()))
    return found


# The field.

DISGUISED = r"[\[({<]\x20?(?:at|dot|AT|DOT|punkt|arroba|punto|point)\x20?[\])}>]"
TRIGGER = re.compile(rf"[0-9]{{2}}|@|{DISGUISED}|[\[(]\.[\])]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
SIGN_AT = rf"(?:@|\x20?[\[({{<]\x20?(?:at|AT|arroba)\x20?[\])}}>]\x20?)"
SIGN_DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|punkt|punto|point|\.)\x20?[\])}>]\x20?)"
CANDIDATES = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{SIGN_AT}[A-Za-z0-9-]+(?:{SIGN_DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{SIGN_DOT}[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9]){12,18}"),
    "phone": re.compile(r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}"),
}
CUES = {
    "email": {"mail", "email", "e", "contact", "correo", "kontakt"},
    "ip": {"ip", "host", "address", "server", "adresse"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"},
}
Segment = tuple[int, int, str, tuple[str, ...]]  # first token, token after the last, kind, features


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where a segment may lie: words with a trigger and one word on each side, joined where they meet."""
    open_at = end_at = None
    for match in TRIGGER.finditer(text):
        if end_at is not None and match.start() < end_at:
            continue
        start = word_back(text, word_back(text, match.start(), 0) - 1, 0)
        end = word_on(text, word_on(text, match.end()) + 1)
        if end_at is not None and start <= end_at:
            end_at = max(end_at, end)
        else:
            if end_at is not None:
                yield open_at, end_at
            open_at, end_at = start, end
    if end_at is not None:
        yield open_at, end_at


def word_back(text: str, at: int, least: int) -> int:
    """The start of the word that ends at ``at`` or holds it."""
    at = max(at, least)
    while at > least and not text[at - 1].isspace():
        at -= 1
    return at


def word_on(text: str, at: int) -> int:
    """The end of the word that begins at ``at`` or holds it."""
    at = min(at, len(text))
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def features(text: str, start: int, end: int, kind: str, cue: str) -> tuple[str, ...]:
    """What is known of a whole segment."""
    part = text[start:end]
    digits = digits_of(part)
    groups = re.findall(r"[0-9]+", part)
    before, after = text[start - 1 : start], text[end : end + 1]
    found = [
        "bias",
        f"first={part[0] if not part[0].isalnum() else 'x'}",
        f"cut={before.isalnum() or before in ('@', '_')}{after.isalnum() or after in ('@', '_')}",
        f"joined={before in ('.', '-', '/', '+') and before != ''}{after in ('-', '/') and after != ''}",
        f"cue={cue}",
    ]
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", part)[-1]
        found += [f"plain={'@' in part}", f"ending={ending.isalpha() and 2 <= len(ending) <= 6}"]
    else:
        found += [
            f"n={min(len(digits), 20)}",
            f"signs={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', part))))}",
            f"groups={'-'.join(str(min(len(g), 9)) for g in groups[:6])}",
            f"luhn={luhn(digits)}" if kind == "card" else f"octets={all(int(g) <= 255 for g in groups)}",
            f"zero={digits[0] == '0'}",
        ]
    return tuple(f"{kind}:{name}" for name in found)


def segments(text: str, start: int, end: int) -> tuple[list[int], list[Segment]]:
    """Token starts of a stretch (and its end), and all candidate segments, by their last token."""
    edges = [m.start() for m in TOKEN.finditer(text, start, end)] + [end]
    found: list[Segment] = []
    cues = {w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, start - 24) : end])}
    for i in range(len(edges) - 1):
        c = text[edges[i]]
        if not (c.isascii() and c.isalnum() or c in "+("):
            continue
        for kind, form in CANDIDATES.items():
            if kind != "email" and not (c.isdigit() or kind == "phone"):
                continue
            # No further than a segment may reach: text without a break costs no more than words do.
            last = min(i + MAX_TOKENS, len(edges) - 1)
            longest = form.match(text, edges[i], edges[last])
            if not longest:
                continue
            for j in range(i + 1, last + 1):
                if edges[j] > longest.end():
                    break
                if form.fullmatch(text, edges[i], edges[j]):
                    names = features(text, edges[i], edges[j], kind, str(bool(cues & CUES[kind])))
                    found.append((i, j, kind, names))
    found.sort(key=lambda s: (s[1], s[0], KINDS.index(s[2])))
    return edges, found


class Field:
    """Weights of features; a segmentation's score is the sum over its segments, text outside has none."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, names: tuple[str, ...]) -> float:
        return sum(self.weights.get(name, 0.0) for name in names)

    def best(self, text: str, start: int, end: int) -> list[Span]:
        """The segmentation of highest score; ties go to fewer segments."""
        edges, found = segments(text, start, end)
        if not found:
            return []
        best: list[tuple[float, Segment | None]] = [(0.0, None)]
        at = 0
        for j in range(1, len(edges)):
            value: tuple[float, Segment | None] = (best[j - 1][0], None)
            while at < len(found) and found[at][1] == j:
                total = best[found[at][0]][0] + self.score(found[at][3])
                if total > value[0] + 1e-9:
                    value = (total, found[at])
                at += 1
            best.append(value)
        spans, j = [], len(edges) - 1
        while j > 0:
            segment = best[j][1]
            if segment is None:
                j -= 1
            else:
                spans.append((segment[2], edges[segment[0]], edges[segment[1]]))
                j = segment[0]
        return spans


def expectations(n: int, found: list[Segment], scores: list[float]) -> list[float]:
    """The chance of every segment over all segmentations of n tokens, by forward and backward sums."""
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    ends, starts = defaultdict(list), defaultdict(list)
    for k, (i, j, _, _) in enumerate(found):
        ends[j].append((i, scores[k]))
        starts[i].append((j, scores[k]))
    for j in range(1, n + 1):
        ahead[j] = log_sum([ahead[j - 1], *(ahead[i] + s for i, s in ends[j])])
    for i in range(n - 1, -1, -1):
        back[i] = log_sum([back[i + 1], *(back[j] + s for j, s in starts[i])])
    return [math.exp(ahead[i] + s + back[j] - ahead[n]) for (i, j, _, _), s in zip(found, scores, strict=True)]


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def rewritten(text: str, span: Span, chance: random.Random) -> tuple[str, bool]:
    """Another way to write a span, and whether it still is what it was."""
    kind, start, end = span
    part = text[start:end]
    digits = digits_of(part)
    spoiled = chance.random() < 0.3
    if kind == "email":
        if spoiled:
            return part.replace("@", " "), False
        sign, dot = chance.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", ".")])
        return part.replace("@", sign).replace(".", dot) if dot != "." else part.replace("@", sign), True
    if kind == "ip":
        if spoiled:
            return ".".join(str(int(p) + 256) for p in part.split(".")), False
        return part.replace(".", chance.choice(["[.]", "(.)", "[dot]"])), True
    if kind == "card":
        if spoiled:
            wrong = digits[:-1] + str((int(digits[-1]) + chance.randint(1, 9)) % 10)
            return wrong, False
        return chance.choice([" ", "-", "."]).join(digits[k : k + 4] for k in range(0, len(digits), 4)), True
    local = digits[-10:]
    if spoiled:
        return chance.choice([local[:5], f"{local[:4]}-{local[4:6]}-{local[6:8]}", f"{local[:2]}.{local[2:5]}", local]), False
    a, b, c = local[:3], local[3:6], local[6:]
    return chance.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1-{a}-{b}-{c}"]), True


def examples(texts: list[str]) -> list[tuple[int, list[Segment], list[bool]]]:
    """Stretches with their segments and which of these are labelled; first as they stand, then rewritten."""
    chance = random.Random(0)
    found: list[tuple[int, list[Segment], list[bool]]] = []

    def add(text: str, start: int, end: int, spans: list[Span]) -> None:
        edges, own = segments(text, start, end)
        if own:
            labelled = {(edges[i], edges[j], kind) for i, j, kind, _ in own} & {(a, b, kind) for kind, a, b in spans}
            found.append((len(edges) - 1, own, [(edges[i], edges[j], kind) in labelled for i, j, kind, _ in own]))

    for text in texts:
        spans = base_spans(text)
        for start, end in stretches(text):
            if len(found) >= 2 * SAMPLE_STRETCHES:
                return found
            if end - start > 400:
                continue
            inside = [s for s in spans if start <= s[1] and s[2] <= end]
            add(text, start, end, inside)
            for span in inside:
                other, holds = rewritten(text, span, chance)
                head, tail = text[max(0, start - 24) : span[1]], text[span[2] : end + 24]
                changed = head + other + tail
                own = base_spans(changed) + [(span[0], len(head), len(head) + len(other))] * holds
                for a, b in stretches(changed):
                    add(changed, a, b, own)
    return found


def train(texts: list[str]) -> Field:
    """Maximum likelihood by stochastic gradients with decaying steps, in a fixed order."""
    cases = examples(texts)
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(float)
    for _ in range(EPOCHS):
        for n, found, labelled in cases:
            scores = [sum(weights[name] for name in s[3]) for s in found]
            change: dict[str, float] = defaultdict(float)
            for segment, label, chance in zip(found, labelled, expectations(n, found, scores), strict=True):
                for name in segment[3]:
                    change[name] += label - chance
            for name, value in change.items():
                value -= PENALTY * weights[name]
                squares[name] += value * value
                weights[name] += RATE * 5 * value / (1 + math.sqrt(squares[name]))
    return Field(dict(weights))


def training_texts(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE_TEXTS`` texts with something to learn from, chosen by their hash."""
    chosen = docs.select("text").where(F.length("text") <= SAMPLE_CHARS).where(F.col("text").rlike("[0-9]{2}|@"))
    # The hashes alone first: each task sends as many rows as are wanted, and texts are wide.
    hashes = chosen.select(F.xxhash64("text").alias("h")).orderBy("h").limit(SAMPLE_TEXTS)
    last = hashes.agg(F.max("h")).first()[0]
    if last is None:
        return []
    rows = chosen.where(F.xxhash64("text") <= last).distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE_TEXTS)
    return [row.text for row in rows.collect()]


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_added", T.LongType()),
    ]
)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed forms, and those that the field adds outside them."""
    base = base_spans(text)
    added = [
        span
        for start, end in stretches(text)
        for span in field.best(text, start, end)
        if not any(a < span[2] and span[1] < b for _, a, b in base)
    ]
    return base, added


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and spans of personal data in every text of ``docs`` (doc_id, text).

    ``n_`` columns count the fixed forms; ``spans`` holds kind:start:end in code points by
    start, then kind, with the ``n_added`` spans of the field; ``base_sha256`` is the hash of
    the list without these. Without a ``field`` one is trained on a bounded sample of
    ``docs``; where that has no fixed form, nothing is added. Null and empty texts have no
    spans, null ids and repeated rows stay, other columns are ignored, an empty table gives
    an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or train(training_texts(docs)))
    chosen = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in RESULT.names[1:]}
            for value in batch.column("text"):
                base, added = all_spans(value.as_py() or "", sent.value)
                kinds = [kind for kind, *_ in base]
                for kind in KINDS:
                    columns[f"n_{kind}"].append(kinds.count(kind))
                columns["base_sha256"].append(hashlib.sha256(spans_text(base, KINDS).encode()).hexdigest())
                columns["spans"].append(spans_text(base + added, KINDS))
                columns["n_added"].append(len(added))
            yield {"doc_id": batch.column("doc_id"), **columns}

    return map_batches(chosen, rows, RESULT)
