"""City spelling keys, folded by Spark's own functions.

Folding a name is to trim it, lower it, decompose it (NFKD) and drop the combining marks.
But for the final sigma every character is folded by itself, so the whole of it is a table
from characters to their folded form, made from Python's Unicode data when it is first used:

* most characters fold to one character or to none (marks): ``translate``;
* Hangul syllables fall apart by arithmetic;
* a few letters expand to several (ligatures, fractions): looked up one by one, in the names that have any.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every BMP character that counts as blank at the ends of a name.
BLANKS = "".join(chr(code) for code in range(0x10000) if chr(code).isspace())
KEY_SEPARATOR = "|"

# Fixed values of the Unicode standard: first syllable, first letters and their numbers.
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)
SIGMA = "Σ"


def fold(name: str | None) -> str:
    """Trimmed, lower-case, accent-free form of one name; NULL becomes ''."""
    if not name:
        return ""
    decomposed = unicodedata.normalize("NFKD", name.strip().lower())
    return "".join(ch for ch in decomposed if unicodedata.combining(ch) == 0)


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to another one and those, in order, then the ones that are dropped; and the expanding ones."""
    one, none, more = {}, [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or HANGUL <= code < HANGUL + LEADS[1] * VOWELS[1] * TAILS[1]:
            continue
        if not (ch.islower() or ch.isupper() or ch.istitle()) and not unicodedata.decomposition(ch) and not unicodedata.combining(ch):
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c))
        if len(folded) == 1:
            if folded != ch:
                one[ch] = folded
        elif folded:
            more[ch] = folded
        else:
            none.append(ch)
    ascii_upper = [chr(code) for code in range(ord("A"), ord("Z") + 1)]
    one = {ch: ch.lower() for ch in ascii_upper} | one
    return "".join([*one, *none]), "".join(one.values()), more


def _letters(first: int, number: int) -> str:
    return "".join(chr(first + k) for k in range(number))


def _characters(text: Column, folded) -> Column:
    """Every character of a text replaced by ``folded`` of it."""
    return F.array_join(F.transform(F.split(text, ""), folded), "")


def _apart(syllable: Column) -> Column:
    """The letters of a Hangul syllable; the first tail stands for none."""
    place = F.ascii(syllable) - HANGUL
    lead = F.substring(F.lit(_letters(*LEADS)), (place / (VOWELS[1] * TAILS[1])).cast("int") + 1, F.lit(1))
    vowel = F.substring(F.lit(_letters(*VOWELS)), (place % (VOWELS[1] * TAILS[1]) / TAILS[1]).cast("int") + 1, F.lit(1))
    tail = F.when(
        place % TAILS[1] > 0, F.substring(F.lit(_letters(*TAILS)), place % TAILS[1] + 1, F.lit(1))
    ).otherwise("")
    return F.concat(lead, vowel, tail)


def normalize_city(city: Column) -> Column:
    """Trimmed, lower-case and without accents; NULL becomes ''. Equal to ``fold``, without leaving the JVM."""
    source, target, more = _tables()
    trimmed = F.btrim(city, F.lit(BLANKS))
    # The last sigma of a word has a form of its own.
    lowered = F.when(F.contains(trimmed, F.lit(SIGMA)), F.lower(trimmed)).otherwise(trimmed)
    last = chr(HANGUL + LEADS[1] * VOWELS[1] * TAILS[1] - 1)
    whole = F.when(
        lowered.rlike(f"[{chr(HANGUL)}-{last}]"),
        _characters(lowered, lambda c: F.when(c.between(chr(HANGUL), last), _apart(c)).otherwise(c)),
    ).otherwise(lowered)
    simple = F.translate(whole, source, target)
    # As a text of keys and a list of values: a map would be looked through for every character.
    keys, values = F.lit("".join(more)), F.split(F.lit("\n".join(more.values())), "\n")
    expanded = F.when(
        simple.rlike(f"[{''.join(more)}]"),
        _characters(
            simple,
            lambda c: F.when(F.position(c, keys) > 0, F.element_at(values, F.position(c, keys))).otherwise(c),
        ),
    ).otherwise(simple)
    ascii_only = trimmed.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(ascii_only, F.lower(trimmed)).otherwise(expanded), F.lit(""))


def normalize_state(state: Column) -> Column:
    """Lower-case and trimmed; accents stay. NULL becomes ''."""
    return F.coalesce(F.btrim(F.lower(state), F.lit(BLANKS)), F.lit(""))


def city_key(city: Column, state: Column) -> Column:
    """normalised city | state, the identity under which spellings merge."""
    return F.concat(normalize_city(city), F.lit(KEY_SEPARATOR), normalize_state(state))
