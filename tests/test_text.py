"""Folding by Spark's functions against Python's Unicode data."""

import random
import sys

from pyspark.sql import functions as F
from test_plans import plan

from tradewind.functions.text import BLANKS, fold, normalize_city


def folded(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", normalize_city(F.col("name")).alias("folded"))
    return df


def test_every_character_folds_as_in_python(spark):
    names = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or 0x2F000 <= c < 0x30000)]
    names = [f"a{ch}b" for ch in names]
    wrong = [(r.name, r.folded, fold(r.name)) for r in folded(spark, names).collect() if r.folded != fold(r.name)]
    assert wrong == []


def test_random_names_fold_as_in_python(spark):
    rng = random.Random(4)
    alphabets = [
        "abcXYZ 0-'", "ãÃéÉçÇöÖßñÅøØłŁİıŉ", "̧́̈̃ͅ", "ΣσςΟΔΥΣ άΈώ", "한국어각힣가", "ﬁﬂ½①ⅣĳǄ㎏ﷺ",
        "𝐀𝔅𐐀🙂", "日本語ﾊﾟ", BLANKS[:12], "ЙйЁёЇї",
    ]
    names = [None, "", "  ", "ΟΔΥΣΣΕΥΣ", "ΣΑΣ", "São Paulo", " são paulo "]
    for _ in range(3000):
        letters = "".join(rng.sample(alphabets, rng.randint(1, 4)))
        names.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 12))))
    got = folded(spark, names).collect()
    assert [(r.name, r.folded) for r in got if r.folded != fold(r.name)] == [] and len(got) == len(names)


def test_no_name_leaves_the_jvm(spark):
    assert "Python" not in plan(folded(spark, ["São Paulo"]))
