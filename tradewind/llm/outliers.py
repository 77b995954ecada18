"""Quality rules with robust multivariate outliers.

Plain rules reject texts that are too short or repeat themselves. Of the others, every
language and source gets a minimum-covariance-determinant estimate of four transformed
statistics, and texts far from it by Mahalanobis distance are rejected.

The estimate starts from the medians and a diagonal scatter, then repeats: distances from
the present estimate, the quarter farthest away left out, mean and covariance of the rest.
Statistics are whole thousandths and moments are sums of whole numbers, so the result does
not depend on the order of the rows. Everything is built from SQL expressions that Spark
and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import SPACE_CLASS, written

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

STEPS = 3
SUBSET = 0.75  # share of a group that an estimate rests on
CONSISTENCY = 1.487  # of the covariance of the nearest three quarters of a normal sample in four dimensions
CUTOFF = 23.5  # of the squared distance: the 99.99 % point of chi-squared with four degrees of freedom
SHORT = 100.0  # words at which the distance of a text counts half, as its shares are that uncertain
MIN_GROUP = 50  # smaller groups of a language and source have no estimate and lose nothing

# Transformed statistics in thousandths, and the standard deviations below which none is taken as known.
VECTOR = {
    "x1": "CAST(round(1000 * ln(word_chars / CAST(n_words AS DOUBLE))) AS BIGINT)",
    "x2": "CAST(round(1000 * ln(1 + 10 * n_symbols / CAST(n_words AS DOUBLE))) AS BIGINT)",
    "x3": "CAST(round(1000 * sqrt(n_dup_lines / CAST(n_lines AS DOUBLE))) AS BIGINT)",
    "x4": "CAST(round(1000 * n_repeat_words / CAST(n_words AS DOUBLE)) AS BIGINT)",
}
FLOOR = {"x1": 30.0, "x2": 300.0, "x3": 200.0, "x4": 100.0}
NAMES = list(VECTOR)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]

BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Linear in the length of a text but for a sort of the windows of texts that repeat one;
    windows are compared by a 64-bit hash within their text.
    """
    value = F.coalesce(F.col(text), F.lit(""))

    def window_at(i: Column) -> Column:
        return F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])

    def twice(x: Column, k: Column) -> Column:
        same = [F.coalesce(F.get("_sorted", k + d)["_hash"] == x["_hash"], F.lit(False)) for d in (-1, 1)]
        return same[0] | same[1]

    def covered(x: Column, k: Column) -> Column:
        return F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - x, F.lit(WINDOW)))

    return (
        docs.withColumn("_words", F.filter(F.split(value, f"{SPACE_CLASS}+", -1), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split(value, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
        .withColumn(
            "_hashes",
            F.when(
                F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window_at)
            ),
        )
        .withColumn(
            "_sorted",
            F.when(
                F.size("_hashes") > F.size(F.array_distinct("_hashes")),
                F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("_hash"), i.alias("_at")))),
            ),
        )
        .withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", twice), lambda x: x["_at"])))
        .withColumn(
            "n_repeat_words",
            F.coalesce(
                F.aggregate(F.transform("_starts", covered), F.lit(0), lambda total, n: total + n), F.lit(0)
            ).cast("long"),
        )
        .drop("_words", "_lines", "_hashes", "_sorted", "_starts")
    )


def cholesky_sql() -> dict[str, str]:
    """The lower triangle of the covariance c_jk as expressions l_jk, each of those before it."""
    found = {}
    for a, b in PAIRS:
        rest = "".join(f" - l_{a}{k} * l_{b}{k}" for k in NAMES[: NAMES.index(b)])
        found[f"l_{a}{b}"] = f"sqrt(c_{a}{a}{rest})" if a == b else f"(c_{a}{b}{rest}) / l_{b}{b}"
    return {name: found[name] for name in sorted(found, key=lambda n: (n[4:6], n[2:4]))}


def distance_sql() -> str:
    """Squared distance of x from m under the triangle l, less for short texts."""
    terms: dict[str, str] = {}
    for a in NAMES:
        rest = "".join(f" - l_{a}{b} * {terms[b]}" for b in NAMES[: NAMES.index(a)])
        terms[a] = f"(({a} - m_{a}{rest}) / l_{a}{a})"
    return f"({' + '.join(f'{t} * {t}' for t in terms.values())}) * (n_words / (n_words + {SHORT}))"


def moments_sql() -> list[str]:
    sums = [f"CAST(sum({a}) AS DOUBLE) / count(*) AS m_{a}" for a in NAMES]
    return sums + [f"CAST(sum({a} * {b}) AS DOUBLE) / count(*) AS q_{a}{b}" for a, b in PAIRS]


def covariance_sql() -> list[str]:
    floors = {a: f" + {FLOOR[a] ** 2}" for a in NAMES}
    return [
        f"(q_{a}{b} - m_{a} * m_{b}) * {CONSISTENCY}{floors[a] if a == b else ''} AS c_{a}{b}" for a, b in PAIRS
    ]


def triangles(moments: DataFrame) -> DataFrame:
    """Estimates with their Cholesky factors, from moments per group."""
    found = moments.selectExpr("lang", "source", *[f"m_{a}" for a in NAMES], *covariance_sql())
    for name, value in cholesky_sql().items():
        found = found.withColumn(name, F.expr(value))
    return found.select("lang", "source", *[f"m_{a}" for a in NAMES], *cholesky_sql())


def with_distance(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """``stats`` with ``distance`` from the estimate of their group; null where there is none."""
    known = estimates.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = stats["lang"].eqNullSafe(known["_lang"]) & stats["source"].eqNullSafe(known["_source"])
    return (
        stats.join(known, same, "left")
        .withColumn("distance", F.expr(distance_sql()))
        .drop(*known.columns)
    )


def medians(stats: DataFrame) -> DataFrame:
    """Lower medians of the groups, from counts of the whole-number values; groups that are too small drop out."""
    stacked = ", ".join(f"'{a}', {a}" for a in NAMES)
    counts = stats.selectExpr("lang", "source", f"stack({len(NAMES)}, {stacked}) as (name, value)").groupBy(
        "lang", "source", "name", "value"
    ).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.selectExpr(
        "*",
        "sum(n) over (partition by lang, source, name order by value) as below",
        "sum(n) over (partition by lang, source, name) as total",
    ).where(f"total >= {MIN_GROUP} and 2 * below >= total")
    return (
        ranked.groupBy("lang", "source")
        .pivot("name", NAMES)
        .agg(F.min("value"))
        .selectExpr("lang", "source", *[f"cast({a} as double) as m_{a}" for a in NAMES])
    )


def estimate(stats: DataFrame) -> DataFrame:
    """Location m and Cholesky factor l of the scatter for every language and source with enough rows.

    ``stats`` has lang, source, n_words and the vector. Per group only counts of whole-number
    bins of the distance and sums are gathered, all summed before they are shuffled.
    """
    start = medians(stats)
    for a, b in PAIRS:
        start = start.withColumn(f"l_{a}{b}", F.lit(FLOOR[a] if a == b else 0.0))
    found = written(start, "estimates")
    for _ in range(STEPS):
        binned = with_distance(stats, found).where("distance is not null")
        binned = binned.withColumn("bin", F.expr("cast(floor(1000 * ln(1 + distance)) as bigint)"))
        limits = (
            binned.groupBy("lang", "source", "bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .selectExpr(
                "*",
                "sum(n) over (partition by lang, source order by bin) as below",
                "sum(n) over (partition by lang, source) as total",
            )
            .where(f"below >= {SUBSET} * total")
            .groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source"))
            .agg(F.min("bin").alias("last"))
        )
        limits = written(limits, "limits")
        same = binned["lang"].eqNullSafe(limits["_lang"]) & binned["source"].eqNullSafe(limits["_source"])
        moments = (
            binned.join(limits, same)
            .where("bin <= last")
            .groupBy("lang", "source")
            .agg(*[F.expr(m) for m in moments_sql()])
        )
        found = written(triangles(moments), "estimates")
    return found


def estimate_for_all(stats: DataFrame) -> DataFrame:
    """As ``estimate``, but a group that is too small has the estimate of its language, else that of all rows."""
    groups = written(stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "groups")
    found = estimate(stats)
    for keys in (["lang"], []):
        known = found.selectExpr("lang as _lang", "source as _source")
        same = groups["lang"].eqNullSafe(known["_lang"]) & groups["source"].eqNullSafe(known["_source"])
        missing = written(groups.join(known, same, "left_anti").select("lang", "source"), "missing")
        if missing.isEmpty():
            break
        # A wider group has nulls for the columns that do not tell it apart.
        free = {name: F.lit(None).cast("string") for name in ("lang", "source") if name not in keys}
        wider = estimate(stats.withColumns(free)).drop("source").withColumnRenamed("lang", "_lang")
        if keys:
            more = missing.join(wider, missing["lang"].eqNullSafe(wider["_lang"]))
        else:
            more = missing.crossJoin(F.broadcast(wider))  # one row at most
        found = written(found.unionByName(more.drop("_lang")), "estimates")
    return found


def quality_statistics(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their statistics, the rule's verdict and the vector."""
    return (
        text_statistics(docs)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumns({a: F.when(~F.col("base_failed"), F.expr(x)) for a, x in VECTOR.items()})
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    ``docs`` has doc_id, text, lang and source; other columns are ignored. Null and empty
    texts have no words and fail the base rule; null languages and sources form groups of
    their own; repeated rows count each; an empty table gives an empty result. ``distance``
    is null where the base rule fails or the group has fewer than ``MIN_GROUP`` other rows.
    """
    stats = written(quality_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    judged = with_distance(stats, estimate(stats.where("not base_failed")))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.expr(f"not base_failed and coalesce(distance <= {CUTOFF}, true)").alias("kept"),
        "distance",
    )


def quality_kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Unlike in ``quality_verdicts`` groups under ``MIN_GROUP`` rows are judged too, by the
    estimate of their language or, where that is as small, of all rows. Only where all rows
    together are too few is nothing known to judge by.

    Statistics are taken once for the estimates and once more, row by row, for the
    verdict, so no text is shuffled and repeated ids need no care.
    """
    columns = docs.columns
    # Filters on statistics stand above a written table or a join: pushed below, they would
    # repeat the expressions of every statistic they use.
    stats = quality_statistics(docs.select("text", "lang", "source"))
    stats = written(stats.select("lang", "source", "n_words", "base_failed", *NAMES), "statistics")
    found = estimate_for_all(stats.where("not base_failed"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text", "lang", "source")
    judged = with_distance(quality_statistics(whole), found)
    kept = judged.where(f"case when base_failed then false else coalesce(distance <= {CUTOFF}, true) end")
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])


def oracle() -> str:
    """The query over ``documents`` in DuckDB's SQL."""
    doc = "SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents"
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    lines = r"list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))"
    ctes = [
        f"d AS ({doc})",
        f"w AS (SELECT doc_id, lang, source, t, {words} AS words, {lines} AS lines FROM d)",
        "i AS (SELECT doc_id, words, unnest(range(len(words))) AS k FROM w)",
        f"h AS (SELECT doc_id, k, array_to_string(words[k + 1 : k + {WINDOW}], ' ') AS g FROM i"
        f" WHERE k + {WINDOW} <= len(words))",
        "r AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1)",
        f"u AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WINDOW})) AS k FROM r)",
        "v AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id)",
        "b AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,"
        " CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,"
        " CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,"
        " CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,"
        " CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN v ON v.doc_id = w.doc_id)",
        f"s AS (SELECT *, ({BASE_FAILED}) AS base_failed FROM b)",
        f"x AS (SELECT *, {', '.join(f'{e} AS {a}' for a, e in VECTOR.items())} FROM s WHERE NOT base_failed)",
        "e0 AS (SELECT lang, source, "
        + ", ".join(f"CAST(quantile_disc({a}, 0.5) AS DOUBLE) AS m_{a}" for a in NAMES)
        + ", "
        + ", ".join(f"CAST({FLOOR[a] if a == b else 0.0} AS DOUBLE) AS l_{a}{b}" for a, b in PAIRS)
        + f" FROM x GROUP BY lang, source HAVING count(*) >= {MIN_GROUP})",
    ]
    on = "e.lang IS NOT DISTINCT FROM x.lang AND e.source IS NOT DISTINCT FROM x.source"
    for k in range(STEPS):
        ctes += [
            f"g{k} AS (SELECT x.*, CAST(floor(1000 * ln(1 + {distance_sql()})) AS BIGINT) AS bin"
            f" FROM x JOIN e{k} e ON {on})",
            f"o{k} AS (SELECT *, cume_dist() OVER (PARTITION BY lang, source ORDER BY bin) AS share FROM g{k})",
            f"f{k} AS (SELECT lang, source, min(bin) AS last FROM o{k} WHERE share >= {SUBSET} GROUP BY lang, source)",
            f"m{k} AS (SELECT x.lang, x.source, {', '.join(moments_sql())} FROM g{k} x JOIN f{k} e ON {on}"
            " WHERE bin <= last GROUP BY x.lang, x.source)",
            f"c{k} AS (SELECT lang, source, {', '.join(f'm_{a}' for a in NAMES)}, {', '.join(covariance_sql())}"
            f" FROM m{k})",
            f"e{k + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in cholesky_sql().items())} FROM c{k})",
        ]
    ctes.append(f"j AS (SELECT x.doc_id, {distance_sql()} AS distance FROM x JOIN e{STEPS} e ON {on})")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,"
        f" base_failed, (NOT base_failed AND coalesce(distance <= {CUTOFF}, true)) AS kept"
        " FROM s LEFT JOIN j ON j.doc_id = s.doc_id"
    )
