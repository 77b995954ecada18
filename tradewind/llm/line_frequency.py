"""Boilerplate lines by their frequency within a site.

For every site the pages that contain a line are counted and divided by the pages of the
site; a line on more than a given share of them is boilerplate there and is dropped from
every page of that site. The same line stays on sites where it is rare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import SPACE_CLASS, written

RATIO = 0.05  # of the site's pages; a line on more is boilerplate
MIN_PAGES = 20  # sites with fewer pages have no boilerplate: a ratio means little there
MIN_COUNT = 3  # pages with the line, at least
SPACES = " \t\n\x0b\x0c\r"  # the characters of SPACE_CLASS
SHORT_WORDS = 8  # longer lines are repeats at a share that halves with every further word (drop_repeated)

BLOCK_TAGS = "p|div|br|hr|li|ul|ol|nav|h[1-6]|article|section|header|footer|aside|table|tr|td|th|title|pre|main|form"
BREAKS = rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def html_lines(html: Column) -> Column:
    """The text of a page with a line break at every block tag; comments, scripts and styles go."""
    without = F.regexp_replace(html, r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)", "")
    return F.regexp_replace(F.regexp_replace(without, BREAKS, "\n"), r"<[^>]*>", "")


def boilerplate_lines(
    pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_count: int = MIN_COUNT
) -> DataFrame:
    """One row per site with boilerplate: ``site`` and ``lines``, the hashes of its lines.

    A site's list has at most (mean lines of a page / ratio) entries. Counts are summed
    before every shuffle, so neither a site nor a line with a third of all pages is gathered.
    """
    kept = pages.select(F.col(site).alias("site"), F.col(text).alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), trimmed))
    counts = (
        kept.select("site", F.explode(lines).alias("line"))
        .where("line <> ''")
        .groupBy("site", F.xxhash64("line").alias("line"))
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") >= min_count)
    )
    totals = kept.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return (
        counts.join(totals, counts["site"].eqNullSafe(totals["site"]))
        .where(F.col("found") > F.lit(ratio) * F.col("pages"))
        .groupBy(counts["site"])
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(
    pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_count: int = MIN_COUNT
) -> DataFrame:
    """All rows and columns of ``pages`` with ``text`` less its boilerplate lines, and two counts.

    Adds ``n_lines`` (lines with a word) and ``n_dropped`` (long); a column of ``pages`` with
    such a name is replaced. Lines are compared without the white space around them, by a
    64-bit hash; lines without a word are never dropped and the others keep their order and
    bytes. A null text stays null with counts of 0, a null site is a site of its own,
    repeated rows count as pages of their own, an empty table gives an empty result.
    """
    known = written(boilerplate_lines(pages, site, text, ratio, min_pages, min_count), "boilerplate")
    known = known.select(F.col("site").alias("_site"), F.col("lines").alias("_boilerplate"))
    joined = pages.drop("n_lines", "n_dropped").join(known, pages[site].eqNullSafe(known["_site"]), "left")
    return without_lines(joined, pages.columns, text)


def without_lines(joined: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns with ``text`` less the lines whose hashes are in ``_boilerplate``, n_lines and n_dropped."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(F.transform("_lines", trimmed), lambda bare: F.when(bare != "", F.xxhash64(bare)))
    stays = F.filter(
        F.arrays_zip("_lines", "_hashes"),
        lambda x: x["_hashes"].isNull() | ~F.array_contains(F.col("_boilerplate"), x["_hashes"]),
    )
    return (
        joined.withColumn("_lines", lines)
        .withColumn("_hashes", hashes)
        .withColumn(
            "_kept",
            F.when(F.col("_boilerplate").isNull(), F.arrays_zip("_lines", "_hashes")).otherwise(stays),
        )
        .select(
            *[
                F.when(F.col("_boilerplate").isNull(), F.col(text)).otherwise(
                    F.array_join(F.col("_kept")["_lines"], "\n")
                ).alias(text)
                if name == text
                else F.col(f"`{name}`")
                for name in columns
                if name not in ("n_lines", "n_dropped")
            ],
            F.coalesce(F.size(F.array_compact("_hashes")), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


def drop_repeated(
    pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_count: int = MIN_COUNT
) -> DataFrame:
    """As ``drop_boilerplate`` for a site of any size, and without the repeats of longer lines.

    A line on more than ``ratio`` of a site's pages goes from all of them. Above
    ``SHORT_WORDS`` words the ratio halves with every further word, as chance repeats get
    rarer; a line between the two ratios stays on one page and goes from the others. Pages of
    one site with the same text count as one and keep or lose the same lines, so copies of a
    document are not taken for pages that share lines.
    """
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), trimmed))
    words = F.size(F.filter(F.split("line", f"{SPACE_CLASS}+", -1), lambda w: w != ""))
    seen = (
        pages.select(F.col(site).alias("site"), F.col(text).alias("text"))
        .select("site", F.xxhash64("text").alias("page"), F.explode(lines).alias("line"))
        .where("line <> ''")
        .select("site", "page", words.alias("words"), F.xxhash64("line").alias("line"))
    )
    seen = written(seen.distinct(), "lines")
    totals = seen.select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        seen.groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("found"), F.min("page").alias("first"), F.max("words").alias("words"))
        .where(F.col("found") >= min_count)
    )
    share = F.lit(ratio) * F.col("pages")
    repeated = (
        counts.join(totals, counts["site"].eqNullSafe(totals["site"]))
        .where(F.col("found") > share / F.pow(F.lit(2.0), F.greatest(F.col("words") - SHORT_WORDS, F.lit(0))))
        .select(counts["site"].alias("_site"), F.col("line").alias("_line"), "first", (F.col("found") > share).alias("all"))
    )
    repeated = written(repeated, "repeated")
    everywhere = repeated.where("all").groupBy("_site").agg(F.collect_list("_line").alias("_everywhere"))
    once = repeated.where("not all")  # each on few of its site's pages, so none is a hot key
    once = (
        seen.join(once, seen["site"].eqNullSafe(once["_site"]) & (seen["line"] == once["_line"]))
        .where("page <> first")
        .groupBy(F.col("site").alias("_site_of"), F.col("page").alias("_page"))
        .agg(F.collect_list("line").alias("_once"))
    )
    joined = (
        pages.drop("n_lines", "n_dropped")
        .join(everywhere, pages[site].eqNullSafe(everywhere["_site"]), "left")
        .join(once, pages[site].eqNullSafe(once["_site_of"]) & (F.xxhash64(pages[text]) == once["_page"]), "left")
    )
    both = F.concat(*[F.coalesce(name, F.expr("cast(array() as array<bigint>)")) for name in ("_everywhere", "_once")])
    joined = joined.withColumn("_boilerplate", F.when(F.size(both) > 0, both))
    return without_lines(joined, pages.columns, text)


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES, min_count: int = MIN_COUNT) -> str:
    """The query over ``pages`` in DuckDB's SQL."""
    strip = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    no_script = (
        "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
    )
    text = f"regexp_replace(regexp_replace({no_script}, '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    return f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, {text} AS t FROM pages),
l AS (
  SELECT page_id, site, s.line, {strip.format("s.line")} AS bare, s.k
  FROM (SELECT page_id, site, unnest(string_split(t, chr(10))) AS line,
               unnest(range(len(string_split(t, chr(10))))) AS k FROM p) s),
n AS (SELECT site, count(*) AS pages FROM p GROUP BY site HAVING count(*) >= {min_pages}),
b AS (
  SELECT f.site, f.bare FROM (SELECT site, bare, count(DISTINCT page_id) AS found FROM l WHERE bare <> ''
                              GROUP BY site, bare) f JOIN n ON n.site = f.site
  WHERE f.found >= {min_count} AND f.found > {ratio} * n.pages),
k AS (
  SELECT l.page_id, count(*) FILTER (WHERE l.bare <> '') AS n_lines, count(b.bare) AS n_dropped,
         string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE b.bare IS NULL) AS kept
  FROM l LEFT JOIN b ON b.site = l.site AND b.bare = l.bare GROUP BY l.page_id)
SELECT page_id, n_lines, n_dropped, length(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM k"""
