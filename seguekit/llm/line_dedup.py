"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host if it stands on at least ``min_pages`` of the host's pages and on more than
``max_ratio`` of them. Such lines go from every page of that host, all other lines stay in place.

Counts: each page gives a distinct line once, so the hot host and the hot line are summed on the map side before the
shuffle. A host has fewer than (mean distinct lines of its pages) / ``max_ratio`` boilerplate lines, so the list per
host is short; it is joined back on (host, salt), which deals a hot host over ``salts`` tasks.

With ``copies_once``, pages of a host with the same lines count as one page, in both counts of the ratio.

A line of one page is no repeat, so ``min_pages`` is 2; from there on the ratio alone decides, at every size.

Defined results: a null or empty host is no site, its pages keep all lines; null text counts as empty and stays null;
lines are compared exactly but for blanks at their ends; empty lines stay; repeated rows count as pages of their own;
a page of nothing but boilerplate keeps its row with an empty text; texts of any length are cut whole; an empty table gives an
empty result; other columns pass through untouched, but for ``lines_total`` and ``lines_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguekit.llm.common import text_or_empty


def page_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, max_ratio: float = 0.3, min_pages: int = 2, salts: int = 32, copies_once: bool = False) -> DataFrame:
    """host, lines: the 64-bit hashes of each host's boilerplate lines (hosts with none are absent)."""
    hashes = F.array_distinct(F.transform(F.filter(F.transform(page_lines(text), F.trim), lambda x: x != ""), lambda x: F.xxhash64(x)))
    seen = pages.select(host.alias("__host"), F.coalesce(hashes, F.array().cast("array<bigint>")).alias("__hashes")).where(F.col("__host").isNotNull() & (F.col("__host") != ""))
    if copies_once:
        seen = seen.withColumn("__text", F.xxhash64("__hashes")).dropDuplicates(["__host", "__text"])
    lines = seen.select("__host", F.explode_outer("__hashes").alias("__line")).where(F.col("__line").isNotNull())  # a plain explode filters by size first and takes the lines twice
    counted = lines.groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    totals = seen.groupBy("__host").agg(F.count("*").alias("__pages")).select(F.col("__host").alias("__site"), "__pages", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s"))
    same = (F.col("__host") == F.col("__site")) & (F.pmod(F.col("__line"), F.lit(salts)).cast("int") == F.col("__s"))
    over = counted.join(totals, same).where(F.col("__n") > F.lit(max_ratio) * F.col("__pages"))
    return over.groupBy("__host").agg(F.collect_list("__line").alias("lines")).select(F.col("__host").alias("host"), "lines")


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", max_ratio: float = 0.3, min_pages: int = 2, salts: int = 32, copies_once: bool = False) -> DataFrame:
    """``pages`` with the boilerplate lines cut out of ``text_col``, and ``lines_total`` and ``lines_dropped``."""
    text = text_or_empty(text_col)
    sites = boilerplate_lines(pages, host, text, max_ratio, min_pages, salts, copies_once).select(
        F.col("host").alias("__site"), F.col("lines").alias("__drop"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s")
    )
    marked = pages.withColumn("__host", host).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    joined = marked.join(sites, (F.col("__host") == F.col("__site")) & (F.col("__salt") == F.col("__s")), "left")
    lines = page_lines(text)
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), F.xxhash64(F.trim(x)))))
    out = joined.withColumn("__kept", kept).withColumn("lines_total", F.size(lines).cast("long")).withColumn("lines_dropped", (F.size(lines) - F.size("__kept")).cast("long"))
    cleaned = F.when(F.col("lines_dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text_col))
    return out.withColumn(text_col, cleaned).drop("__host", "__salt", "__site", "__drop", "__s", "__kept")


def html_text(html: Column) -> Column:
    """Visible text of a page, a line for each block: scripts, styles, comments and tags go."""
    x = F.regexp_replace(text_or_empty(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title|body|head|html)(?:\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    return F.btrim(F.regexp_replace(x, r"[ \t\r]*\n[\s]*", "\n"), F.lit(" \n\t\r"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
