"""Line dedup by site-relative frequency. DataFrame operations only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it divided by the number of
the host's pages; lines over MAX_RATIO, on at least MIN_PAGES pages, are boilerplate and are dropped from every page.

Counting is per (host, line) with partial aggregates, so a line that a third of all pages share costs a row per task.
A page has few lines over the ratio, hence a host has at most (mean lines of a page) / MAX_RATIO of them; they come to the
pages as one short array. That join is dealt by (host, salt) with the array repeated for each salt, so a host with a
third of all pages is spread over SALTS places.

Lines are made of HTML natively: scripts, styles and comments go, tags of blocks end a line, other tags vanish, the
five predefined entities and &nbsp; are decoded, white space becomes one space, empty lines are none.

Edge cases: null html has no lines; null URLs make a host of their own; a line that repeats on one page counts once for the ratio
and is dropped at each place; hosts with fewer than MIN_PAGES pages lose nothing; equal pages count each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored

MAX_RATIO, MIN_PAGES = 0.2, 3
SALTS = 32
#: What is removed with its content, tags that end a line, and entities.
REMOVED = (r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>", r"(?is)<head[^>]*>.*?</head[^>]*>", r"(?s)<!--.*?-->")
BREAKS = r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|article|main|header|footer|nav|aside|blockquote|pre|form|title|body|html)([\x20\x09-\x0D/][^>]*)?>"
TAGS = r"<[/!?A-Za-z][^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SPACES = r"[\x20\x09\x0B-\x0D]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"


def html_lines(page: Column) -> Column:
    """Non-empty lines of an HTML page."""
    for pattern in REMOVED:
        page = F.regexp_replace(page, pattern, " ")
    page = F.regexp_replace(F.regexp_replace(page, BREAKS, "\n"), TAGS, "")
    for name, value in ENTITIES:
        page = F.replace(page, F.lit(name), F.lit(value))
    lines = F.transform(F.split(F.regexp_replace(page, SPACES, " "), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def line_dedup(pages: DataFrame, lines: Column | None = None, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text for each row of pages (page_id, url, html, or an array of lines given)."""
    lines = html_lines(F.coalesce(F.col("html"), F.lit(""))) if lines is None else F.coalesce(lines, F.array().cast("array<string>"))
    rows = pages.select("page_id", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), lines.alias("lines"))
    rows = stored(rows, "lines")  # cutting pages into lines is most of the work and both uses read it
    counts = rows.select("host", F.explode(F.array_distinct(F.transform("lines", F.md5))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    common = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("total"))
    drop = common.groupBy("host").agg(F.collect_list("line").alias("drop"))
    drop = drop.select("host", "drop", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    kept = F.filter("lines", lambda x: ~F.array_contains("drop", F.md5(x)))
    out = salted.join(drop, ["host", "salt"], "left").withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept))
    n = F.size("lines").cast("long")
    return out.select("page_id", "host", n.alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_dropped"), F.concat_ws("\n", "kept").alias("text"))
