"""Line deduplication by site-relative frequency, with SQL functions only.

A line is boilerplate on a host if more than ``ratio`` of the host's pages hold it (and
at least ``min_pages`` do). Lines are counted once a page, by (host, line), with
map-side combining; a host's boilerplate lines are few by definition, at most its lines
a page divided by the ratio, so they travel as one array a host. Pages are parsed once and
their lines written. Hosts with more than a 1,024th of all pages, of which there are at most
1,024, meet their lines without a shuffle; so no host's pages gather in one task.

A page's lines are the text runs between its block tags; scripts, styles and comments
are left out and inline tags do not break a line.

Defined cases: a null page has no lines; a null or unparsable URL belongs to host '';
a line that repeats within a page counts as one page and is dropped everywhere; a line
at the ratio exactly stays; blank lines are no lines; very long pages are read whole; repeated rows are pages by themselves; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, spread_join

RATIO = 0.1
MIN_PAGES = 3

#: Patterns, the same in the SQL of the registered query.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
UNSEEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
INLINE = r"(?i)</?(?:a|abbr|b|code|em|font|i|small|span|strong|sub|sup|u)(?:\s[^>]*)?>"
TAG = r"<[^>]*>"
BREAK = r"[\n\r]+"
SPACE = r"[ \t\n\x0B\f\r]+"


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(column(url), HOST, 1), F.lit("")))


def lines_of(html: str) -> F.Column:
    """The page's lines in order, blanks collapsed."""
    seen = F.regexp_replace(F.coalesce(column(html), F.lit("")), UNSEEN, "")
    runs = F.split(F.regexp_replace(F.regexp_replace(seen, INLINE, ""), TAG, "\n"), BREAK)
    return F.filter(F.transform(runs, lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def boilerplate(lined: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, host_pages and the array of its boilerplate lines, for hosts with any; from written (host, lines) rows."""
    hosts = lined.groupBy("host").agg(F.count("*").alias("host_pages"))
    counted = lined.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    counted = materialize(counted, "line-counts")
    both = spread_join(counted, hosts, ["host"], "host_pages", lined.count())
    return both.where(F.col("pages") / F.col("host_pages") > ratio).groupBy("host").agg(F.max("host_pages").alias("host_pages"), F.collect_list("line").alias("drop"))


def strip_boilerplate(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay, one a line)."""
    lined = materialize(pages.select(column(id_col).alias("page_id"), host_of(url).alias("host"), lines_of(html).alias("lines")), "line-pages", "zstd")
    drops = materialize(boilerplate(lined, ratio, min_pages), "line-drops")
    joined = spread_join(lined, drops, ["host"], "host_pages", lined.count(), "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), x)))
    out = joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
