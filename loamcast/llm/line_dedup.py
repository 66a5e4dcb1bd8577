"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site where the share of the site's pages that hold it exceeds `ratio`.
Lines are counted by their 128-bit digests, once per page; a site's boilerplate is a set of at most
(lines per page / ratio) digests, so texts are filtered in place and never shuffled line by line.

Web pages are grouped by the host of their url, and their lines are those of the html's block structure;
texts that are plain already are split at line ends and grouped by any column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamcast.llm.common import numbered, restored, stage, unused

RATIO, LEAST = 0.2, 3
#: Pieces that a site's pages are dealt into where they meet its boilerplate, so that no site is one task's.
SALT = 16
# The parts of an html page without text, and the elements that begin or end a line.
UNSEEN = "(?s)<!--.*?-->|<(?:script|SCRIPT)[ >].*?</(?:script|SCRIPT)[^>]*>|<(?:style|STYLE)[ >].*?</(?:style|STYLE)[^>]*>"
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|meta|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
BLOCK = f"</?(?:{BLOCKS}|{BLOCKS.upper()})(?:[ \\t\\n\\r/][^>]*)?>"
TAG = "<[!/a-zA-Z][^>]*>"
EDGES = "[ \\t\\x0B\\f\\r]*\\n[ \\t\\n\\x0B\\f\\r]*"
OUTER = "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty where it has none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def html_lines(html: Column) -> Column:
    """The text of an html page, a line for each run between block tags or line ends; no line is blank.

    Comments, scripts and styles go, inline tags are taken out, entities stay as they are.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, "\n"), BLOCK, "\n"), TAG, "")
    return F.regexp_replace(F.regexp_replace(plain, EDGES, "\n"), OUTER, "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) == 0


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """One row (site_key, drop: array of digests) per site that has boilerplate.

    A line is in it if more than `ratio` of the site's pages, and `least` at least, hold it; lines
    without a word never are. A null site is a site of its own; null texts count as pages.
    """
    rows = pages.select(_key(site).alias("site_key"), text.alias("t"))
    totals = rows.groupBy("site_key").agg(F.count(F.lit(1)).alias("pages"))
    held = rows.select("site_key", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: ~_blank(x)), _digest))).alias("line"))
    counts = held.groupBy("site_key", "line").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= least)
    over = counts.join(totals, "site_key").where(F.col("holding") > F.col("pages") * F.lit(ratio))
    return over.groupBy("site_key").agg(F.collect_set("line").alias("drop"))


def _key(site: Column) -> Column:
    return F.when(site.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), site.cast("string")))


def clean(pages: DataFrame, site: Column, text: Column | str = "text", ratio: float = RATIO, least: int = LEAST, into: str | None = None) -> DataFrame:
    """pages with the text rid of boilerplate lines, and the numbers of lines __lines and __dropped (int).

    text is a column's name or an expression over pages; the result takes the place of column `into` (the
    named one by default). Added columns are called __lines and __dropped with more underscores where
    pages has such names; they come last. A null text stays null with no lines; every row is kept, also
    one whose lines all go, and long texts are filtered whole. Repeated rows count as pages of their own.
    An empty table gives an empty result.
    """
    into = into or text
    rows = numbered(pages)
    rows = pages.select("*", _key(site), F.col(text) if isinstance(text, str) else text).toDF(*rows.columns, "site_key", "t")
    drops = stage(boilerplate(pages, site, F.col(text) if isinstance(text, str) else text, ratio, least), "boilerplate")
    drops = drops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALT)).cast("int")).join(drops, ["site_key", "salt"], "left")
    lines = _lines(F.col("t"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("drop"), _digest(x)) | _blank(x))
    out = out.withColumn("kept", F.when(F.col("drop").isNull(), lines).otherwise(kept))
    size = lambda c: F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(c))
    out = out.withColumns({"__lines": size(lines), "__dropped": size(lines) - size(F.col("kept"))})
    out = out.withColumn(f"c{pages.columns.index(into)}", F.array_join("kept", "\n"))
    return restored(out, pages.columns, "__lines", "__dropped").toDF(*pages.columns, *unused(pages, "__lines", "__dropped"))


def dedup_lines(pages: DataFrame, site: Column, text: Column | str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """pages with boilerplate lines dropped; the columns are those of pages, whatever they are called."""
    out = clean(pages, site, text, ratio, least)
    return restored(numbered(out), pages.columns)


def clean_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """clean() of web pages by the host of their urls; html_col becomes the lines that are left.

    Pages are parsed once: their lines are staged, and read for counting and for filtering.
    """
    site = unused(pages, "site")
    lines = stage(pages.withColumns({site: host(F.col(url_col)), html_col: html_lines(F.col(html_col))}), "page-lines")
    return clean(lines, F.col(site), html_col, ratio, least).drop(site)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = f"""
with t as (
  select row_number() over () as r, page_id, lower(regexp_extract(url, {_quoted(HOST)}, 1)) as host,
    regexp_replace(regexp_replace(regexp_replace(html, {_quoted(UNSEEN)}, chr(10), 'g'), {_quoted(BLOCK)}, chr(10), 'g'), {_quoted(TAG)}, '', 'g') as plain from pages),
d as (select r, page_id, host, string_split(regexp_replace(regexp_replace(plain, {_quoted(EDGES)}, chr(10), 'g'), {_quoted(OUTER)}, '', 'g'), chr(10)) as ls from t),
l as (select distinct r, host, unnest(ls) as line from d),
c as (select host, line, count(*) as n from l where length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0 group by host, line),
p as (select host, count(*) as pages from d group by host),
b as (select c.host, list(line) as drops from c join p on c.host is not distinct from p.host where n >= {LEAST} and n > pages * {RATIO}::double group by c.host),
k as (select d.*, case when b.drops is null then ls else list_filter(ls, lambda x: not list_contains(b.drops, x)) end as ks from d left join b on d.host is not distinct from b.host)
select page_id, host, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(ls) - len(ks), 0)::bigint as n_dropped, md5(array_to_string(ks, chr(10))) as kept_md5 from k
"""
