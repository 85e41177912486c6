"""Line dedup: lines that a large part of a site's pages share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, read_table

#: A line on more than this part of its host's pages is dropped, if more pages than one have it.
RATIO = 0.3

# What ends a line of a page or is no text of it.  A script, style or comment that nothing closes goes on to
# the page's end, and a tag holds no other's beginning: so each character is read once, whatever the page.
BREAKS = (
    r"(?is)<script\b.*?(?:</script[\x20\x09-\x0D]*>|\z)|<style\b.*?(?:</style[\x20\x09-\x0D]*>|\z)|<!--.*?(?:-->|\z)"
    r"|</?(?:html|head|title|body|p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|section|article|aside|nav|header|footer|main|pre|blockquote|form)\b[^<>]*>"
)
TAGS = r"<[^<>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def page_lines(html: Column) -> Column:
    """The lines of a page's text: trimmed, without empty ones.  Plain text passes as it is."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), BREAKS, "\n"), TAGS, "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    lines = F.split(F.translate(text, "\r\t", "\n "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def _mark(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("second")).alias("b"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, host, lines, kept`` (arrays of lines, in the page's order).

    A line counts once per page, however often the page repeats it; a line that only one page of the host
    has is shared with none and stays.  Pages are taken apart once and their lines written; counts are
    taken from marks of 128 bits, combined before the shuffle; the lines are shuffled once, to meet the
    marks that their page loses.  A host or a line that is on a third of all pages is a key of partial
    sums and of joins of written tables, whose large partitions can be split, and is never gathered.

    Defined cases: a page without host keeps all its lines; null or empty html has no lines; rows that
    repeat a page count as pages of their own; very long pages are read once from end to end; an empty
    table gives an empty result; other columns are ignored.
    """
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), page_lines(F.col(text_col)).alias("lines"))
    rows = cut(parts.select(F.monotonically_increasing_id().alias("row"), "*"))
    each = rows.where("host <> ''").select("row", "host", F.explode(F.array_distinct(F.transform("lines", _mark))).alias("m")).select("row", "host", "m.a", "m.b")
    per_line = each.groupBy("host", "a", "b").agg(F.count("*").alias("n"))
    per_host = cut(rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("total")))
    common = cut(per_line.where("n > 1").join(per_host, "host").where(F.col("n") > ratio * F.col("total")).select("host", "a", "b"))
    lost = each.join(common, ["host", "a", "b"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("lost"))
    both = rows.join(lost, "row", "left")
    gone = F.coalesce("lost", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    return both.select("page_id", "host", "lines", F.when(F.size(gone) == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(gone, _mark(x)))).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, kept_sha256`` (of the kept lines, one to a line)."""
    out = drop_boilerplate(read_table(spark, sf_dir, "pages"))
    n, k = F.size("lines").cast("long"), F.size("kept").cast("long")
    return out.select("page_id", "host", n.alias("n_lines"), (n - k).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def _sql() -> str:
    text = f"regexp_replace(regexp_replace(coalesce(html, ''), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    for name, sign in ENTITIES:
        text = f"replace({text}, '{name}', '{sign}')"
    return f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(string_split(translate({text}, chr(13) || chr(9), chr(10) || ' '), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS total FROM p WHERE host <> '' GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host <> '') GROUP BY ALL),
c AS (SELECT host, list(line) AS lost FROM l JOIN t USING (host) WHERE n > 1 AND n > {RATIO} * total GROUP BY host),
k AS (SELECT page_id, host, lines, CASE WHEN lost IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(lost, x)) END AS kept FROM p LEFT JOIN c USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""


SQL = _sql()
