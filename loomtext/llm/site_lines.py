"""Line dedup by site-relative frequency.

A line is boilerplate of its site when the share of the site's pages that
contain it exceeds ``max_ratio`` and at least ``min_pages`` of them do.  Lines
are compared without blanks, tabs and carriage returns at their ends; blank lines are never
boilerplate.  Every boilerplate line is dropped wherever it stands.

A site has at most (mean lines a page) / ``max_ratio`` such lines, so the list
is small beside the pages.  It is written out; while the file is at most
``broadcast_bytes`` it is broadcast by site and pages are cleaned where they
are, with no shuffle of their texts.  Beyond that, lines are matched in a
shuffle on (site, line) and only line numbers come back to the pages.  Both
ways give the same rows.

A null text stays null, an empty one empty.  Pages of a null site are a site of
their own.  Repeated rows count as pages each and are all kept.  A text of
which every line is dropped becomes empty.  Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import scratch, table_bytes

MAX_RATIO = 0.08
MIN_PAGES = 5
BROADCAST_BYTES = 32 << 20


def _site(col: str) -> Column:
    """Null apart from every name."""
    return F.when(F.col(col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(col).cast("string")))


def _hash(line: Column) -> Column:
    """128 bits, so that equal keys are equal lines at any size of corpus."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _bare(line: Column) -> Column:
    """Without blanks, tabs and carriage returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line, pages, total): the hash of each boilerplate line of each site."""
    rows = pages.select(_site(site_col).alias("site"), F.col(text_col).alias("text"))
    total = rows.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    keys = F.array_distinct(F.filter(F.transform(_lines("text"), lambda x: _bare(x)), lambda x: x != ""))
    seen = rows.select("site", F.explode(F.transform(keys, _hash)).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return seen.join(total, "site").where(F.col("pages") > F.col("total") * F.lit(max_ratio))


def drop_boilerplate(pages: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES, count_col: str | None = None) -> DataFrame:
    """The pages without their site's boilerplate lines; ``count_col`` names a column for the lines dropped."""
    columns = pages.columns
    bad = scratch(boilerplate(pages, site_col, text_col, max_ratio, min_pages).select("site", "line"), "boilerplate")
    lines = _lines(text_col)
    if table_bytes(bad) <= broadcast_bytes:
        by_site = bad.groupBy(F.col("site").alias("__site")).agg(F.collect_set("line").alias("__bad"))
        rows = pages.withColumn("__site", _site(site_col)).join(F.broadcast(by_site), "__site", "left")
        kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__bad", _hash(_bare(x))), F.lit(False)))
    else:
        keyed = pages.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), _site(site_col).alias("site"))
        each = keyed.select("__id", "site", F.explode(F.array_distinct(F.transform(_lines("__text"), lambda x: _hash(_bare(x))))).alias("line"))
        hit = each.join(bad, ["site", "line"], "left_semi").groupBy("__id", "site").agg(F.collect_set("line").alias("__bad"))
        rows = pages.withColumns({"__key": F.col(id_col), "__site": _site(site_col)}).join(hit.withColumnRenamed("site", "__s"), F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__site") == F.col("__s")), "left")
        kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__bad", _hash(_bare(x))), F.lit(False)))
    rows = rows.withColumn("__kept", F.when(F.col("__bad").isNull(), lines).otherwise(kept))
    text = F.when(F.col("__bad").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in columns]
    if count_col:
        out.append(F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias(count_col))
    return rows.select(*out)


#: The same over ``documents`` in DuckDB.
ORACLE_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
total AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
seen AS (SELECT source, line, count(*) AS n FROM (
  SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM pages)
  WHERE line <> '' GROUP BY source, line),
bad AS (SELECT s.source, list(s.line) AS lines FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n >= {MIN_PAGES} AND s.n > t.total * {MAX_RATIO} GROUP BY s.source),
kept AS (SELECT p.doc_id, p.source, p.text, p.lines,
  list_filter(p.lines, lambda x: NOT list_contains(coalesce(b.lines, []), trim(x, ' ' || chr(9) || chr(13)))) AS rest
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(rest, chr(10)) END AS text,
  coalesce(len(lines) - len(rest), 0)::BIGINT AS dropped FROM kept
"""
