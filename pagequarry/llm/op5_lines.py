"""Line dedup by site-relative frequency.

Texts are grouped by host (the ``source`` column); the pages of a host that contain a line are divided
by all pages of that host, and a line whose share exceeds ``ratio`` (and that at least ``min_pages``
pages contain) is boilerplate of that host and dropped from its pages.

A line is a stretch between line feeds, compared without blanks around it and without regard to case;
blank lines are kept.  Pages of a host with the same whole text count as one page, in the share as in
the total, so that a mirrored page is not its own boilerplate.

Everything is a JVM expression.  Lines are exploded as 64-bit hashes beside (host, text hash), counted
with map-side combine; texts never take part in a shuffle while the boilerplate list is small enough
to broadcast (its rows are counted first); beyond that limit the list is joined by (host, line) and
only the hashes of the lines to drop travel to their pages.

Defined results: a null host is a host of its own; a null text has no lines, is no page and stays as it
is; an empty text is a page without lines; a document whose lines are all dropped goes altogether when
``drop_empty`` is set (the pipeline's choice), otherwise its text is empty; repeated rows are one page
and are both cleaned; ties need no order.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._shared import checkpointed

RATIO = 0.01
MIN_PAGES = 5
BROADCAST_ROWS = 200_000
_SEED = 1 << 20


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(line))


def line_key(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_shares(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, line, n_pages, n_host): each line's pages and its host's pages; lines as hashes."""
    slim = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    # one page for each distinct text of a host; host and text hash are all that is needed to tell them apart
    page = F.xxhash64("text")
    held = F.filter(F.transform(_lines(F.col("text")), normal_line), lambda x: x != "")
    lines = F.array_distinct(F.transform(held, lambda x: F.xxhash64(x)))
    each = slim.select("host", page.alias("page"), F.explode(F.array_union(F.array(F.lit(None).cast("long")), lines)).alias("line"))
    # the null "line" stands for the page itself and counts the host's pages in the same aggregation
    counts = each.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return counts


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have any."""
    counts = line_shares(docs, host_col, text_col)
    counts = checkpointed(counts.where((F.col("n") >= min_pages) | F.col("line").isNull()))
    total = counts.where("line IS NULL").select(F.col("host").alias("h"), F.col("n").alias("n_host"))
    hit = counts.where("line IS NOT NULL").join(total, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("n_host"))
    return hit.select("host", "line", "n", "n_host")


def drop_boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, drop_empty: bool = False, host_col: str = "source", text_col: str = "text", with_counts: bool = False, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``docs`` with its boilerplate lines dropped from ``text_col``; ``n_chars``, if there is one, follows
    the text.  ``with_counts`` adds ``dropped_lines``."""
    listed = checkpointed(boilerplate(docs, ratio, min_pages, host_col, text_col))
    columns, kinds = docs.columns, {f.name: f.dataType for f in docs.schema.fields}
    # the row travels as one struct, so that its columns may have any names
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{host_col}`").cast("string").alias("own_host"), F.col(f"`{text_col}`").cast("string").alias("own_text"))
    if listed.count() <= broadcast_rows:
        lists = listed.groupBy(F.col("host").alias("h")).agg(F.collect_set("line").alias("bad"))
        joined = own.join(F.broadcast(lists), F.col("own_host").eqNullSafe(F.col("h")), "left")
    else:
        # by text: a host's list is not copied to all its pages, and a hot host is spread by its lines
        keyed = own.select(F.col("own_host").alias("h"), F.xxhash64("own_text").alias("page"), F.explode(F.array_distinct(F.transform(_lines(F.col("own_text")), line_key))).alias("own_line"))
        hits = keyed.join(listed, F.col("h").eqNullSafe(F.col("host")) & (F.col("own_line") == F.col("line")))
        hits = hits.groupBy("h", "page").agg(F.collect_set("own_line").alias("bad"))
        joined = own.join(hits, F.col("own_host").eqNullSafe(F.col("h")) & (F.xxhash64("own_text") == F.col("page")), "left")
    lines = _lines(F.col("own_text"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("bad"), line_key(x)))
    out = joined.select("row", "own_text", F.when(F.col("bad").isNotNull(), kept).alias("kept"), F.size(lines).alias("n_lines"))
    touched = F.coalesce(F.size("kept") < F.col("n_lines"), F.lit(False)) & F.col("kept").isNotNull()
    if drop_empty:
        out = out.where(~touched | F.exists("kept", lambda x: F.trim(x) != ""))
    new_text = F.when(touched, F.array_join("kept", "\n")).otherwise(F.col("own_text"))
    cells = []
    for c in columns:
        if c == text_col:
            cells.append(new_text.alias(c))
        elif c == "n_chars":
            cells.append(F.when(touched, F.length(new_text).cast(kinds[c])).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            cells.append(F.col(f"row.`{c}`").alias(c))
    if with_counts:
        cells.append(F.when(touched, F.col("n_lines") - F.size("kept")).otherwise(F.lit(0)).alias("dropped_lines"))
    return out.select(*cells)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, with_counts=True)


SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS n_host FROM pages GROUP BY source),
held AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(x))), lambda x: x <> ''))) AS line FROM pages),
bad AS (SELECT h.source, h.line FROM held h JOIN total t ON h.source IS NOT DISTINCT FROM t.source
        GROUP BY h.source, h.line, t.n_host HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * t.n_host),
lists AS (SELECT source, list(line) AS lines FROM bad GROUP BY source),
j AS (SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS parts, coalesce(l.lines, []) AS lines
      FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
k AS (SELECT *, list_filter(parts, lambda x: trim(x) = '' OR NOT list_contains(lines, lower(trim(x)))) AS kept FROM j)
SELECT doc_id, source, CASE WHEN len(kept) < len(parts) THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text,
       CAST(CASE WHEN len(kept) < len(parts) THEN len(parts) - len(kept) ELSE 0 END AS INTEGER) AS dropped_lines FROM k
"""
