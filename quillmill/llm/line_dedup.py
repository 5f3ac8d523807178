"""Removal of lines that repeat across the pages of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.llm._shared import stage

#: Boilerplate lines (two hashes each) that are sent to every executor at most.
BROADCAST_BYTES = 16 << 20


def page_lines(html: Column) -> Column:
    """Lines of visible text: scripts, styles and comments go, block tags break lines.

    Lines are trimmed of ASCII white space; blank ones are left out. A null
    page has no lines. What opens and never closes stays text; it is not sought
    where nothing closes any more, so that the work is linear in the page.
    """
    out = X.without_elements(html, (("<script", r"\b", "</script>"), ("<style", r"\b", "</style>"), ("<!--", "", "-->")))
    out = X.replace_closed(out, r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>", (">",), "\n")
    out = X.replace_closed(out, r"<[^>]*>", (">",), "")
    return text_lines(out)


def text_lines(text: Column) -> Column:
    """Trimmed, non-blank lines of a text, in order; none for null."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\t\x0B-\r ]+|[\t\x0B-\r ]+$", ""))
    return F.filter(lines, lambda x: x != "")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without port and user, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def drop_site_lines(
    pages: DataFrame,
    id_col: str,
    host: Column,
    lines: Column,
    max_ratio: float = 0.3,
) -> DataFrame:
    """Drop lines that repeat on more than ``max_ratio`` of a host's pages.

    Pages are grouped by host; for each line the pages of the host that hold it
    (each page once, however often the line stands there) are divided by the
    host's page total. A line of a single page does not repeat and stays,
    however few pages its host has; so do pages without a host. Pages are
    parsed once: their lines are staged.

    Lines travel as two 64-bit hashes, one row for each page and distinct line,
    summed before the shuffle, so a line or host that everyone has is no hot
    key. A host has at most (mean distinct lines of a page) / ``max_ratio``
    boilerplate lines; they return to the pages as one array for each host, and
    no line is exploded again. Arrays of ``BROADCAST_BYTES`` together at most,
    which a count shows first, are broadcast and pages stay where they are;
    larger ones meet the pages in a join that adaptive execution may split.

    Returns ``id_col, host, n_lines, n_dropped, text`` for every page, with the
    kept lines joined by line feeds (an empty string if none is left). Null
    pages have no lines; very long ones are read whole; repeated rows count as
    pages of their own; an empty table gives no rows. Other columns are not
    read, so none can clash.
    """
    base = stage(pages.select(F.col(f"`{id_col}`").alias("__id"), host.alias("__host"), lines.alias("__lines")), "page-lines")
    hashed = F.transform(F.array_distinct("__lines"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    sited = base.filter(F.col("__host") != "")
    counts = (
        sited.select("__host", F.explode(hashed).alias("h"))
        .groupBy("__host", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > 1)
    )
    totals = sited.groupBy("__host").agg(F.count("*").alias("__total"))
    boiler = stage(
        counts.join(totals, "__host")
        .filter(F.col("__n") / F.col("__total") > max_ratio)
        .groupBy("__host")
        .agg(F.collect_list(F.struct("a", "b")).alias("__boiler")),
        "site-lines",
    )
    held = boiler.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("__boiler")), F.lit(0)).alias("lines")).collect()[0]
    small = held["hosts"] * 64 + held["lines"] * 16 <= BROADCAST_BYTES
    known = F.coalesce(F.col("__boiler"), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.filter("__lines", lambda x: ~F.array_contains(known, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    return (
        base.join(F.broadcast(boiler) if small else boiler, "__host", "left")
        .withColumn("__kept", F.when(F.col("__boiler").isNull(), F.col("__lines")).otherwise(kept))
        .select(
            F.col("__id").alias(id_col),
            F.col("__host").alias("host"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
            F.array_join("__kept", "\n").alias("text"),
        )
    )
