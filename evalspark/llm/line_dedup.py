"""Operator 1, line dedup: site-relative line frequency.

For every host, the share of its pages that contain a line is the number of
such pages over the host's page total; lines above ``max_share`` are
boilerplate of that host and are dropped from its pages. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.staging import staged

MAX_SHARE = 0.3
SALTS = 32
#: Boilerplate keys of at most so many bytes in all go to every task; more of them meet pages dealt by host and salt.
BROADCAST_BYTES = 16 * 1024 * 1024

#: Elements whose content is not text, and tags that end a line. Fixed values.
_HIDDEN = r"(?is)<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>|<!--.*?-->"
_BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|br|div|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|td|th|tr|ul)(?:\s[^>]*)?/?>"
_TAG = r"(?s)<[a-zA-Z/!][^>]*>"


def html_lines(html: Column) -> Column:
    """Text of an HTML page with one line for each block element; tags dropped, entities left as they are."""
    text = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BREAK, "\n")
    return F.regexp_replace(text, _TAG, "")


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    """Lines are compared without spaces at either end; a line of spaces only has no key."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare))


def boilerplate_lines(df: DataFrame, host: str, text: str, max_share: float = MAX_SHARE,
                      copies_once: bool = False) -> DataFrame:
    """One row per host with boilerplate: ``host`` and the array ``keys`` of its line keys.

    A page counts once for a line, however often it holds it; a line of one
    page only is never boilerplate. The array is bounded: a host has at most (mean
    distinct lines of its pages) / max_share lines above max_share.
    With ``copies_once`` pages of a host with equal texts count as one page,
    so that copies of a page do not make its lines boilerplate.
    """
    keys = F.array_distinct(F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n"), line_key), lambda k: k.isNotNull()))
    pages = df.where(F.col(f"`{host}`").isNotNull()).select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"),
                                                            F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
    found = pages.select("host", F.explode("keys").alias("key"), *([F.xxhash64("text").alias("copy")] if copies_once else []))
    counts = (found.distinct() if copies_once else found).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    # page totals need no text; copies of them spread the lines of a hot host over SALTS tasks
    each = df.select(F.col(f"`{host}`").alias("host"), *([F.xxhash64(f"`{text}`").alias("copy")] if copies_once else []))
    if copies_once:
        each = each.distinct()
    totals = (each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    return (counts.where("n > 1").withColumn("salt", salt).join(totals, ["host", "salt"])
            .where(F.col("n") > F.lit(float(max_share)) * F.col("pages"))
            .groupBy("host").agg(F.collect_list("key").alias("keys")))


def drop_boilerplate(df: DataFrame, host: str, text: str, max_share: float = MAX_SHARE, copies_once: bool = False,
                     broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with its boilerplate lines dropped from ``text``, plus ``n_lines`` and ``n_dropped``.

    Rows with a null host are kept as they are (no site to compare with),
    and so are null texts (0 lines). Kept lines stay in order, unchanged;
    lines of spaces only always stay. Repeated rows count as pages of their
    own (with ``copies_once`` equal texts of a host count once) and are all
    kept. Input columns named n_lines or n_dropped are
    replaced.
    """
    bad = staged(boilerplate_lines(df, host, text, max_share, copies_once), "boilerplate").select(
        F.col("host").alias("__host"), F.col("keys").alias("__bad"))
    size = bad.agg(F.sum(F.octet_length("__host") + 64 * F.size("__bad"))).first()[0] or 0
    pages, on = df.drop("n_lines", "n_dropped"), F.col(f"`{host}`") == F.col("__host")
    if size <= broadcast_bytes:  # no page is shuffled
        joined = pages.join(F.broadcast(bad), on, "left")
    else:  # the pages of a hot host are spread over the salts
        salted = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64(f"`{text}`"), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("__own", own).join(salted, on & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    lines = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(F.col("__lines"), lambda x: F.coalesce(~F.array_contains(F.col("__bad"), line_key(x)), F.lit(True)))
    out = (joined.withColumn("__lines", lines)
           .withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(kept))
           .withColumn("n_lines", F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size("__lines")))
           .withColumn("n_dropped", F.when(F.col(f"`{text}`").isNull(), 0)
                       .otherwise(F.size("__lines") - F.size("__kept")))
           .withColumn(text, F.when(F.col("n_dropped") == 0, F.col(f"`{text}`"))
                       .otherwise(F.array_join("__kept", "\n"))))
    return out.drop("__host", "__bad", "__lines", "__kept")


def dedup_pages(pages: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the remaining text of every raw HTML page."""
    lines = pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return drop_boilerplate(lines, "host", "text", max_share)
