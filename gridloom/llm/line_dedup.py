"""Line dedup by site-relative frequency.

A line's ratio is the number of pages of a host that contain it over the number of the host's pages. Lines above the
boilerplate ratio are dropped from all pages of that host. Lines are compared without outer blanks; how often a page
repeats a line doesn't count. Counts are over all pages.

Cases: a null text stays null and counts as a page of its host; an empty text stays empty; a text whose lines all go
becomes empty, and its row stays. Blank lines are kept. Pages of a null host are one host. The ratio alone decides, also
on small hosts, but a line that is on one page of its host only is no repetition and stays. A ``count_col`` that the
table has already is replaced. Texts of any length are taken whole; repeated rows count as pages of their own; an empty table gives an empty one; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_BYTES, durable

#: Share of a host's pages beyond which a line is boilerplate, and how many pages make a repetition.
RATIO, MIN_PAGES = 0.03, 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line, as two longs."""
    t = F.trim(line)
    return F.struct(F.xxhash64(t).alias("h"), F.xxhash64(t, F.lit(1)).alias("g"))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h, g, n_pages, n_host) of the lines above the ratio."""
    base = docs.select(docs[host_col].alias("host"), docs[text_col].alias("text"))
    hosts = base.groupBy("host").agg(F.count("*").alias("n_host"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = base.select("host", F.explode(keys).alias("k")).groupBy("host", "k.h", "k.g").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    # the hosts are a small table next to the lines; adaptive execution broadcasts it by its measured size
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).where(F.col("n_pages") > F.lit(ratio) * F.col("n_host")).select(counts["host"], "h", "g", "n_pages", "n_host")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_col: str | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text; ``count_col``, if given, gets how many went."""
    lines = durable(boilerplate(docs, text_col, host_col, ratio, min_pages).select("host", "h", "g"))
    # at most (lines a page) / ratio lines a host
    if lines.count() * 40 <= BROADCAST_BYTES:
        bad = lines.groupBy("host").agg(F.collect_set(F.struct("h", "g")).alias("_gl_bad"))
        side = F.broadcast(bad.withColumnRenamed("host", "_gl_host"))
        joined = docs.join(side, docs[host_col].eqNullSafe(side["_gl_host"]), "left")
    else:
        # by page, not by host: what goes from a text hangs on the host and the text alone
        mark = [F.xxhash64(docs[text_col]), F.xxhash64(docs[text_col], F.lit(1))]
        keys = docs.select(docs[host_col].alias("host"), mark[0].alias("m"), mark[1].alias("n"), F.explode(F.array_distinct(F.transform(_lines(docs[text_col]), _key))).alias("k"))
        hit = keys.join(lines, keys["host"].eqNullSafe(lines["host"]) & (F.col("k.h") == lines["h"]) & (F.col("k.g") == lines["g"])).select(keys["host"], "m", "n", "k")
        side = hit.groupBy(F.col("host").alias("_gl_host"), F.col("m").alias("_gl_m"), F.col("n").alias("_gl_n")).agg(F.collect_set("k").alias("_gl_bad"))
        joined = docs.join(side, docs[host_col].eqNullSafe(side["_gl_host"]) & (mark[0] == side["_gl_m"]) & (mark[1] == side["_gl_n"]), "left")
    text, bad = docs[text_col], side["_gl_bad"]
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _key(x)))
    clean = F.when(text.isNull() | bad.isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [clean.alias(c) if c == text_col else docs[c] for c in docs.columns if c != count_col]
    if count_col:
        gone = F.filter(_lines(text), lambda x: (F.trim(x) != "") & F.array_contains(bad, _key(x)))
        out.append(F.when(text.isNull() | bad.isNull(), F.lit(0)).otherwise(F.size(gone)).alias(count_col))
    return joined.select(*out)
