"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than a share of the host's pages hold
it, and at least ``min_pages`` of them do.  The share falls with the length of
the line (``SHARES``): short lines repeat by chance, long ones do not.  Pages of
equal text count as one page, so that a page with many copies is not taken for
boilerplate.  Boilerplate lines are dropped, the others stay in their order.
Lines are told apart by their MD5, blank ones always stay.

What is counted are distinct (host, page text, line) digests, 40 bytes each; a
line that a third of all pages hold is many such rows, summed in each task
before the second shuffle.  A host's boilerplate has at most (distinct lines of
its pages) / (smallest share * pages) lines, the average lines of a page over
the share, however many pages it has, so it travels as one array per host and
the pages themselves are not taken apart and put together again.  The join with
hosts is left to Spark: it broadcasts the arrays only if their table is small,
and splits a host that holds a large part of all pages.

Native throughout: DataFrame functions, no Python in the tasks.

Defined results: a null text stays null and has no lines; an empty text has one
blank line and stays empty; repeated rows are one page when lines are counted,
and all of them lose the same lines; a page of boilerplate alone is left with
its blank lines or an empty text; pages without a host are pages of one unnamed
host; a text of any length is one page; an empty table gives an empty one; input
columns named like result columns are replaced, other extra ones stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewake.llm.common import free_names, without
from bytewake.staging import Stage, as_is

#: (characters of a line at most, thousandths of a host's distinct pages that may hold it); None is any length
SHARES = ((20, 100), (200, 20), (None, 5))
MIN_PAGES = 3
RESULT = ["n_lines", "n_dropped"]
BLANK = r"^[\x20\x09-\x0D]*$"
#: a text of blank lines only
ALL_BLANK = r"\A[\x20\x09-\x0D]*\z"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def digest_of(line: Column) -> Column:
    return F.unhex(F.md5(line))


def may_hold(length: Column, shares: tuple[tuple[int | None, int], ...]) -> Column:
    """Thousandths of the pages that may hold a line of this length."""
    *shorter, (_, longest) = shares
    share = F.lit(longest)
    for up_to, thousandths in reversed(shorter):
        share = F.when(length <= up_to, thousandths).otherwise(share)
    return share.cast("long")


def boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", shares: tuple[tuple[int | None, int], ...] = SHARES,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, drop): digests of the lines to drop on each host that has any."""
    held = pages.select(F.col(host).alias("host"), F.col(text).alias("text"), digest_of(F.col(text)).alias("page"))
    totals = held.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    lines = held.select("host", "page", F.explode(F.array_distinct(lines_of(F.col("text")))).alias("line"))
    often = (
        lines.where(~F.col("line").rlike(BLANK))
        .select("host", "page", digest_of(F.col("line")).alias("line"), F.length("line").alias("length")).distinct()
        .groupBy("host", "line", "length").agg(F.count("*").alias("held_by"))
        .where(F.col("held_by") >= min_pages)
    )
    return (
        often.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .where(1000 * F.col("held_by") > may_hold(F.col("length"), shares) * F.col("pages"))
        .groupBy("host").agg(F.collect_list("line").alias("drop"))
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", shares: tuple[tuple[int | None, int], ...] = SHARES,
    min_pages: int = MIN_PAGES, prefix: str = "", stage: Stage = as_is,
) -> DataFrame:
    """Pages with boilerplate lines gone from their text, and the numbers of lines and of dropped ones.

    A ``stage`` lets Spark know the size of the sets of lines before it plans the join; small ones are then
    sent to the pages, which stay where they are.
    """
    names = [prefix + n for n in RESULT]
    known = without(pages, names)
    site, drop, kept = free_names(known, "_site", "_drop", "_kept")
    sets = stage(boilerplate(pages, host, text, shares, min_pages), "boilerplate").select(
        F.col("host").alias(site), F.col("drop").alias(drop))
    joined = known.join(sets, known[host].eqNullSafe(F.col(site)), "left")
    all_lines = lines_of(F.col(text))
    left = F.filter(all_lines, lambda line: ~F.array_contains(drop, digest_of(line)))
    changed = F.col(drop).isNotNull() & F.col(text).isNotNull()
    n_lines = F.coalesce(F.size(all_lines), F.lit(0))
    return joined.withColumns({
        kept: F.when(changed, left).otherwise(all_lines), names[0]: F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"),
    }).withColumns({
        names[1]: F.when(F.col(text).isNull(), 0).otherwise(n_lines - F.size(kept)).cast("long"),
        text: F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text)),
    }).select(*known.columns, *names)
