"""Line deduplication by site-relative frequency: the share of a host's pages that contain a line;
lines above a boilerplate ratio are dropped. Only DataFrame functions are used.

Lines are counted by a 64-bit hash first, so that unique lines, which are nearly all, are shuffled
as two numbers. Equal hashes can only raise a count; the few lines that reach the ratio are counted
again by their text, so the result is exact. Those lines are few for each host by arithmetic: at
most the mean number of lines of its pages divided by the ratio.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.scratch import Scratch

RATIO = 0.1
MIN_PAGES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _page_lines(pages: DataFrame) -> Column:
    """Distinct lines of a page that are not blank."""
    return F.array_distinct(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""))


def _too_common(counted: DataFrame, totals: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """Lines on at least ``min_pages`` pages and on more than ``ratio`` of the host's pages."""
    joined = counted.where(F.col("pages") >= min_pages).join(
        totals.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host"))
    )
    return joined.where(F.col("pages") > F.lit(ratio) * F.col("total"))


def boilerplate(pages: DataFrame, scratch: Scratch, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """For each host with boilerplate: host and the array ``lines`` to be dropped. ``pages`` has
    host and text."""
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    each = pages.select("host", F.explode(_page_lines(pages)).alias("line"))
    hashed = each.groupBy("host", F.xxhash64("line").alias("hash")).agg(F.count("*").alias("pages"))
    likely = scratch.keep(
        _too_common(hashed, totals, ratio, min_pages).groupBy("host").agg(F.collect_set("hash").alias("hashes")),
        "likely",
    ).withColumnRenamed("host", "of_host")
    again = (
        pages.join(likely, F.col("host").eqNullSafe(F.col("of_host")))
        .select("host", F.explode(F.filter(
            _page_lines(pages), lambda x: F.array_contains(F.col("hashes"), F.xxhash64(x))
        )).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("pages"))
    )
    found = _too_common(again, totals, ratio, min_pages)
    return scratch.keep(found.groupBy("host").agg(F.collect_set("line").alias("lines")), "boilerplate")


def drop_boilerplate(
    pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True,
) -> DataFrame:
    """All columns and rows of ``pages`` with the text's boilerplate lines left out, and with ``counts``
    the columns ``n_lines`` and ``n_dropped`` (they replace columns of these names).

    A page counts once for a line, however often it has it. Blank lines are neither counted nor
    dropped. Repeated rows are pages of their own. Pages with a null host form one site. A null
    text stays null with no lines; an empty text has one blank line. A line that is on fewer than
    ``min_pages`` pages stays, so a site of one or two pages keeps all; a share equal to the ratio
    stays too. No pages give no pages."""
    scratch = Scratch(pages.sparkSession, "lines")
    found = boilerplate(pages.select(F.col(host).alias("host"), F.col(text).alias("text")), scratch, ratio, min_pages)
    kept = [c for c in pages.columns if not counts or c not in ("n_lines", "n_dropped")]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"))
    of = lambda name: F.col("page").getField(name)
    joined = packed.join(found, of(host).eqNullSafe(F.col("host")), "left")
    split = lines_of(of(text))
    drop = F.coalesce(F.col("lines"), F.array().cast("array<string>"))
    joined = joined.withColumn("stay", F.filter(split, lambda x: ~F.array_contains(drop, x)))
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    n_kept = F.coalesce(F.size("stay"), F.lit(0)).cast("long")
    cleaned = [(F.array_join("stay", "\n") if c == text else of(c)).alias(c) for c in kept]
    if not counts:
        return joined.select(*cleaned)
    none = F.when(of(text).isNull(), F.lit(0).cast("long"))
    return joined.select(*cleaned, none.otherwise(n_lines).alias("n_lines"), none.otherwise(n_lines - n_kept).alias("n_dropped"))
