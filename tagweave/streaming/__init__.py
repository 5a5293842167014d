"""The same operators on streams.

Parsing, selecting, sanitising and editing are stateless, so the functions of
sources, plans and functions take a streaming frame as they take a batch. Here
is what needs a watermark: counts of matches over time, and re-crawled pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import local
from ..sources.html import parse_html, prefilter


def matches(pages: DataFrame, selector: str, *keys: str, html_col: str = "html") -> DataFrame:
    """(keys, n) for each match, row by row."""
    parsed = parse_html(pages.where(prefilter(F.col(html_col), selector)), html_col, selectors=[selector])
    return parsed.select(*keys, F.explode(local.select(F.col("dom"), selector)).alias("n"))


def windowed_counts(pages: DataFrame, selector: str, time_col: str, window: str, late: str, slide: str | None = None, html_col: str = "html") -> DataFrame:
    """(start, end, matches): late pages count until the watermark has passed."""
    timed = pages.withWatermark(time_col, late)
    found = matches(timed, selector, time_col, html_col=html_col)
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return found.groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("matches")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "matches")


def first_crawls(pages: DataFrame, url_col: str, time_col: str, late: str) -> DataFrame:
    """Each URL once within the watermark; the state holds URLs, not texts."""
    return pages.withWatermark(time_col, late).dropDuplicatesWithinWatermark([url_col])
