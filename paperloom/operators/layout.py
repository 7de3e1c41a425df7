"""Statistics and lookups on layout rows: spans, blocks, bookmarks, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import broken_heading_candidates, usable_labels
from ..functions.pages import sampled
from ..functions.regexkit import strip

BOLD_FLAG = 16
NOISE_SHARE = 0.6
BAND, MIN_HITS, HIT_SHARE, MAX_KEY = 0.15, 2, 0.6, 120


def emphasis_coverage(spans: DataFrame, pages: DataFrame, sample: int = 12) -> DataFrame:
    """(doc_id, coverage): share of bold characters on sampled pages; 0 without text.
    spans (doc_id, page, text, flags), pages (doc_id, pages: how many)."""
    n = F.length(strip(F.col("text")))
    rows = spans.join(pages, "doc_id").filter(sampled(F.col("page"), F.col("pages"), sample))
    shares = rows.groupBy("doc_id").agg((F.sum(F.when(F.col("flags").bitwiseAND(BOLD_FLAG) != 0, n).otherwise(0)) / F.nullif(F.sum(n), F.lit(0))).alias("coverage"))
    return pages.select("doc_id").join(shares, "doc_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def strips_emphasis(mode: str | Column, coverage: Column) -> Column:
    """auto: only where nearly everything is bold; strip; keep."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "auto", coverage > NOISE_SHARE).otherwise(mode == "strip")


def suggest_margins(blocks: DataFrame, pages: DataFrame, sample: int = 12) -> DataFrame:
    """(doc_id, top, bottom) from lines that recur near the edges of sampled pages.
    blocks (doc_id, page, page_h, y0, y1, text); under three pages: no margins."""
    step = F.greatest(F.lit(1), F.floor(F.col("pages") / sample))
    n_sampled = F.least(F.lit(sample), F.ceil(F.col("pages") / step))
    limit = F.greatest(F.lit(MIN_HITS), F.floor(n_sampled * HIT_SHARE).cast("int"))
    key = F.regexp_replace(strip(F.regexp_replace("text", r"(?U)\s+", " ")), r"(?U)\d+", "#")
    inside = (F.col("y0") > F.col("page_h") * BAND) & (F.col("y1") < F.col("page_h") * (1 - BAND))
    rows = blocks.join(pages.withColumn("limit", limit), "doc_id").filter((F.col("pages") >= 3) & sampled(F.col("page"), F.col("pages"), sample) & ~inside)
    high, low = F.col("y1") < F.col("page_h") * BAND, F.col("y0") > F.col("page_h") * (1 - BAND)
    keys = rows.withColumn("key", key).filter((F.col("key") != "") & (F.length("key") <= MAX_KEY)).groupBy("doc_id", "key").agg(
        F.count("*").alias("hits"), F.first("limit").alias("limit"),
        F.max(F.when(high, F.col("y1") + 2)).alias("top"), F.max(F.when(~high & low, F.col("page_h") - F.col("y0") + 2)).alias("bottom"),
    )
    found = keys.filter("hits >= limit").groupBy("doc_id").agg(F.max("top").alias("top"), F.max("bottom").alias("bottom"))
    edge = lambda c: F.bround(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), 1).alias(c)
    return pages.select("doc_id").join(found, "doc_id", "left").select("doc_id", edge("top"), edge("bottom"))


def header_level(toc_level: Column, font_level: Column, has_toc: Column, mode: str = "hybrid") -> Column:
    """Heading level of a line: bookmarks first, then font sizes (deep ones not where there are
    bookmarks); 0 is body text."""
    by_font = F.when(has_toc & (font_level > 3), 0).otherwise(F.coalesce(font_level, F.lit(0)))
    hit = F.coalesce(toc_level, F.lit(0)) > 0
    return F.when(hit & F.lit(mode != "fontsize"), toc_level).when(F.lit(mode == "toc"), 0).otherwise(by_font)


def broken_headings(headings: DataFrame, toc: DataFrame) -> DataFrame:
    """Headings (doc_id, page, heading) with bookmarks (doc_id, page, level, title) they begin."""
    return headings.join(toc, ["doc_id", "page"]).filter(broken_heading_candidates(F.col("heading"), F.col("title")))


def figure_labels(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, labels array<array<string>>) in figure order, from text lines (ord, text,
    x0, y0, x1, y1) that lie in a figure's box. Boxes and lines meet by page only."""
    within = (F.col("l.x0") >= F.col("f.x0")) & (F.col("l.x1") <= F.col("f.x1")) & (F.col("l.y0") >= F.col("f.y0")) & (F.col("l.y1") <= F.col("f.y1"))
    f, t = figures.alias("f"), lines.alias("l")
    hits = f.join(t, (F.col("f.doc_id") == F.col("l.doc_id")) & (F.col("f.page") == F.col("l.page")) & within, "left")
    each = hits.groupBy("f.doc_id", "f.page", "f.idx").agg(F.array_sort(F.collect_list(F.when(F.col("l.text").isNotNull(), F.struct("l.ord", "l.text")))).alias("x"))
    each = each.select("doc_id", "page", "idx", usable_labels(F.transform("x", lambda x: x["text"])).alias("labels"))
    return each.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "labels"))), lambda x: x["labels"]).alias("labels"))


def line_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, extra, lines_a, lines_b, agreement) of two sets of lines (line), as
    multisets of trimmed non-empty lines."""
    tidy = lambda df: df.select(strip(F.col("line")).alias("line")).filter("line <> ''")
    counts = lambda df, name: tidy(df).groupBy("line").agg(F.count("*").alias(name))
    both = counts(a, "n").join(counts(b, "m"), "line", "full_outer").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    out = both.agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))), F.lit(0)).alias("extra"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines_a"), F.coalesce(F.sum("m"), F.lit(0)).alias("lines_b"),
    )
    return out.withColumn("agreement", 1 - F.greatest("missing", "extra") / F.greatest("lines_a", "lines_b", F.lit(1)))


def reading_order(shapes: DataFrame, height: Column) -> DataFrame:
    """shapes with place: rank by row (a twentieth of the slide's height), then left to right;
    what has no position comes last, ties keep their drawing order z."""
    row = F.floor(F.col("y") / F.greatest(F.lit(1), F.floor(height * 0.05)))
    return shapes.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "slide_no").orderBy(*(F.asc_nulls_last(c) for c in (row, "x", "z")))))
