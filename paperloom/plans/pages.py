"""Laid-out pages (a PDF extractor's rows) to finished units.

An extractor gives each page's Markdown twice: with vector graphics read as pictures, and
without. The page plan picks the pass that lost no text, cleans it, repairs headings by
bookmarks, drops tables that are none, renames figures, writes their labels below them and says
what to look at. Everything is a join by (doc_id, page) or an expression over one page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.masking import masked_front_matter
from ..functions.pages import Options
from ..functions.regexkit import strip
from ..operators import layout, units
from .convert import with_margins


@dataclass
class Layout:
    """What an extractor knows.

    docs (doc_id, slug); passes (doc_id, unit_no, marked, plain, visible, has_ink, tables,
    plain_tables): Markdown with and without vector graphics, characters that can be seen, and
    tables found; spans (doc_id, page, text, flags); toc (doc_id, page, ord, level, title);
    figures (doc_id, page, idx, x0, y0, x1, y1); lines (doc_id, page, ord, text, x0, ...)."""

    docs: DataFrame
    passes: DataFrame
    spans: DataFrame
    toc: DataFrame
    figures: DataFrame
    lines: DataFrame


def chosen_pass(ignore_graphics: bool) -> dict[str, Column]:
    """The pass without graphics where the other lost text and this one has more."""
    size = lambda c: F.length(strip(F.coalesce(c, F.lit(""))))
    again = units.lost_text(size("marked"), F.col("visible")) & (size("plain") > size("marked"))
    again = F.lit(False) if ignore_graphics else again
    use_plain = F.lit(True) if ignore_graphics else again
    pick = lambda a, b: F.when(use_plain, F.col(a)).otherwise(F.col(b))
    return {"text_recovered": again, "markdown": F.coalesce(pick("plain", "marked"), F.lit("")), "found": F.coalesce(pick("plain_tables", "tables"), F.lit(0))}


def stripped(spans: DataFrame, docs: DataFrame, passes: DataFrame, options: Options) -> DataFrame:
    """(doc_id, slug, coverage, strip): whether bold marks go, by the share of bold text."""
    pages = passes.groupBy("doc_id").agg(F.max("unit_no").alias("pages"))
    shares = layout.emphasis_coverage(spans, pages)
    out = docs.join(shares, "doc_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return out.withColumn("strip", layout.strips_emphasis(options.emphasis, F.col("coverage")))


def finish(rows: Layout, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Units (doc_id, unit_no, title, markdown, warnings, chars, tables, heading_repairs,
    dropped_tables, text_recovered)."""
    toc = rows.toc.filter(strip(F.col("title")) != "").groupBy("doc_id", F.col("page").alias("unit_no")).agg(F.array_sort(F.collect_list(F.struct("ord", "level", "title"))).alias("toc"))
    toc = toc.withColumn("toc", F.transform("toc", lambda e: F.struct(e["level"].cast("int").alias("level"), e["title"].alias("title"))))
    labels = layout.figure_labels(rows.figures, rows.lines).withColumnRenamed("page", "unit_no")
    out = rows.passes.join(stripped(rows.spans, rows.docs, rows.passes, options).select("doc_id", "slug", "strip"), "doc_id")
    out = out.join(toc, ["doc_id", "unit_no"], "left").join(labels, ["doc_id", "unit_no"], "left")
    out = out.withColumns(chosen_pass(options.ignore_graphics)).withColumn("markdown", md.clean_markup(F.col("markdown"), F.col("strip")))
    none = F.array().cast("array<struct<level:int,title:string>>")
    out = out.withColumn("r", md.repair_split_headings("markdown", F.coalesce("toc", none))).withColumns({"markdown": F.col("r.text"), "heading_repairs": F.col("r.repaired")})
    out = out.withColumn("x", md.drop_degenerate_tables(F.col("markdown"))).withColumns({"markdown": F.col("x.text"), "dropped_tables": F.col("x.dropped")})
    out = out.withColumn("markdown", md.rename_figure_links(F.col("markdown"), F.col("slug"), F.col("unit_no")))
    if options.figure_legends and not options.ignore_images:
        out = out.withColumn("markdown", F.when(F.col("labels").isNotNull(), md.annotate_figures(F.col("markdown"), F.col("labels"))).otherwise(F.col("markdown")))
    out = out.withColumn("markdown", strip(F.col("markdown"))).withColumn("tables", F.greatest(F.lit(0), F.col("found") - F.col("dropped_tables")).cast("int"))
    warnings = units.pdf_warnings(F.col("visible"), F.col("has_ink"), F.col("tables"), F.col("dropped_tables"), F.col("text_recovered"))
    return out.select("doc_id", "unit_no", F.lit("").alias("title"), "markdown", warnings.alias("warnings"), F.length("markdown").alias("chars"), "tables", "heading_repairs", "dropped_tables", "text_recovered")


def reader(extract: Callable[[DataFrame, Options], Layout]) -> Callable[[DataFrame, Options], DataFrame]:
    """An extractor as convert()'s pdf argument: files to finished units."""
    return lambda files, options: finish(extract(files, options), options).select("doc_id", "unit_no", "title", "markdown", "warnings")


def probe(rows: Layout, options: Options = Options(), margins: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(doc_id, pages, toc_entries, coverage, strip, margin_top, margin_bottom) without converting a
    page. margins (doc_id, top, bottom) are a user's; suggested ones need the heights of pages,
    which lines may carry as page_h."""
    pages = rows.passes.groupBy("doc_id").agg(F.max("unit_no").alias("pages"))
    entries = rows.toc.groupBy("doc_id").agg(F.count("*").alias("toc_entries"))
    out = pages.join(entries, "doc_id", "left").withColumn("toc_entries", F.coalesce("toc_entries", F.lit(0)))
    out = out.join(stripped(rows.spans, rows.docs, rows.passes, options).select("doc_id", "coverage", "strip"), "doc_id", "left")
    if "page_h" not in rows.lines.columns:
        return out.withColumns({"margin_top": F.lit(0.0), "margin_bottom": F.lit(0.0)})
    best = with_margins(layout.suggest_margins(rows.lines, pages), margins)
    return out.join(best.select("doc_id", F.col("top").alias("margin_top"), F.col("bottom").alias("margin_bottom")), "doc_id", "left")


def fronts(rows: Layout, about: DataFrame, options: Options = Options(), margins: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(doc_id, front) of documents, about (doc_id, name, title, author, creation, creator, producer,
    extractor) being what their files say of themselves."""
    d = probe(rows, options, margins).join(about, "doc_id").join(rows.docs, "doc_id")
    c = F.col
    front = units.pdf_front_matter(md.title_of(c("title"), c("slug")), c("name"), c("pages"), *(F.coalesce(k, F.lit("")) for k in ("author", "creation", "creator", "producer")), c("toc_entries"), c("extractor"), F.lit(options.heading_mode), c("coverage"), c("strip"))
    return d.select("doc_id", masked_front_matter(front, options.anonymize).alias("front"))
