"""Units (pages, sections, slides) and documents: edits, assembly, front matter, reports.

A unit is a row (doc_id, unit_no, markdown, warnings, masked, ...); a document is what its
units add up to. Grouping is by document, ordering by an explicit number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import messages
from ..functions import masking
from ..functions.markdown import csv_cell, figure_links
from ..functions.regexkit import rstrip, yaml_quoted
from ..messages import REPORT, REVIEW_REPORT, UNIT_OF  # noqa: F401

SPARSE_CHARS = 60
RETRY_SHARE, RETRY_CHARS = 0.75, 200
STRETCH = 10_000


def unit_of(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in UNIT_OF.items() for x in kv))[kind]


# --- edits and review --------------------------------------------------------------------


def with_edits(units: DataFrame, edits: DataFrame) -> DataFrame:
    """units with a reviewer's edits (doc_id, unit_no, edited, reviewed): text is what holds."""
    out = units.join(edits.select("doc_id", "unit_no", "edited", "reviewed"), ["doc_id", "unit_no"], "left")
    return out.withColumn("text", F.coalesce("edited", "markdown")).withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def next_warned(units: DataFrame) -> DataFrame:
    """For each unit the nearest units with warnings before and after it: within its stretch of unit
    numbers by one pass up and one down, else from the nearest stretch that has any. So a long
    document is shared out, and no pass looks ahead over the rest of it."""
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    sides = lambda by, n: (before(by.orderBy(F.asc_nulls_last(n))), before(by.orderBy(F.desc_nulls_first(n))))
    warned = F.when(F.size("warnings") > 0, F.col("unit_no"))
    rows = units.withColumn("stretch", F.floor(F.col("unit_no") / STRETCH))
    up, down = sides(Window.partitionBy("doc_id", "stretch"), "unit_no")
    near = rows.withColumns({"previous_warned": F.last(warned, True).over(up), "next_warned": F.last(warned, True).over(down)})
    edges = rows.groupBy(F.col("doc_id").alias("d"), F.col("stretch").alias("s")).agg(F.max(warned).alias("last"), F.min(warned).alias("first"))
    up, down = sides(Window.partitionBy("d"), "s")
    edges = edges.select("d", "s", F.last("last", True).over(up).alias("p"), F.last("first", True).over(down).alias("n"))
    out = near.join(edges, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("stretch").eqNullSafe(F.col("s")), "left")
    return out.withColumns({"previous_warned": F.coalesce("previous_warned", "p"), "next_warned": F.coalesce("next_warned", "n")}).drop("stretch", "d", "s", "p", "n")


# --- warnings ----------------------------------------------------------------------------


def pdf_warnings(raw_chars: Column, has_ink: Column, tables: Column, dropped: Column, recovered: Column) -> Column:
    say = lambda text, c: F.replace(F.lit(text), F.lit("{n}"), c.cast("string"))
    return F.array_compact(F.array(
        F.when((raw_chars == 0) & has_ink, F.lit(messages.SCANNED))
        .when((raw_chars < SPARSE_CHARS) & has_ink, say(messages.SPARSE, raw_chars)),
        F.when(tables > 0, say(messages.TABLES_FOUND, tables)),
        F.when(dropped > 0, say(messages.TABLES_DROPPED, dropped)),
        F.when(recovered, F.lit(messages.TEXT_RECOVERED)),
    ))


def lost_text(extracted: Column, visible: Column) -> Column:
    """Whether a page yielded so little of its visible text that it should be done again."""
    return (visible >= RETRY_CHARS) & (extracted < RETRY_SHARE * visible)


# --- assembly ----------------------------------------------------------------------------


def front_matter(kind: Column, fields: Sequence[tuple[str, Column, bool]]) -> Column:
    """YAML lines of (name, value, quoted); null values have no line."""
    line = lambda name, value, quoted: F.concat(F.lit(f"{name}: "), yaml_quoted(value) if quoted else value)
    return F.concat_ws("\n", F.lit("---"), *(line(*f) for f in fields), F.lit("---"))


def office_front_matter(title: Column, source: Column, kind: Column, units: Column, author: Column, created: Column, modified: Column, notes: bool = True) -> Column:
    given = lambda name, v: F.when(F.trim(v) != "", F.concat(F.lit(f"{name}: "), yaml_quoted(v)))
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), yaml_quoted(title)), F.concat(F.lit("source_file: "), yaml_quoted(source)),
        F.concat(unit_of(kind), F.lit("s: "), units.cast("string")),
        given("author", author), given("created", created), given("modified", modified),
        F.concat(F.lit("extracted_with: "), yaml_quoted(F.concat(kind, F.lit("_convert (stdlib)")))),
        F.when(kind == "pptx", F.lit(f"speaker_notes: {str(notes).lower()}")), F.lit("---"),
    )


def pdf_front_matter(title: Column, source: Column, pages: Column, author: Column, creation: Column, creator: Column, producer: Column, toc: Column, extractor: Column, heading_mode: Column, coverage: Column, stripped: Column) -> Column:
    given = lambda name, v: F.when(v != "", F.concat(F.lit(f"{name}: "), yaml_quoted(v)))
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), yaml_quoted(title)), F.concat(F.lit("source_file: "), yaml_quoted(source)),
        F.concat(F.lit("pages: "), pages.cast("string")),
        given("author", author), given("creationdate", creation), given("creator", creator), given("producer", producer),
        F.concat(F.lit("toc_entries: "), toc.cast("string")), F.concat(F.lit("extracted_with: "), yaml_quoted(extractor)),
        F.concat(F.lit("heading_mode: "), yaml_quoted(heading_mode)), F.concat(F.lit("bold_coverage: "), F.format_string("%.3f", coverage)),
        F.concat(F.lit("emphasis_stripped: "), stripped.cast("string")), F.lit("---"),
    )


def assemble(units: DataFrame, *, text: str = "text", unit: str | Column = "page", separators: bool = True, front: DataFrame | None = None) -> DataFrame:
    """(doc_id, document): front matter, then the units in order with their separators.

    A document is one row in the end, so gathering its units is bound by what it holds."""
    name = F.lit(unit) if isinstance(unit, str) else unit
    mark = F.concat(F.lit("<!-- "), name, F.lit(" "), F.col("unit_no").cast("string"), F.lit(" -->"))
    part = F.concat_ws("\n\n", F.when(F.lit(separators), mark), F.nullif(F.col(text), F.lit("")))
    docs = units.select("doc_id", "unit_no", part.alias("part")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "part"))).alias("parts"))
    body = F.filter(F.transform("parts", lambda p: p["part"]), lambda p: p != "")
    if front is None:
        return docs.select("doc_id", F.concat(rstrip(F.array_join(body, "\n\n")), F.lit("\n")).alias("document"))
    docs = front.select("doc_id", "front").join(docs, "doc_id", "left")
    whole = F.concat(F.array("front"), F.coalesce(body, F.array().cast("array<string>")))
    return docs.select("doc_id", F.concat(rstrip(F.array_join(whole, "\n\n")), F.lit("\n")).alias("document"))


def mask_units(units: DataFrame, categories: Iterable[str], *, text: str = "markdown", streets: Sequence[str] = ()) -> DataFrame:
    """units with masked text, their counts and their new length."""
    wanted = masking.checked(categories)
    if not wanted:
        return units
    out = units.withColumn("_m", masking.mask(F.col(text), wanted, streets))
    return out.withColumns({text: F.col("_m.text"), "masked": F.col("_m.counts"), "chars": F.length("_m.text")}).drop("_m")


# --- totals and reports ------------------------------------------------------------------


def mask_totals(units: DataFrame) -> DataFrame:
    """(doc_id, masked map, summary), documents without hits too."""
    totals = units.select("doc_id", F.explode("masked").alias("key", "n")).groupBy("doc_id", "key").agg(F.sum("n").cast("int").alias("n"))
    maps = totals.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("masked"))
    out = units.select("doc_id").distinct().join(maps, "doc_id", "left")
    out = out.withColumn("masked", F.coalesce("masked", F.create_map().cast("map<string,int>")))
    return out.withColumn("summary", masking.summary(F.col("masked")))


def counters(units: DataFrame) -> DataFrame:
    """Per document: units, warned, reviewed, edited, characters."""
    edited = F.col("edited").isNotNull() & (F.col("edited") != F.col("markdown"))
    return units.groupBy("doc_id").agg(
        F.count("*").alias("converted"), F.count_if(F.size("warnings") > 0).alias("warned"), F.count_if("reviewed").alias("reviewed"),
        F.count_if(edited).alias("edited"), F.sum(F.length("text")).alias("chars"),
    )


def unique_folders(files: DataFrame, base: str = "base", kind: str = "kind", order: str = "ord") -> DataFrame:
    """Folder names by first fit, as the sequential rule gives them: a name in use gets the
    kind, then 2, 3 and so on. Only names that occur twice, or look as if they had been given
    so, can meet another; the rule goes over those on the driver, all others keep their name."""
    times = files.groupBy(F.col(base).alias("_b")).agg(F.count("*").alias("_n"))
    marked = files.join(times, F.col(base) == F.col("_b")).withColumn("_meets", (F.col("_n") > 1) | F.col(base).rlike(r"-(?:pdf|docx|pptx)(?:-[0-9]+)?$")).drop("_b", "_n")
    used: set[str] = set()
    out = []
    for row in marked.filter("_meets").select(order, base, kind).orderBy(order).toLocalIterator():
        name = row[1] if row[1] not in used else f"{row[1]}-{row[2]}"
        folder, n = name, 2
        while folder in used:
            folder, n = f"{name}-{n}", n + 1
        used.add(folder)
        out.append((row[0], folder))
    named = files.sparkSession.createDataFrame(out, f"{order} {dict(files.dtypes)[order]}, folder string")
    alone = marked.filter(~F.col("_meets")).drop("_meets")
    return alone.withColumn("folder", F.col(base)).unionByName(marked.filter("_meets").drop("_meets").join(named, order))


def first_warnings(units: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, nr, unit_no, warning): the first warnings of each document in order of its units."""
    each = units.select("doc_id", "unit_no", F.posexplode("warnings").alias("at", "warning"))
    nr = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no", "at"))
    return each.withColumn("nr", nr).filter(F.col("nr") <= most).select("doc_id", "nr", "unit_no", "warning")


def csv_lines(rows: DataFrame, names: Sequence[str], *more: Column) -> DataFrame:
    """(line, more): one report row, cells guarded against formulas and quoted where needed."""
    cells = [csv_cell(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))) for n in names]
    return rows.select(F.concat_ws(";", *cells).alias("line"), *more)


def report_bytes(rows: DataFrame, names: Sequence[str], *order: str) -> bytes:
    """The report as spreadsheets read it: byte-order mark, semicolons, CRLF. One row a document."""
    cells = csv_lines(rows.orderBy(*order), names).toLocalIterator()
    return ("﻿" + "".join(line + "\r\n" for line in [";".join(names), *(r.line for r in cells)])).encode()


def referenced_figures(figures: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Figures (doc_id, path, ...) that their document's text still links to."""
    links = documents.select("doc_id", F.explode(figure_links(F.col(text))).alias("path"))
    return figures.join(links, ["doc_id", "path"], "left_semi")
