"""Whole conversions: files to units, documents, figures and a report, as one plan.

files -> format -> packages -> units -> masked units -> documents. Formats are branches that
are united; a file that cannot be converted is a row with its status. PDFs need an extractor
(a function of files to rows of pages); without one they are reported, not converted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import messages
from ..functions import markdown as md
from ..functions.masking import masked_front_matter
from ..functions.pages import Options, parse_pages
from ..operators import slides, units, word
from ..sources import docx, pptx
from ..sources.files import core_properties, with_format
from ..sources.stage import stage

UNIT_COLUMNS = ("doc_id", "kind", "unit_no", "title", "markdown", "warnings", "masked", "chars", "tables")


@dataclass
class Conversion:
    """files: one row each with kind, slug, title, status; units; figures (doc_id, path, bytes)."""

    files: DataFrame
    units: DataFrame
    figures: DataFrame
    options: Options

    def documents(self, edits: DataFrame | None = None) -> DataFrame:
        """(doc_id, document), edits of reviewers in place of what was converted."""
        rows = self.units.withColumn("text", F.col("markdown")) if edits is None else units.with_edits(self.units, edits)
        rows = rows.withColumn("unit", units.unit_of(F.col("kind")))
        return units.assemble(rows, unit=F.col("unit"), separators=self.options.page_separators, front=self.front())

    def front(self) -> DataFrame:
        counts = self.units.groupBy("doc_id").agg(F.count("*").alias("n"))
        rows = self.files.filter("status IS NULL").join(counts, "doc_id")
        text = units.office_front_matter(F.col("title"), F.col("name"), F.col("kind"), F.col("n"), F.col("props.author"), F.col("props.created"), F.col("props.modified"), self.options.speaker_notes)
        return rows.select("doc_id", masked_front_matter(text, self.options.anonymize).alias("front"))

    def report(self, *, ordered: bool = False) -> DataFrame:
        """One row per file, with the report's column names; ordered adds input_no, the place of
        the input that a file came with (rows of one input go by their path)."""
        totals = units.mask_totals(self.units).select("doc_id", "summary")
        counts = self.units.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.size("warnings") > 0).alias("warned")).join(totals, "doc_id")
        folders = units.unique_folders(self.files.filter("status IS NULL").select("doc_id", md.folder_base(F.col("relative")).alias("base"), "kind", "relative"), order="relative").select("doc_id", "folder")
        rows = self.files.join(counts, "doc_id", "left").join(folders, "doc_id", "left")
        n = F.coalesce("n", F.lit(0))
        return rows.select(
            F.col("name").alias("bestand"), F.col("relative").alias("pad"), F.coalesce(F.when(F.col("status").isNull(), F.col("kind")), F.lit("")).alias("formaat"),
            F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), units.unit_of(F.col("kind")), F.lit("s"))).otherwise(F.lit("")).alias("eenheden"), n.alias("omgezet"),
            F.coalesce("warned", F.lit(0)).alias("met waarschuwing"), F.coalesce("summary", F.lit("")).alias("gemaskeerd"), F.coalesce("folder", F.lit("")).alias("map"),
            F.when(F.col("status").isNull(), F.lit(messages.DONE)).otherwise(F.concat(F.lit(messages.FAILED), F.col("status"))).alias("status"),
            *((F.col("input_no") if "input_no" in rows.columns else F.lit(0).alias("input_no"),) if ordered else ()),
        )

    def review_report(self, edits: DataFrame) -> DataFrame:
        """The report with what reviewers did: units looked at and changed."""
        seen = units.counters(units.with_edits(self.units, edits)).join(self.files.select("doc_id", F.col("relative").alias("pad")), "doc_id")
        rows = self.report().join(seen.select("pad", F.col("reviewed").alias("nagekeken"), F.col("edited").alias("aangepast")), "pad", "left")
        rows = rows.withColumnRenamed("map", "map in zip").fillna(0, ["nagekeken", "aangepast"])
        return rows.select(*units.REVIEW_REPORT)


def with_margins(suggested: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, top, bottom): what a user chose (a null is no choice), else what was suggested."""
    if chosen is None:
        return suggested
    mine = chosen.select("doc_id", F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    return suggested.join(mine, "doc_id", "left").select("doc_id", F.coalesce("_t", "top").alias("top"), F.coalesce("_b", "bottom").alias("bottom"))


def convert(files: DataFrame, options: Options = Options(), pages: str = "", pdf: Callable[[DataFrame, Options], DataFrame] | None = None, streets: Sequence[str] = ()) -> Conversion:  # noqa: B008
    """files (doc_id, relative, name, content) to a Conversion. content goes no further than
    the package readers."""
    known = with_format(files)
    words = stage(docx.read_packages(known.filter("kind = 'docx'")), "word-packages")
    decks = stage(pptx.read_packages(known.filter("kind = 'pptx'")), "slide-packages")
    slug = F.when(F.col("kind") == "pdf", md.slug_pdf(F.col("name"))).otherwise(md.slug_office(F.col("name"), F.when(F.col("kind") == "pptx", F.lit("presentatie")).otherwise(F.lit("document"))))
    slugs = stage(known.select("doc_id", slug.alias("slug")), "slugs")
    found = word.convert(words, slugs).withColumn("kind", F.lit("docx")).unionByName(slides.convert(decks.filter("error IS NULL"), slugs, options.speaker_notes).withColumn("kind", F.lit("pptx")))
    if options.ignore_images:
        found = found.withColumn("markdown", md.strip_images(F.col("markdown")))
    errors = words.select("doc_id", "error", "core").unionByName(decks.select("doc_id", "error", "core"))
    if pdf is not None:
        found = found.unionByName(pdf(known.filter("kind = 'pdf'"), options).withColumn("kind", F.lit("pdf")))
    listed = stage(known.drop("content", "length", "modificationTime"), "files").join(errors, "doc_id", "left")
    status = F.coalesce("status", "error", F.when((F.col("kind") == "pdf") & F.lit(pdf is None), F.lit(messages.NO_EXTRACTOR)))
    listed = listed.withColumns({"status": status, "slug": slug, "props": core_properties(F.col("core"))}).drop("core", "error")
    listed = listed.withColumn("title", md.title_of(F.col("props.title"), F.col("slug")))
    if pages:
        total = found.groupBy("doc_id").agg(F.max("unit_no").alias("total"))
        found = found.join(total, "doc_id").filter(F.array_contains(parse_pages(F.lit(pages), F.col("total")), F.col("unit_no"))).drop("total")
    found = found.withColumns({"masked": F.create_map().cast("map<string,int>"), "chars": F.length("markdown"), "tables": md.table_count(F.col("markdown"))})
    found = units.mask_units(found, options.anonymize, streets=streets).select(*UNIT_COLUMNS)
    found = stage(found, "units")
    return Conversion(listed, found, figures_of(words, decks, slugs, options), options)


def figures_of(words: DataFrame, decks: DataFrame, slugs: DataFrame, options: Options) -> DataFrame:
    """(doc_id, path, bytes): images under the names that the Markdown links to. Bytes are joined
    by part, apart from the text."""
    in_words = word.figures(words, slugs).select("doc_id", "part", "path")
    pics = decks.select("doc_id", F.explode("shapes").alias("s")).filter("s.kind = 'pic'").join(slugs, "doc_id")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("s.slide_no", "s.z"))
    path = F.concat(F.lit("figures/"), F.col("slug"), F.lit("-dia"), F.col("s.slide_no").cast("string"), F.lit("-img"), n.cast("string"), F.lower(F.regexp_extract("s.image", r"(\.[^./]*)$", 1)))
    in_decks = pics.select("doc_id", F.col("s.image").alias("part"), path.alias("path"))
    media = lambda df: df.select("doc_id", F.explode("media").alias("m")).select("doc_id", "m.part", "m.bytes")
    out = in_words.unionByName(in_decks).join(media(words).unionByName(media(decks)), ["doc_id", "part"]).select("doc_id", "path", "bytes")
    return out.limit(0) if options.ignore_images else out


def probe(files: DataFrame) -> DataFrame:
    """What is cheap to say of files: kind, unit, units, bookmarks, title, status."""
    made = convert(files, Options(anonymize=()))
    counts = made.units.groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if((F.col("kind") == "docx") & (F.col("title") != "")).alias("toc_entries"))
    return made.files.join(counts, "doc_id", "left").select("doc_id", "name", "kind", units.unit_of(F.col("kind")).alias("unit"), "units", "toc_entries", "title", "status")
