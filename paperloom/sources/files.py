"""File intake: listing, junk, format detection, package parts.

Files are rows of Spark's binaryFile source. Nothing fails a job because of one file: what
cannot be read becomes a row with a status.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages

EXTENSIONS = ("pdf", "docx", "pptx")
LEGACY = ("doc", "ppt", "dot", "pot")
OLE_MAGIC = "D0CF11E0A1B11AE1"


def is_junk(name: Column) -> Column:
    """Lock files, resource forks, hidden files, thumbnails caches."""
    return name.startswith("~$") | name.startswith("._") | name.startswith(".") | (F.lower(name) == "thumbs.db")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def intake_status(relative: Column) -> Column:
    """accepted, junk (any part of the path), legacy or skipped."""
    ext = extension(relative)
    return (
        F.when(F.exists(F.split(relative, "/"), is_junk), "junk")
        .when(ext.isin(*EXTENSIONS), "accepted")
        .when(ext.isin(*LEGACY), "legacy")
        .otherwise("skipped")
    )


def binary_files(spark: SparkSession, folder: str, stream: bool = False, max_files: int = 100) -> DataFrame:
    """path, content, ... of all files below a folder."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def with_names(files: DataFrame, root: str) -> DataFrame:
    """relative (to root), name and a document id that follows from the path."""
    root = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_extract("path", "^.*?" + _quoted(root) + "/(.*)$", 1), "^/+", "")
    relative = F.when(relative == "", F.regexp_extract("path", r"([^/]*)$", 1)).otherwise(F.call_function("url_decode", F.replace(relative, F.lit("+"), F.lit("%2B"))))
    return files.withColumn("relative", relative).withColumns({"name": F.regexp_extract("relative", r"([^/]*)$", 1), "doc_id": F.sha2("path", 256).substr(1, 16)})


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def collect(spark: SparkSession, inputs: Sequence[str], folders: Sequence[bool]) -> DataFrame:
    """The files of a batch in order: single files as they are, folders filtered by intake."""
    parts = []
    for i, (path, is_folder) in enumerate(zip(inputs, folders, strict=True)):
        rows = with_names(binary_files(spark, path), path if is_folder else path.rpartition("/")[0])
        rows = rows.filter(intake_status(F.col("relative")) == "accepted") if is_folder else rows
        parts.append(rows.withColumn("input_no", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@F.pandas_udf(T.StringType())
def _zip_kind(contents: pd.Series) -> pd.Series:
    """docx or pptx by what a package holds; null for others."""

    def one(data):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except (zipfile.BadZipFile, OSError, ValueError):
            return None
        return "docx" if "word/document.xml" in names else "pptx" if "ppt/presentation.xml" in names else None

    return contents.map(one)


def with_format(files: DataFrame) -> DataFrame:
    """kind (null if unknown) and status (null if fine): by magic bytes, packages by their parts,
    and last by the extension for PDFs with bytes before their header."""
    magic = F.hex(F.substring("content", 1, 8))
    pdf, ole, zipped = magic.startswith("255044462D"), magic == OLE_MAGIC, magic.startswith("504B")
    package = _zip_kind(F.when(zipped, F.col("content")).otherwise(F.lit(b"")))
    kind = F.when(pdf, "pdf").when(ole, None).when(package.isNotNull(), package).when(extension(F.col("name")) == "pdf", "pdf")
    return files.withColumn("kind", kind).withColumn("status", F.when(ole, messages.OLD_OFFICE).when(F.col("kind").isNull(), messages.UNKNOWN_FORMAT))


def core_properties(xml: Column) -> Column:
    """struct<title, author, created, modified> of docProps/core.xml text; nulls where absent or
    where the XML is broken."""
    get = lambda tag: F.nullif(F.trim(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{tag}\b[^>]*>([^<]*)<", 1)), F.lit(""))
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    whole = xml.rlike(r"(?s)</(?:\w+:)?coreProperties>\s*$")
    return F.struct(*(F.when(whole, unescape(get(tag))).alias(name) for tag, name in (("title", "title"), ("creator", "author"), ("created", "created"), ("modified", "modified"))))


def street_list(spark: SparkSession, path: str | None) -> list[str]:
    """Street names, one a line, # for comments; no path means none. A word list of settings size."""
    if not path:
        return []
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return [r.value.strip().lower() for r in rows.toLocalIterator()]
