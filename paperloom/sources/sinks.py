"""Writers: Markdown trees, reports, ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.units import csv_lines

STORED = (".png", ".jpg", ".jpeg", ".zip")
MIN_DEFLATED = 256
ONE_FILE = 1_000_000


def write_tree(documents: DataFrame, figures: DataFrame, out: str) -> None:
    """<out>/<folder>/<slug>.md for documents (folder, slug, document) and <out>/<folder>/<path> for
    figures (folder, path, bytes). Tasks write the files themselves, into any store that Arrow
    reaches by its address; a task that runs again writes the same files again."""
    texts = documents.select(F.concat("folder", F.lit("/"), "slug", F.lit(".md")).alias("name"), F.encode("document", "utf-8").alias("content"))
    images = figures.select(F.concat("folder", F.lit("/"), "path").alias("name"), F.col("bytes").alias("content"))

    def put(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                path = f"{root}/{name.as_py()}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as file:
                    file.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    texts.unionByName(images).mapInArrow(put, "files long").agg(F.sum("files")).collect()


def write_documents(documents: DataFrame, folder: str) -> None:
    """documents (folder, document): one folder each, its Markdown as a text file that ends with
    the document's own line feed."""
    body = F.regexp_replace("document", r"\n\z", "")
    documents.select("folder", body.alias("value")).repartition("folder").write.partitionBy("folder").option("lineSep", "\n").text(folder)


def write_report(rows: DataFrame, names: Sequence[str], folder: str, order: Sequence[str] = ()) -> None:
    """The report as text: byte-order mark, semicolons, CRLF; one row per document, by `order` (in
    the names' own order where none is given). One file up to ONE_FILE rows; of more, part files
    that continue each other in the order of their names."""
    spark = rows.sparkSession
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order or names)]
    lines = csv_lines(rows, names, *keys).withColumnRenamed("line", "value")
    kinds = dict(lines.dtypes)
    first = spark.range(1).select(F.lit("﻿" + ";".join(names)).alias("value"), *(F.lit(None).cast(kinds[f"k{i}"]).alias(f"k{i}") for i in range(len(keys))))
    whole = first.withColumn("o", F.lit(0)).unionByName(lines.withColumn("o", F.lit(1)))
    whole = whole.orderBy("o", *(f"k{i}" for i in range(len(keys)))).select("value")
    whole = whole.coalesce(1) if rows.limit(ONE_FILE + 1).count() <= ONE_FILE else whole
    whole.write.option("lineSep", "\r\n").text(folder)


def zip_bytes(entries: Sequence[tuple[str, bytes]]) -> bytes:
    """A plain archive: fixed date, deflated unless small, packed already, or no smaller."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            packed = not name.lower().endswith(STORED) and len(data) > MIN_DEFLATED
            z.writestr(info, data, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


def zip_documents(entries: DataFrame) -> DataFrame:
    """(doc_id, archive) of entries (doc_id, name, content binary): an archive holds one document."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        return pd.DataFrame({"doc_id": [key[0]], "archive": [zip_bytes([(n, bytes(c)) for n, c in zip(rows["name"], rows["content"], strict=True)])]})

    kind = dict(entries.dtypes)["doc_id"]
    return entries.select("doc_id", "name", "content").groupBy("doc_id").applyInPandas(pack, f"doc_id {kind}, archive binary")
