"""Conversion of a folder as files arrive: micro-batches through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.pages import Options
from ..plans.convert import Conversion, convert
from ..sources.files import binary_files, with_names


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Conversion, int], None], options: Options = Options(), max_files: int = 100, once: bool = False) -> StreamingQuery:  # noqa: B008
    """Every batch of at most max_files new files is converted and handed to sink(conversion, batch
    number). A query that is stopped keeps what its finished batches wrote; units carry their
    numbers, so batches may come in any order."""
    files = with_names(binary_files(spark, folder, stream=True, max_files=max_files), folder)
    writer = files.writeStream.foreachBatch(lambda df, n: sink(convert(df, options), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def mask_stream(rows: DataFrame, text: str, categories=None) -> DataFrame:
    """Masking is a column expression and needs no state."""
    from pyspark.sql import functions as F

    from ..functions.masking import mask

    masked = mask(F.col(text), categories)
    return rows.withColumn(text, masked["text"]).withColumn("masked", masked["counts"])
