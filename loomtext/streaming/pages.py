"""Pages as they arrive: extraction and chunking on a stream, first arrivals by fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.functions import columns as C
from loomtext.operators import documents, extract


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stream of Parquet files of (page_id, url, html) that are put into a folder."""
    return spark.readStream.schema("page_id long, url string, html string").parquet(path)


def stream_chunks(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options: object) -> StreamingQuery:
    """Extract and chunk each batch and hand (chunks, batch id) to the sink; ends when all that is there is done."""

    def each(batch: DataFrame, number: int) -> None:
        sink(documents.chunk(extract.extract(batch), **options), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(rows: DataFrame, time_col: str, text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """The first of each fingerprint within the watermark; state is dropped beyond it."""
    return rows.withColumn("fingerprint", C.fingerprint(F.col(text_col))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fingerprint"])
