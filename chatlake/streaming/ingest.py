"""Incremental ingest of export files as they arrive. [STR-1]"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatlake.operators import store
from chatlake.sources.exports import decoded_path


def ingest_stream(spark: SparkSession, folder: str, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new .json files of folder to the archive at root, each file once, until none is left or for ever.

    A batch is one run of the archive, whose version names the last batch of the checkpoint, so a batch that is repeated after a failure appends nothing twice, not
    even a bad file; keys decide what is new, and late files need no watermark.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(folder)
    named = files.select(decoded_path(F.col("_metadata.file_path")).alias("source_path"), "value")

    def batch(rows: DataFrame, number: int) -> None:
        store.ingest(rows.sparkSession, root, rows, stream=checkpoint, batch=number)

    writer = named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
