"""Streaming ingestion: image files that arrive in a folder are upserted into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Indexer
from ..sources.frames import plain_path

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(indexer: Indexer, folder: str, collection_id: str, checkpoint: str, *, pattern: str = "*.png", max_files: int = 1000) -> StreamingQuery:
    """Start a query that takes what is there, in batches of max_files, and stops.

    Ids come from paths, so a batch that is replayed after a failure replaces its own rows.
    """
    files = indexer.spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)

    def upsert(batch: DataFrame, epoch: int) -> None:
        path = plain_path(F.col("path"))
        ident = F.sha1(F.concat(F.lit(f"{collection_id}:"), path))
        rows = batch.select(F.monotonically_increasing_id().alias("pos"), path.alias("path"), "content", (F.col("modificationTime").cast("double")).alias("ts"), ident.alias("id"))
        indexer.update(rows, collection_id, job_id=f"{collection_id}-{epoch}")

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
