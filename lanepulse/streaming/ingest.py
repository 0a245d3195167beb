"""Incremental ingest: new reading files into the month-partitioned table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lanepulse.operators import ingest
from lanepulse.sinks.tables import with_month, write_unit
from lanepulse.sources import xml


def ingest_batch(docs: DataFrame, locations: DataFrame, unit: str, table: str, quarantine: str) -> None:
    """Write one batch as an ingest unit of its own, so a batch that runs twice after a lost
    driver or executor leaves its rows once."""
    docs.persist()  # parsed once for both outputs; lost blocks are parsed again
    try:
        good, corrupt = xml.good_and_corrupt(docs)
        located = ingest.join_locations(ingest.flatten_readings(good), locations)
        write_unit(with_month(located), table, ["month"], unit)
        write_unit(corrupt, quarantine, [], unit)
    finally:
        docs.unpersist()


def start_ingest(spark: SparkSession, folder: str, locations: DataFrame, table: str, quarantine: str,
                 checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Take in every file not seen before, some files per batch, then stop.

    A unit is named by the stream's id, which its checkpoint keeps over restarts, and the
    batch number: streams with checkpoints of their own can share a table.
    """
    def batch_of(batch, number):
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_batch(batch, locations, f"{stream}-{number}", table, quarantine)

    return (
        xml.stream_documents(spark, folder, files_per_batch)
        .writeStream.foreachBatch(batch_of)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_new_files(spark: SparkSession, folder: str, locations: DataFrame, table: str, quarantine: str,
                     checkpoint: str, files_per_batch: int = 1000) -> None:
    start_ingest(spark, folder, locations, table, quarantine, checkpoint, files_per_batch).awaitTermination()
