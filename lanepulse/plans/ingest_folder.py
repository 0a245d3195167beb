"""Batch ingest of one folder of reading files, as one plan."""

from pyspark.sql import DataFrame, SparkSession

from lanepulse.operators import ingest
from lanepulse.sinks.tables import with_month, write_unit
from lanepulse.sources import shared, xml


def ingest_folder(spark: SparkSession, folder: str, locations: DataFrame, table: str, quarantine: str, unit: str,
                  files: str = xml.PLAIN) -> None:
    """Parse the folder once, then store its located readings by month and its unreadable
    documents in the quarantine, both as the ingest unit `unit`. The parsed documents go to
    the shared folder first, so neither output parses the files again, and are removed from it
    in the end. `files` names those to read: `xml.PACKED` takes gzip files too."""
    parsed = shared.new_path(spark, "parsed")
    try:
        xml.read_documents(spark, folder, files=files).write.parquet(parsed)
        good, corrupt = xml.good_and_corrupt(spark.read.parquet(parsed))
        located = ingest.join_locations(ingest.flatten_readings(good), locations)
        write_unit(with_month(located), table, ["month"], unit)
        write_unit(corrupt, quarantine, [], unit)
    finally:
        shared.remove(spark, parsed)
