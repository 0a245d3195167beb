"""The live congestion view as a stream in append mode.

A window of a detector is written once, when the watermark (the latest time seen, less the
tolerated lateness) has passed its end; its state is then gone. A row of a window that has been
written is dropped and counted. The file sink keeps a log of finished batches, so a batch that
runs twice after a lost driver or executor is in the table once, and a stream started again
with its checkpoint goes on where it stopped. State holds the open windows of the detectors
seen within the lateness, not the history.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lanepulse.operators.outlook import live_congestion


@dataclass
class Drained:
    """What one run of the stream did: batches, rows read, groups dropped as late (of a window
    and detector, in a batch), and groups still open."""

    batches: int = 0
    rows: int = 0
    dropped: int = 0
    open_groups: int = 0


def start_live(readings: DataFrame, table: str, checkpoint: str, late: str = "10 minutes",
               window: str = "5 minutes") -> StreamingQuery:
    """Take in what has arrived and stop. `readings` is a stream; finished windows are appended
    to the Parquet table."""
    return (
        live_congestion(readings, late, window).writeStream.outputMode("append").format("parquet")
        .option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drain(readings: DataFrame, table: str, checkpoint: str, **options) -> Drained:
    """`start_live` to its end."""
    query, done = start_live(readings, table, checkpoint, **options), Drained()
    query.awaitTermination()
    for progress in query.recentProgress:
        done.batches += 1
        done.rows += progress.numInputRows
        for state in progress.stateOperators:
            done.dropped += state.numRowsDroppedByWatermark
            done.open_groups = state.numRowsTotal
    return done
