"""Work that may fail for a time, tried again inside the stream.

Each id is a key with a state of its own: the row that waits, and how often it has been tried. A timer
brings it back after a back-off that doubles. What never succeeds ends as a dead letter with its error,
and can be handed in again. A result and the mark that its id is finished are one row of one commit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomlight.ship import ship
from loomlight.streaming.ingest import TemporaryError

#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a row of the outcome is: one of the results of an id, the end of an id's work, or of its tries.
RESULT, FINISHED, DEAD = "result", "finished", "dead"

OUTCOME = StructType(
    [
        StructField("id", StringType()),
        StructField("outcome", StringType()),
        StructField("place", IntegerType()),
        StructField("tries", IntegerType()),
        StructField("value", StringType()),
        StructField("error", StringType()),
    ]
)


def backoff(tries: int, base: float, most: float) -> float:
    """Seconds to wait after so many failed tries."""
    return min(most, base * 2 ** (tries - 1))


class _Retrying(StatefulProcessor):
    """Key: id. State: tries so far with the waiting row, or that the id is done."""

    def __init__(self, call: Callable[[dict], list[dict]], tries: int, base: float, most: float):
        self.call, self.tries, self.base, self.most = call, tries, base, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", StructType([StructField("row", StringType()), StructField("tries", IntegerType())]))
        self.done = handle.getValueState("done", StructType([StructField("tries", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            # An id that comes again while it waits, or once it is finished, changes nothing.
            if not self.done.exists() and not self.waiting.exists():
                yield from self._try(key[0], row["row"], 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.waiting.exists():
            row, tries = self.waiting.get()
            yield from self._try(key[0], row, tries, timerValues)

    def _try(self, id_: str, row: str, tries: int, timer) -> Iterator[Row]:
        tries += 1
        try:
            values = self.call(json.loads(row))
        except TemporaryError as e:
            if tries < self.tries:
                self.waiting.update((row, tries))
                self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + int(1000 * backoff(tries, self.base, self.most)))
                return
            yield self._end(id_, DEAD, tries, row, str(e) or type(e).__name__)
        except Exception as e:  # noqa: BLE001  the work's own error on this row; waiting would not mend it
            yield self._end(id_, DEAD, tries, row, f"{type(e).__name__}: {e}")
        else:
            for place, value in enumerate(values):
                yield Row(id=id_, outcome=RESULT, place=place, tries=tries, value=json.dumps(value), error=None)
            self.done.update((tries,))
            yield self._end(id_, FINISHED, tries, None, None)

    def _end(self, id_: str, outcome: str, tries: int, value: str | None, error: str | None) -> Row:
        self.waiting.clear()  # a dead letter may be handed in again
        return Row(id=id_, outcome=outcome, place=None, tries=tries, value=value, error=error)

    def close(self) -> None:
        pass


def retrying(rows: DataFrame, call: Callable[[dict], list[dict]], tries: int = 5, base: float = 1.0, most: float = 30.0) -> DataFrame:
    """(id, outcome, place, tries, value, error) of a stream of rows with `id`.

    `call` gets a row as a dictionary, in a task, and returns its results, dictionaries too; it raises
    TemporaryError to be called again, at most `tries` times in all. value: a result, or a dead letter's row, as JSON.
    """
    ship(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = rows.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(*rows.columns)).alias("row"))
    return keyed.groupBy("id").transformWithState(_Retrying(call, tries, base, most), OUTCOME, "Append", "ProcessingTime")


def ingest_retrying(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, call: Callable[[dict], list[dict]], every: str = "1 second", **limits
) -> StreamingQuery:
    """Starts the stream from the Parquet files of `source`; outcomes go to `<sink>/epoch=N`, one commit each. The caller stops it."""

    def write(batch: DataFrame, epoch: int) -> None:
        # A repeated epoch overwrites its own folder, so outcomes are written once.
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    stream = retrying(spark.readStream.schema(schema).parquet(source), call, **limits)
    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def outcomes(spark: SparkSession, sink: str, outcome: str, value: str | None = None) -> DataFrame:
    """(id, place, tries, value, error) of one kind so far; values parsed by a schema if given."""
    rows = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OUTCOME) + ", epoch long").parquet(sink)
    own = F.from_json("value", value) if value else F.col("value")
    return rows.where(F.col("outcome") == outcome).select("id", "place", "tries", own.alias("value"), "error")
