"""Resumable ingest: what is done is skipped, by anti-join in batch and by checkpoint in a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.storage import written


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is not among those done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], failed: str = "error") -> None:
    """Runs `work` over the Parquet files of `source` that no run before has finished, then stops.

    Results go to `<sink>/results`, finished ids to `<sink>/processed`, also those without results.
    `work` keeps `id`; where it gives a column named `failed`, rows with an error are left out of both,
    so that a later batch run takes them up again through `pending`.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        # Written first: whatever executors are lost, `work` has one outcome for results and finished ids.
        out = written(work(batch))
        bad = out.where(F.col(failed).isNotNull()).select("id") if failed in out.columns else None
        good = out.where(F.col(failed).isNull()).drop(failed) if failed in out.columns else out
        done = batch.select("id").distinct() if bad is None else batch.select("id").distinct().join(bad, "id", "left_anti")
        # A repeated epoch overwrites its own folder, so results are written once.
        good.write.mode("overwrite").parquet(f"{sink}/results/epoch={epoch}")
        done.write.mode("overwrite").parquet(f"{sink}/processed/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retry(call: Callable, tries: int = 5, base: float = 1.0, most: float = 30.0, wait: Callable[[float], None] | None = None):
    """The call's result; after an error that says it is temporary, again with doubled waits."""
    import time

    for turn in range(tries + 1):
        try:
            return call()
        except TemporaryError:
            if turn == tries:
                raise
            (wait or time.sleep)(min(most, base * 2**turn))


class TemporaryError(Exception):
    """A service is busy or out of order for now (HTTP 429 or 5xx)."""
