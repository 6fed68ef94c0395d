"""The scratch folder that all executors see, and tables written to it."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: Spark's own switch: what a statement has shuffled goes when it ends. Off by default.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only where that is unset (tests): below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = f"{base.rstrip('/')}/loomlight-{uuid.uuid4().hex[:12]}"
        atexit.register(remove, spark, _OWN[key])
    return f"{_OWN[key]}/{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a session already stopped leaves it."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Statements run inside leave no shuffle files behind; for those whose plans are not run again."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def written(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """df as a written table, in folders by a column if asked: cuts the lineage with files that outlive a lost executor."""
    spark = df.sparkSession
    path = path or scratch(spark)
    out = df.write.option("compression", "zstd")
    with freeing(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that sort and shuffle: for what grows with the data. Spark guesses from compressed files, and would send it to every executor through the driver."""
    return df.hint("merge")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path, on whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, by name; nothing if it is absent."""
    fs, at = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text to a path that must not exist yet; False if it does. Of two writers one succeeds."""
    fs, at = hadoop(spark, path)
    try:
        out = fs.create(at, False)
    except Exception:
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def get_text(spark: SparkSession, path: str) -> str:
    fs, at = hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
