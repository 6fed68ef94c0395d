"""A sink of JSON lines in numbered files of bounded size, in order, that replaces what was there as a whole.

Tasks write whole files into a folder beside the target; the driver's one commit moves it into the
target's place. A job that fails, or a task that is tried twice, leaves the old files as they were. So
a store can be read, extended and written to its own path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomlight.operators.vectors import parts
from loomlight.ship import ship
from loomlight.storage import written

PART, PLACE = "_part", "_place"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path, for a URI of any store that pyarrow knows, or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """The files of one finished task: number, and name in the folder beside the target."""

    files: list[tuple[int, str]]


class OrderedParts(DataSource):
    """Format `ordered_parts`, options path, suffix. Rows come by PART, and by PLACE within it; a part is in one task."""

    @classmethod
    def name(cls) -> str:
        return "ordered_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), self.options.get("suffix", "json"))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.own = path, suffix, uuid.uuid4().hex[:12]

    def _beside(self, what: str) -> str:
        return f"{_at(self.path)[1]}.{what}-{self.own}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, attempt = _at(self.path)[0], TaskContext.get().taskAttemptId()
        out, last, files = None, None, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    part = row.pop(PART)
                    row.pop(PLACE)
                    if part != last:
                        if out:
                            out.close()
                        store.create_dir(self._beside("new"), recursive=True)
                        last = part
                        files.append((part, f"part-{part:03d}.{self.suffix}.{attempt}"))
                        out = store.open_output_stream(f"{self._beside('new')}/{files[-1][1]}")
                    text = json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, separators=(",", ":"), default=str)
                    out.write(f"{text}\n".encode())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, target = _at(self.path)
        new, old = self._beside("new"), self._beside("old")
        store.create_dir(new, recursive=True)
        good = {name: part for m in messages if m for part, name in m.files}
        for found in store.get_file_info(fs.FileSelector(new)):
            if found.base_name not in good:  # of an attempt that did not finish
                store.delete_file(found.path)
        for name, part in good.items():
            store.move(f"{new}/{name}", f"{new}/part-{part:03d}.{self.suffix}")
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there:
            store.move(target, old)
        store.move(new, target)
        if there:
            (store.delete_file if store.get_file_info(old).is_file else store.delete_dir)(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, new = _at(self.path)[0], self._beside("new")
        if store.get_file_info(new).type != fs.FileType.NotFound:
            store.delete_dir(new)


def write_ordered(rows: DataFrame, path: str, order: str | None = None, size: int = 5000, suffix: str = "json") -> None:
    """Rows as part-001, part-002, ... of at most `size` rows each, in the order of a unique integer column, or as they come.

    `path` ends up with these parts only; null fields are left out. Without `order` the rows' own order counts, by file and place.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(OrderedParts)
    if order is None:  # written, as such numbers may differ between two readings
        numbered = written(rows.withColumn(PLACE, F.monotonically_increasing_id()))
    else:
        numbered = rows.withColumn(PLACE, F.col(order).cast("long"))
    dealt = parts(numbered, PLACE, size).withColumnRenamed("part", PART) if "part" not in rows.columns else _with_part(numbered, size)
    dealt = dealt.repartitionByRange(PART).sortWithinPartitions(PART, PLACE)
    dealt.write.format("ordered_parts").option("path", path).option("suffix", suffix).mode("append").save()


def _with_part(numbered: DataFrame, size: int) -> DataFrame:
    """For rows that have a column `part` of their own."""
    held = numbered.withColumnRenamed("part", "_own")
    return parts(held, PLACE, size).withColumnRenamed("part", PART).withColumnRenamed("_own", "part")
