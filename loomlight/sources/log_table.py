"""A table with a key, in Parquet files, to which upserts and deletions add small files.

Each change is one delta: its rows alone, in folders by a hash bucket of the key, so a change writes bytes
in proportion to itself. A reader takes the newest row of each key among the deltas, and of the base
those rows whose key no delta has. Compaction merges buckets whose deltas have grown, and only them.

The state is the latest manifest: a small JSON file with a number, created once and never changed. A
writer that finds its number taken has lost against another one. Files stay until `vacuum`, so readers
of an earlier state are not disturbed, and what a lost writer has left is not seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.storage import get_text, names_in, put_new, remove

#: Columns that the files have besides the table's own.
BUCKET, SEQ, GONE = "_bucket", "_seq", "_gone"


class Conflict(Exception):
    """Another writer has committed since this one began."""


@dataclass
class LogTable:
    """The table at `path`. `about` are facts about it that its first change notes, for good."""

    spark: SparkSession
    path: str
    key: str = "id"
    buckets: int = 16

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self.state = self._latest()
        if self.state:
            self.key, self.buckets = self.state["key"], self.state["buckets"]

    def _latest(self) -> dict | None:
        numbers = sorted((int(n[:-5]) for n in names_in(self.spark, f"{self.path}/manifest") if n[:-5].isdigit() and n.endswith(".json")), reverse=True)
        for n in numbers:
            try:
                return json.loads(get_text(self.spark, f"{self.path}/manifest/{n:012d}.json"))
            except ValueError:  # its writer died while writing, so nothing has been committed
                continue
        return None

    @property
    def version(self) -> int:
        return self.state["version"] if self.state else 0

    @property
    def about(self) -> dict:
        return self.state["about"] if self.state else {}

    @property
    def schema(self) -> str:
        return self.state["schema"]

    def refresh(self) -> None:
        """Takes over what others have committed."""
        self.state = self._latest()

    def _commit(self, state: dict) -> None:
        taken = [int(n[:-5]) for n in names_in(self.spark, f"{self.path}/manifest") if n[:-5].isdigit() and n.endswith(".json")]
        torn = [n for n in taken if n > self.version]
        if torn and (now := self._latest()) and now["version"] > self.version:
            raise Conflict(f"version {now['version']} is there already")
        number = max([self.version, *torn]) + 1
        if not put_new(self.spark, f"{self.path}/manifest/{number:012d}.json", json.dumps(state | {"version": number})):
            raise Conflict(f"version {number} is there already")
        self.state = state | {"version": number}

    def _write(self, rows: DataFrame, sort: list[str]) -> tuple[str, dict[str, int]]:
        """A new folder with rows (which have BUCKET), and the number of rows by bucket."""
        folder = f"rows-{uuid.uuid4().hex[:16]}"
        order = [BUCKET, *sort, self.key]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.withColumn("bucket", F.col(BUCKET)).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        if not any(n.startswith("bucket=") for n in names_in(self.spark, f"{self.path}/{folder}")):
            return folder, {}
        found = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(BUCKET).count().collect()  # a row for each bucket at most
        return folder, {str(r[BUCKET]): r["count"] for r in found}

    def _change(self, rows: DataFrame, gone: bool, about: dict | None, sort: list[str]) -> None:
        own = [c for c in rows.columns if c != self.key]
        newest = rows.groupBy(self.key).agg(F.max(F.struct(*own)).alias("_r")).select(self.key, "_r.*") if own else rows.select(self.key).distinct()
        state = self.state or {
            "version": 0,
            "key": self.key,
            "buckets": self.buckets,
            "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields),
            "about": about or {},
            "deltas": [],
            "base": {},
            "sort": sort,
        }
        known = self.spark.createDataFrame([], state["schema"])
        filled = newest.select(*((F.col(f.name) if f.name in newest.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.schema.fields))
        marked = filled.withColumns({SEQ: F.lit(state["version"] + 1).cast("long"), GONE: F.lit(gone), BUCKET: self._bucket()})
        folder, counts = self._write(marked, state["sort"])
        if not counts and self.state:
            remove(self.spark, f"{self.path}/{folder}")
            return
        number = state["version"] + 1
        if not self.state:  # the first rows are the base
            self._commit(state | {"base": {b: {"folder": folder, "through": number, "rows": n} for b, n in counts.items()}})
        else:
            self._commit(state | {"deltas": [*state["deltas"], {"folder": folder, "seq": number, "rows": counts}]})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, about: dict | None = None, sort: tuple[str, ...] = ()) -> None:
        """Adds rows or replaces those of the same key. Of rows with one key in one change the largest by its columns stays.

        The first change fixes the columns, `about`, and the columns that files are sorted by.
        """
        self._change(rows, False, about, list(sort))

    def delete(self, keys: DataFrame) -> None:
        """Takes out the rows of `keys` (the key column)."""
        if self.state:
            self._change(keys.select(self.key), True, None, [])

    def _full(self) -> str:
        return f"{self.schema}, `{SEQ}` bigint, `{GONE}` boolean, `{BUCKET}` int"

    def _pending(self) -> list[tuple[dict, list[int]]]:
        """Deltas with the buckets of them that no base has taken in."""
        base = self.state["base"]
        out = [(d, [int(b) for b in d["rows"] if d["seq"] > base.get(b, {}).get("through", 0)]) for d in self.state["deltas"]]
        return [(d, b) for d, b in out if b]

    def _deltas(self, only: list[int] | None) -> DataFrame | None:
        paths = [f"{self.path}/{d['folder']}/bucket={b}" for d, bs in self._pending() for b in bs if only is None or b in only]
        if not paths:
            return None
        rows = self.spark.read.schema(self._full()).parquet(*paths)
        own = [c for c in rows.columns if c not in (self.key, SEQ)]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*own), SEQ).alias("_r")).select(self.key, "_r.*")

    def _base(self, only: list[int] | None) -> DataFrame:
        paths = [f"{self.path}/{b['folder']}/bucket={n}" for n, b in self.state["base"].items() if b["rows"] and (only is None or int(n) in only)]
        empty = self.spark.createDataFrame([], self._full())
        return self.spark.read.schema(self._full()).parquet(*paths) if paths else empty

    def read(self, where: Column | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of this state. `where` reaches the files of the base; deltas are filtered once their newest rows are known."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        base, fresh = self._base(buckets), self._deltas(buckets)
        base = base if where is None else base.where(where)
        if fresh is None:
            return base.select(*columns)
        old = base.join(fresh.select(self.key), self.key, "left_anti")
        new = fresh.where(f"NOT {GONE}")
        return old.select(*columns).unionByName((new if where is None else new.where(where)).select(*columns))

    def compact(self, share: float = 0.25) -> list[int]:
        """Merges the buckets whose deltas have `share` of their base's rows or more; returns them."""
        if not self.state:
            return []
        base, waiting = self.state["base"], {}
        for d, buckets in self._pending():
            for b in buckets:
                waiting[b] = waiting.get(b, 0) + d["rows"][str(b)]
        full = sorted(b for b, n in waiting.items() if n >= share * base.get(str(b), {}).get("rows", 0))
        if full:
            rows = self.read(buckets=full).withColumns({SEQ: F.lit(self.version).cast("long"), GONE: F.lit(False), BUCKET: self._bucket()})
            folder, counts = self._write(rows, self.state["sort"])
            merged = {str(b): {"folder": folder, "through": self.version, "rows": counts.get(str(b), 0)} for b in full}
            state = self.state | {"base": base | merged}
            self._commit(state | {"deltas": [d for d in state["deltas"] if any(d["seq"] > state["base"].get(b, {}).get("through", 0) for b in d["rows"])]})
        return full

    def vacuum(self) -> list[str]:
        """Deletes the folders that the latest state does not name; only while no one reads or writes."""
        self.refresh()
        if not self.state:
            return []
        used = {d["folder"] for d in self.state["deltas"]} | {b["folder"] for b in self.state["base"].values()}
        idle = [n for n in names_in(self.spark, self.path) if n.startswith("rows-") and n not in used]
        for n in idle:
            remove(self.spark, f"{self.path}/{n}")
        return idle
