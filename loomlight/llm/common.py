"""Shared plumbing: the scratch folder all executors see, written stages, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.storage import freeing, remove, scratch, table, written

__all__ = [
    "claim",
    "freeing",
    "in_filter",
    "kept",
    "key_filter",
    "lower_az",
    "one_of_each",
    "row_key",
    "rank_within",
    "ranges",
    "raw",
    "remove",
    "runs",
    "scratch",
    "slices",
    "table",
    "written",
]

_OWNER = [""]
_KEPT: list[dict] = []


def kept() -> dict:
    """A memory of a Python worker that lasts between tasks, until another operator claims the worker."""
    _KEPT.append({})
    return _KEPT[-1]


def claim(owner: str) -> None:
    """Called in a task: frees what another operator left in this Python worker."""
    if _OWNER[0] not in ("", owner):
        for memory in _KEPT:
            memory.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _OWNER[0] = owner


def raw(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8 bytes; null is empty."""
    if column.type not in (pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_binary() if column.type == pa.large_string() else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size.astype(np.int64)), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal integers in `names`, with their batches cut to them."""
    last, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cut = np.flatnonzero(new).tolist()
        for a, e in zip(cut, [*cut[1:], b.num_rows], strict=True):
            key = tuple(int(k[a]) for k in keys)
            if key != last:
                if held:
                    yield last, held
                last, held = key, []
            held.append(b.slice(a, e - a))
    if held:
        yield last, held


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def lower_az(column) -> F.Column:
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key() -> F.Column:
    """Tells rows apart by doc_id, which may be null, and text; null text equals empty text."""
    return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


#: Bits of a filter for each of its keys, most keys of one that is broadcast, and most bits of it (32 MB).
FILTER_BITS, FILTER_KEYS, FILTER_MOST = 64, 1 << 24, 1 << 28


def key_filter(keys: DataFrame, most: int | None = None) -> np.ndarray | None:
    """Bits, in words of 64, for the distinct `h` (long) of a written table: one in 64 is set, or one in 16 at most. None if they are too many to broadcast."""
    n = keys.count()
    if n > (FILTER_KEYS if most is None else most):
        return None
    bits = min(FILTER_MOST, 1 << max(16, (FILTER_BITS * n).bit_length()))
    place = F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    with freeing(keys.sparkSession):
        words = keys.groupBy(place.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of `h` may be among the filter's keys."""
    return ((words[(h & (64 * len(words) - 1)) >> 6] >> (h & 63)) & 1).astype(bool)


def one_of_each(docs: DataFrame, rows: DataFrame, group: str, largest: bool) -> DataFrame:
    """`docs` with one row of each group of `rows` (group, doc_id, key); those that no group has stay.

    The row with the largest or the least doc_id stays, one without doc_id only if all are. Of rows
    with one key, which are of one group, any stays.
    """
    each = written(rows.groupBy(group, "doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    best = F.max(F.struct("doc_id", "key")) if largest else F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    top = written(each.groupBy(group).agg(best.alias("top")).select(F.col("top.key").alias("tk")))
    gone = each.join(top, F.col("key") == F.col("tk"), "left_anti").select(F.col("key").alias("_k"))
    many = written(each.where("n > 1").join(top, F.col("key") == F.col("tk"), "left_semi").select(F.col("key").alias("_k")))
    # The row stands as one column, so that none of its names can clash.
    out, on = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row")), F.col("key") == F.col("_k")
    left = out.join(gone, on, "left_anti")
    if not many.isEmpty():
        left = left.join(many, on, "left_anti").unionByName(out.join(many, on, "left_semi").dropDuplicates(["key"]))
    return left.select("row.*")


def rank_within(df: DataFrame, group: str, order: list[str], rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds `rank`, long, gapless from 0 within each value of `group`.

    A hot group spreads over hashed buckets; each bucket numbers its own rows and starts where the
    buckets before it end. `df` must be a written table: it is read twice. `order` names columns
    that tell rows apart; rows equal in all of them are numbered in any order.
    """
    from pyspark.sql import Window as W

    n = max(1, -(-df.count() // rows_per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order)))
    joined = own.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("rank", F.col("_start") + F.col("_own") - 1).drop("_bucket", "_own", "_g", "_b", "_start")
