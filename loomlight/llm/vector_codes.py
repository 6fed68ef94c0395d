"""Compression of vectors to codes by product quantisation, with partial-distance search in integers.

Each part of a vector has a codebook of its own. A search goes through a part's dimensions in
descending variance of the codebook. After the first ones each vector completes its distance to the
entry that is best so far; then the other entries add up dimension by dimension, and those whose sum
strictly exceeds the complete distance drop out by a mask. What is left are the nearest entries and
their ties, of which the lowest index wins.

A round of training is one pass over a written table: tasks return sums and counts by entry, which have a
fixed size, and no vector reaches the driver but the first `entries` ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, freeing, written
from loomlight.ship import map_arrow

#: Integers are held within these bounds, so that squared distances fit 64 bits.
BOUND = 1 << 28

#: Vectors searched at once, and dimensions that all entries add up before the first complete distance.
BLOCK, FIRST = 2048, 4


@dataclass(frozen=True)
class Codebooks:
    """entries x dimensions of integers; part p has the dimensions from edges[p] to edges[p + 1]."""

    values: np.ndarray
    edges: tuple[int, ...]

    def text(self) -> str:
        """All components by part, entry and place within the part, joined by commas."""
        return ",".join(str(x) for a, b in self.ranges() for x in self.values[:, a:b].ravel().tolist())

    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.edges, self.edges[1:], strict=False))


def edges_of(dim: int, parts: int) -> tuple[int, ...]:
    """Where consecutive parts begin and end: equal ones, or the first ones longer by one."""
    return (0, *np.cumsum([len(x) for x in np.array_split(np.arange(dim), parts)]).tolist())


def quantised(vectors: DataFrame, column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has null or non-finite ones."""
    v = F.col(column).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-BOUND))), F.lit(float(BOUND))))
    return F.when(v.isNotNull() & ~odd, F.transform(v, held))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of `book` for each row of x, both int64; ties take the lower index."""
    dims = np.argsort(-np.array([_spread(c) for c in book.T.tolist()], object), kind="stable") if book.shape[1] else np.zeros(0, np.int64)
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        own = np.arange(at, min(at + BLOCK, len(x)))
        some, sums = x[own], np.zeros((len(own), len(book)), np.int64)
        for d in dims[:FIRST]:
            sums += (some[:, d, None] - book[:, d]) ** 2
        guess = sums.argmin(1)
        limit = sums[np.arange(len(own)), guess]
        for d in dims[FIRST:]:
            limit = limit + (some[:, d] - book[guess, d]) ** 2
        row, entry = np.nonzero(sums <= limit[:, None])
        held = sums[row, entry]
        for d in dims[FIRST:]:
            held = held + (some[row, d] - book[entry, d]) ** 2
            on = held <= limit[row]
            row, entry, held = row[on], entry[on], held[on]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(held, first)
        hit = np.flatnonzero(held == np.repeat(least, np.diff(np.append(first, len(row)))))
        who, place = np.unique(row[hit], return_index=True)  # entries ascend within a row
        index[own[who]], best[own[who]] = entry[hit][place], least
    return index, best


def _spread(column: list[int]) -> int:
    """The variance of integers times the square of their number."""
    return len(column) * sum(v * v for v in column) - sum(column) ** 2


def _blocks(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, pc_flat(b.column("x")).reshape(b.num_rows, dim)


def pc_flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def train(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks for `kept` (vec_id, x: integers), a written table; None if it is empty.

    They start as the parts of the `entries` rows with the least vec_id (ties by components, null
    last). Rows whose vector has another length than the first of these take no part.
    """
    head = [r["x"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(1).collect()]
    if not head:
        return None
    dim = len(head[0])
    kept = kept.where(F.size("x") == dim)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    books = Codebooks(np.array([r["x"] for r in first], np.int64).reshape(len(first), dim), edges_of(dim, parts))
    for _ in range(rounds):
        books = Codebooks(_moved(kept, books), books.edges)
    return books


def _moved(kept: DataFrame, books: Codebooks) -> np.ndarray:
    """One round: each entry becomes the floored mean of the parts that it is nearest to; unused ones stay."""
    held = kept.sparkSession.sparkContext.broadcast((books.values, books.ranges()))

    def run(batches):
        claim("vector_codes")
        values, spans = held.value
        n, dim = values.shape
        sums, count = np.zeros((n, dim), np.int64), np.zeros((n, dim), np.int64)
        for _, x in _blocks(batches, dim):
            for a, b in spans:
                index, _ = nearest(x[:, a:b], values[:, a:b])
                np.add.at(sums[:, a:b], index, x[:, a:b])
                count[:, a:b] += np.bincount(index, minlength=n)[:, None]
        slot = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums.ravel()[slot]), pa.array(count.ravel()[slot])], names=["slot", "total", "n"])

    found = map_arrow(kept.select("x"), run, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    with freeing(kept.sparkSession):
        got = found.toArrow()  # at most entries x dimensions rows
    held.destroy()
    slot, total, n = (got.column(c).to_numpy() for c in ("slot", "total", "n"))
    out = books.values.copy()
    out.ravel()[slot] = total // n
    return out


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of `kept` but x, then code (indexes in part order, two hex digits each) and error (squared distances, summed over parts).

    Vectors of another length than the codebooks' have neither.
    """
    held = kept.sparkSession.sparkContext.broadcast((books.values, books.ranges()))
    others = [c for c in kept.columns if c != "x"]
    digits = max(2, len(f"{len(books.values) - 1:x}"))

    def run(batches):
        claim("vector_codes")
        values, spans = held.value
        for b in batches:
            size = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(size == values.shape[1])
            x = pc_flat(b.column("x").take(pa.array(fits))).reshape(len(fits), values.shape[1])
            error, code = np.zeros(len(fits), np.int64), np.full(len(fits), "", object)
            for lo, hi in spans:
                index, far = nearest(x[:, lo:hi], values[:, lo:hi])
                error += far
                code += np.array([f"{i:0{digits}x}" for i in range(len(values))], object)[index]
            codes, errors = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            codes[fits], errors[fits] = code, error
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in others), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*others, "code", "error"]
            )

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*others).schema.fields)
    return map_arrow(kept, run, f"{ddl}, code string, error long")


def compress(vectors: DataFrame, column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """One row per vector that is whole: vec_id, code, error, label_error (errors summed over the rows with an equal label); and the codebooks.

    vectors: vec_id, label and `column`. Rows whose vector is null or holds null or non-finite components
    drop out. Null labels count as equal. Repeated rows each count and each get their answer; null vec_ids
    come last among the first ones. Ties go to the lower index. Components beyond 2^18 are held there. A
    vector of another length than that of the least vec_id keeps a row without code and error. Further
    columns are ignored. An empty table gives no rows and no codebooks.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(vectors, column).alias("x"))
    kept = written(own.where(F.col("x").isNotNull()))
    books = train(kept, parts, entries, rounds)
    if books is None:
        rows = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        rows = written(encode(kept, books))
    totals = rows.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", "code", "error", "label_error"), books
