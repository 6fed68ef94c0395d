"""Exact nearest vectors through an inverted file: cells around centroids, pruned by the triangle inequality.

Distances are those of unit vectors, so |x - y|^2 = 2 - 2 cos. A cell knows the least and the largest
distance of its vectors from its centroid; a query's distance from the centroid then bounds the score of
everything in the cell. A query first opens the nearest cells that hold k vectors. The k-th score
found there is a limit that no cell below it can beat, so only the cells that still can are opened.
Centroids are fitted on a bounded sample; every vector is indexed, and results equal those of a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.ship import map_arrow
from loomlight.storage import written

#: Most bytes of all centroids, which are broadcast, and of the sample that they are fitted on.
CENTROID_BYTES, SAMPLE_BYTES, TURNS = 8 << 20, 64 << 20, 8

#: Most cells of books that are told apart; beyond, cells are of all books together.
CELLS = 1 << 18

#: Bytes of vectors of neighbouring cells that a task holds, queries that ask at one part of them, and most scores computed at once.
PART_BYTES, ASKING, SCORES = 8 << 20, 1 << 14, 1 << 20

#: Rows of queries sent to piles of cells at once.
ROWS = 1 << 12

#: By this much more than rounding a bound must fall short before a cell is left out.
MARGIN = 2e-6


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def matrix(values: pa.Array, dim: int) -> np.ndarray:
    """Lists of equal length as rows."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(values), dim)


def fit(vectors: DataFrame) -> np.ndarray:
    """Centroids of unit vectors for vectors (id, values): as many as the root of their number, within the bounds; a row of zeros if there are none."""
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("d")).collect()[0]
    n, dim = about["n"], max(1, about["d"] or 1)
    cells = max(1, min(round(n**0.5), CENTROID_BYTES // (8 * dim)))
    most = max(cells, min(n, 64 * cells, SAMPLE_BYTES // (8 * dim)))
    every = max(1, n // most)
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.xxhash64("id").alias("h"), F.col("values").cast("array<double>").alias("values"))
    sample = rows.toArrow().sort_by("h").slice(0, most).column("values").combine_chunks()
    if not len(sample):
        return np.zeros((1, dim))
    x = unit(matrix(sample, dim))
    at = x[:cells].copy()
    for _ in range(TURNS):
        own = nearest(x, at)[0]
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=len(at)) > 0
        at[used] = unit(sums[used])
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each unit vector, and its distance."""
    cell, step = np.zeros(len(x), np.int64), max(1, SCORES // len(at))
    for i in range(0, len(x), step):
        cell[i : i + step] = (x[i : i + step] @ at.T - 0.5 * (at**2).sum(1)).argmax(1)
    return cell, np.sqrt(((x - at[cell]) ** 2).sum(1))


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (id, values, book_id and others) with `cell` and `off`, the distance from its centroid. Vectors without length have cell -1."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column("values"), held.value.shape[1]))
            cell, off = nearest(x, held.value)
            none = ~x.any(1)
            cell[none], off[none] = -1, 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(off)], names=[*b.schema.names, "cell", "off"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return map_arrow(vectors, run, f"{ddl}, cell int, off double")


def cells_of(rows: DataFrame) -> DataFrame:
    """(book_id, cell, n, near, far) of assigned rows."""
    return rows.groupBy("book_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("near"), F.max("off").alias("far"))


def merged(cells: DataFrame) -> DataFrame:
    """Cells that several writes have noted, each once."""
    return cells.groupBy("book_id", "cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))


class _Cells:
    """The cells as arrays, for tasks: number, book (null where books are not told apart), centroid, bounds."""

    def __init__(self, found: pa.Table, centroids: np.ndarray):
        self.centroids = centroids
        self.cell = found.column("cell").to_numpy()
        self.n, self.near, self.far = (found.column(c).to_numpy() for c in ("n", "near", "far"))
        self.book = np.array(found.column("book_id").to_pylist(), object)

    def open_to(self, books: list[str] | None, by_book: bool) -> np.ndarray:
        return np.ones(len(self.cell), bool) if books is None or not by_book else np.isin(self.book.astype(str), books)

    def piles(self, most: int) -> np.ndarray:
        """A number for each cell: cells in a row share one while they have `most` vectors together at most; a larger cell is alone."""
        pile, held, now = np.zeros(len(self.cell), np.int64), 0, 0
        for i in np.lexsort((np.arange(len(self.cell)), self.cell)):
            if held and held + self.n[i] > most:
                held, now = 0, now + 1
            pile[i], held = now, held + int(self.n[i])
        return pile

    def best(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit queries and cells: the distance from the centroid, and the largest score that the cell may hold."""
        some = np.maximum(self.cell, 0)
        c = self.centroids[some]
        d = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (c**2).sum(1) - 2 * q @ c.T))
        least = np.maximum(0, np.maximum(d - self.far, self.near - d))
        top = 1 - least**2 / 2
        top[:, self.cell < 0] = 0.0
        top[~q.any(1)] = 0.0
        return d, top


def search(rows: Callable[[Column], DataFrame], cells: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k nearest for queries (qid, values, books: array or null for any), ties by id.

    rows(condition) gives the vectors (id, values, book_id, cell) that meet a condition on book_id and
    cell. `cells` covers them all; it may count vectors that are gone since.
    """
    return _Search(rows, cells, centroids, queries, k).best()


class _Search:
    def __init__(self, rows, cells: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int):
        self.spark, self.rows, self.k, self.dim = queries.sparkSession, rows, k, centroids.shape[1]
        self.asked = written(queries.select("qid", F.col("values").cast("array<double>").alias("values"), F.col("books").cast("array<string>").alias("books")))
        cells = written(cells)
        self.by_book = cells.count() <= CELLS
        if not self.by_book:
            cells = written(merged(cells.withColumn("book_id", F.lit(None).cast("string"))))
        found = cells.select(F.col("book_id").cast("string").alias("book_id"), "cell", "n", "near", "far").toArrow()  # bounded by CELLS or the centroids
        self.cells = _Cells(found, centroids)
        books = [None if b is None else str(b) for b in self.cells.book]
        self.pile = self.cells.piles(max(1, PART_BYTES // (8 * self.dim)))
        pile, size = self.pile, np.bincount(self.pile, self.cells.n, len(self.pile))
        names = [(i, b, int(c), int(p), int(size[p])) for i, (b, c, p) in enumerate(zip(books, self.cells.cell, pile, strict=True))]
        self.listed = self.spark.createDataFrame(names, "place int, book string, cell int, pile int, n long")
        self.opened: list[DataFrame] = []

    def best(self) -> DataFrame:
        first = written(self._found(self._opened(self.asked.withColumn("limit", F.lit(None).cast("double")))))
        kth = self._ranked(first).where(F.col("rank") == self.k).select(F.col("qid").alias("_q"), F.col("score").alias("_s"))
        known = self.asked.join(kth, F.col("qid") == F.col("_q"), "left").withColumn("limit", F.coalesce("_s", F.lit(-2.0))).drop("_q", "_s")
        rest = self._found(self._opened(known))
        return self._ranked(first.unionByName(rest)).where(F.col("rank") <= self.k)

    def _ranked(self, hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))

    def _opened(self, asked: DataFrame) -> DataFrame:
        """(qid, values, books, pile, places) of the cells a query opens, a row for each pile: without `limit` the nearest that hold k, else the others that may reach it."""
        k, by_book, dim, held = self.k, self.by_book, self.dim, self.spark.sparkContext.broadcast((self.cells, self.pile))

        def run(batches):
            cells, pile = held.value
            for b in batches:
                step = max(1, SCORES // max(1, len(cells.cell)))
                for at in range(0, b.num_rows, step):
                    some = b.slice(at, step)
                    d, top = cells.best(unit(matrix(some.column("values"), dim)))
                    row, piles, places = [], [], []
                    for i, (books, limit) in enumerate(zip(some.column("books").to_pylist(), some.column("limit").to_pylist(), strict=True)):
                        on = np.flatnonzero(cells.open_to(books, by_book))
                        on = on[np.lexsort((on, d[i, on]))]
                        seeds = int(np.searchsorted(np.cumsum(cells.n[on]), k, "left")) + 1
                        on = on[:seeds] if limit is None else (later := on[seeds:])[top[i, later] >= limit - MARGIN]
                        on = on[np.argsort(pile[on], kind="stable")].astype(np.int32)
                        cut = np.flatnonzero(np.diff(pile[on])) + 1
                        for part in np.split(on, cut) if len(on) else ():
                            row.append(i)
                            piles.append(int(pile[part[0]]))
                            places.append(part)
                    for i in range(0, len(row), ROWS):  # so no batch grows with the cells that queries open
                        take, these = pa.array(row[i : i + ROWS], pa.int32()), places[i : i + ROWS]
                        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in these])]).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [*(some.column(c).take(take) for c in ("qid", "values", "books")), pa.array(piles[i : i + ROWS], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(these)))],
                            names=["qid", "values", "books", "pile", "places"],
                        )

        out = written(map_arrow(asked, run, f"qid {asked.schema['qid'].dataType.simpleString()}, values array<double>, books array<string>, pile int, places array<int>"))
        self.opened.append(out.select("qid", F.explode("places").alias("place")))
        return out

    def _found(self, opened: DataFrame) -> DataFrame:
        """(qid, id, score): for each query and part of a pile of cells its k best in the cells that it opens."""
        asking = opened.groupBy(F.col("pile").alias("_p")).agg(F.count(F.lit(1)).alias("asking"))
        parts = F.ceil(F.col("n") * self.dim * 8 / PART_BYTES).cast("int")
        shares = F.ceil(F.col("asking") / ASKING).cast("int")
        work = written(asking.join(self.listed, F.col("pile") == F.col("_p")).select("pile", "place", "book", "cell", parts.alias("parts"), shares.alias("shares")))
        wanted = work.select("book", "cell").distinct().collect()  # bounded like the cells
        near = F.col("cell").isin(sorted({r["cell"] for r in wanted}))
        if self.by_book and (books := sorted({r["book"] for r in wanted if r["book"] is not None})) and all(r["book"] is not None for r in wanted):
            near = near & F.col("book_id").cast("string").isin(books)
        own = self.rows(near).select("id", F.col("values").cast("array<double>").alias("values"), F.col("book_id").cast("string").alias("book"), "cell")
        w = work.select("pile", "place", F.col("book").alias("_b"), F.col("cell").alias("_c"), "parts", "shares")
        on = (F.col("cell") == F.col("_c")) & (F.col("book").eqNullSafe(F.col("_b")) if self.by_book else F.lit(True))
        part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = own.join(w, on).select(
            "pile", part("id", "parts").alias("part"), spread("shares").alias("share"), F.lit(0).alias("side"), "id", "values", "book", "place"
        )
        q = opened.join(w.select(F.col("pile").alias("_p"), "parts", "shares").distinct(), F.col("pile") == F.col("_p"))
        right = q.select("pile", spread("parts").alias("part"), part("qid", "shares").alias("share"), F.lit(1).alias("side"), "qid", F.col("values").alias("v"), "books", "places")
        return met(left, right.withColumnRenamed("v", "values"), ("pile", "part", "share"), self.k, self.dim)


def met(vectors: DataFrame, queries: DataFrame, keys: tuple[str, ...], k: int, dim: int) -> DataFrame:
    """(qid, id, score): the k best for each query (qid, values, books) among the vectors (id, values, book) with equal integer `keys`.

    Both have `side`: 0 for vectors, which a task holds, 1 for queries, which stream past them. Where vectors
    have `place` and queries `places`, a query meets only those of its places.
    """
    both = vectors.unionByName(queries, allowMissingColumns=True)
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "side")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("qid", "id")}

    def run(batches):
        last, held, ready = None, [], None
        for key, rows in _runs(batches, *keys, "side"):
            if key[:-1] != last:
                last, held, ready = key[:-1], [], None
            if not key[-1]:
                held.append(rows)
                continue
            if held and ready is None:
                ready, held = _prepared(held, dim), []
            if ready is not None:
                yield from _scored(rows, ready, k, dim)

    return map_arrow(dealt, run, f"qid {kinds['qid']}, id {kinds['id']}, score double")


def _runs(batches, *names: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Stretches of rows with equal integers in `names`, within a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for at, to in zip(cut, cut[1:], strict=False):
            yield tuple(keys[at].tolist()), b.slice(at, to - at)


def _prepared(held: list[pa.RecordBatch], dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None]:
    """ids in order, unit vectors, books, places if there are any."""
    names = [c for c in ("id", "values", "book", "place") if c in held[0].schema.names]
    t = pa.Table.from_batches(held).select(names).combine_chunks()
    t = t.take(pc.sort_indices(t.column("id")))
    place = t.column("place").to_numpy() if "place" in names else None
    return t.column("id").combine_chunks(), unit(matrix(t.column("values").combine_chunks(), dim)), np.array(t.column("book").to_pylist(), object), place


def _scored(rows: pa.RecordBatch, ready: tuple, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    ids, own, book, place = ready
    q, groups = unit(matrix(rows.column("values"), dim)), {}
    for i, books in enumerate(rows.column("books").to_pylist()):
        groups.setdefault(None if books is None else tuple(books), []).append(i)
    for books, some in groups.items():
        on = np.arange(len(ids)) if books is None else np.flatnonzero(np.isin(book.astype(str), books))
        if not len(on):
            continue
        if place is None:
            step = max(1, SCORES // len(on))
            for at in range(0, len(some), step):
                who = np.array(some[at : at + step])
                score = np.round(q[who] @ own[on].T, 6)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                yield _hits(rows, ids, np.repeat(who, order.shape[1]), on[order].ravel(), np.take_along_axis(score, order, 1).ravel())
        else:
            step = max(1, SCORES // (k * (len(np.unique(place[on])) + 1)))
            for at in range(0, len(some), step):
                yield _hits(rows, ids, *_by_place(rows, q, own, on, place, np.array(some[at : at + step]), k))


def _by_place(rows: pa.RecordBatch, q, own, on, place, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score): the k best of each query of `who` among the vectors `on` of its places."""
    lists = rows.column("places").take(pa.array(who))
    asked, at = np.repeat(who, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    order = np.argsort(at, kind="stable")
    asked, at = asked[order], at[order]
    on = on[np.argsort(place[on], kind="stable")]  # within a place in order of id
    some, begin = np.unique(place[on], return_index=True)
    hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for p, mine in zip(some, np.split(on, begin[1:]), strict=True):
        these = asked[np.searchsorted(at, p, "left") : np.searchsorted(at, p, "right")]
        step = max(1, SCORES // len(mine))
        for i in range(0, len(these), step):
            part = these[i : i + step]
            score = np.round(q[part] @ own[mine].T, 6)
            row, best = _top(score, k)
            hits.append((part[row], mine[best], score[row, best]))
    query, vector, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[rank < k], vector[rank < k], score[rank < k]


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, the first of ties; a few more where ties go on."""
    if score.shape[1] > 4 * k:
        row, best = np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k])
        if len(row) <= 2 * k * len(score):
            return row, best
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()


def _hits(rows: pa.RecordBatch, ids: pa.Array, query: np.ndarray, vector: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column("qid").take(pa.array(query)), ids.take(pa.array(vector)), pa.array(score)], names=["qid", "id", "score"])
