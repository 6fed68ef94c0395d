"""Exact cosine top-k with a metadata filter, stores, and the local embedder."""

from __future__ import annotations

import uuid
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.operators import vector_index
from loomlight.ship import map_arrow
from loomlight.sources.log_table import LogTable
from loomlight.storage import written

TOP_K = 8

# Source names of the question form and the books they stand for.
SOURCES = {"A Song of Ice and Fire": ["agot", "acok", "asos", "affc"], "fire-and-blood": ["fab"], "knight": ["kotsk"]}
DEFAULT_SOURCE = "A Song of Ice and Fire"


def source_filter(sources: list[str] | None, mapping: dict[str, list[str]] | None = None) -> list[str] | None:
    """The books that the sources stand for, once each; None (no filter) if none is chosen or none is known."""
    mapping = SOURCES if mapping is None else mapping
    books = list(dict.fromkeys(b for s in sources or [] for b in mapping.get(s, [])))
    return books or None


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of double; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int = TOP_K, books: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """The k nearest of `vectors` (id, values, book_id and others), ties by id; the filter comes first."""
    own = vectors if books is None else vectors.where(F.col("book_id").isin(books))
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = own.withColumn("score", F.round(cosine(F.col("values").cast("array<double>"), q), 6)).drop("values")
    scored = scored if min_score is None else scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def books_of(sources: Column, mapping: dict[str, list[str]] | None = None, default: str = DEFAULT_SOURCE) -> Column:
    """source_filter for a column of source arrays: the books of each row, null for no filter. No source at all means the default one."""
    known = F.create_map(*(x for s, b in (SOURCES if mapping is None else mapping).items() for x in (F.lit(s), F.array(*map(F.lit, b)))))
    chosen = F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, F.array(F.lit(default))).otherwise(sources)
    books = F.array_distinct(F.flatten(F.filter(F.transform(chosen, lambda s: known[s]), lambda b: b.isNotNull())))
    return F.when(F.size(books) > 0, books)


#: Values of query vectors that ask at one share of the vectors, bytes of vectors that one task holds, and most shares.
BLOCK_VALUES, PART_BYTES, SHARES = 1 << 16, 64 << 20, 8


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, id, score, rank) of the k nearest for every query (qid, values), by a scan.

    A query may have book_id, which must equal, or books, one of which must equal (null: any). Vectors
    form parts that fit a task; every query meets every part in a task, which keeps the k best of its
    part for it. So the ranking shuffles k rows a query and part.
    """
    size = vectors.select(F.size("values").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()[0]
    dim = max(1, size["d"] or 1)
    parts = max(1, -(-size["n"] * 8 * dim // PART_BYTES))
    shares = max(1, min(SHARES, -(-queries.count() * dim // BLOCK_VALUES)))
    books = F.col("books") if "books" in queries.columns else F.array("book_id") if "book_id" in queries.columns else F.lit(None).cast("array<string>")
    any_book = F.lit(None).cast("string") if "book_id" not in vectors.columns else F.col("book_id").cast("string")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values"), any_book.alias("book"))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("values").cast("array<double>").alias("values"), books.alias("books"))
    left = own.select(one_of("id", parts).alias("part"), every(shares).alias("share"), F.lit(0).alias("side"), "*")
    right = asked.select(every(parts).alias("part"), one_of("qid", shares).alias("share"), F.lit(1).alias("side"), "*")
    out = vector_index.met(left, right, ("part", "share"), k, dim)
    best = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def snippet(match: DataFrame, *more: str) -> DataFrame:
    """Matches as answers cite them: id, score, work, locator, type, book_id, url, text; `more` columns first."""
    return match.select(
        *more,
        "id",
        "score",
        F.col("book").alias("work"),
        F.concat(F.lit("chunk "), F.col("chunk_index").cast("string")).alias("locator"),
        F.lit("novel").alias("type"),
        "book_id",
        F.lit(None).cast("string").alias("url"),
        "text",
    )


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new rows; fails, when run, on an id that both have."""
    both = new.select("id").join(old.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    if both:
        raise ValueError(f"{both} ids are there already")
    return old.unionByName(new)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new rows; new ones replace old ones of the same id."""
    return new.unionByName(old.join(new.select("id"), "id", "left_anti"))


#: Ranges of ids whose counts one task adds up.
RANGES = 1 << 14


def parts(rows: DataFrame, order: str, size: int = 5000) -> DataFrame:
    """Adds `part`, from 1, of at most `size` rows in the order of a unique integer column.

    Places come from counts of ranges of that column, added up within groups of ranges and over the
    groups, so no single task sorts all rows or all ranges.
    """
    width = size * 8
    cell = F.floor(F.col(order) / width)
    counted = rows.groupBy(cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.floor(F.col("_c") / RANGES))
    before = lambda w, n: F.sum(n).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    groups = counted.groupBy(F.col("_g").alias("_h")).agg(F.sum("_n").alias("_m"))
    groups = groups.select("_h", before(W.orderBy("_h"), "_m").alias("_b"))  # a row for each RANGES * width ids
    starts = counted.withColumn("_s", before(W.partitionBy("_g").orderBy("_c"), "_n")).join(groups, F.col("_g") == F.col("_h"))
    starts = starts.select("_c", (F.col("_b") + F.col("_s")).alias("_s"))
    own = F.row_number().over(W.partitionBy("_cell").orderBy(order))
    placed = rows.withColumn("_cell", cell).withColumn("_r", own).join(starts, F.col("_cell") == F.col("_c"))
    part = F.floor((F.col("_s") + F.col("_r") - 1) / size) + 1
    return placed.withColumn("part", part.cast("long")).drop("_cell", "_r", "_c", "_s")


def checked(values: Column, dim: int) -> Column:
    """The vector, or an error if it has another size."""
    return F.when(F.size(values) == dim, values).otherwise(F.raise_error(F.concat(F.lit("wrong vector size: "), F.size(values).cast("string"))))


def hashing_embedder(dim: int = 384):
    """A deterministic local embedder: signed hashed words, unit length. The same one serves ingest and query."""

    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts.fillna(""):
            v = np.zeros(dim, np.float32)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return F.pandas_udf(embed, "array<float>")


def hashed_words(text: Column, dim: int) -> Column:
    """The words of a text as signed hashed counts, without Python. White space separates, case counts for nothing."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    codes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    sign = lambda s, h: s + F.when(F.floor(h / dim) % 2 == 0, 1.0).otherwise(-1.0)
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    # Inside transform() the codes stand for one value, and are taken once.
    return F.transform(F.array(codes), lambda own: F.transform(axes, lambda i: F.aggregate(F.filter(own, lambda h: h % dim == i), F.lit(0.0), sign)))[0]


class VectorStore(Protocol):
    def upsert(self, rows: DataFrame) -> None: ...

    def query(self, vector: list[float], k: int = TOP_K, books: list[str] | None = None) -> DataFrame: ...


class TableStore:
    """A store in a log-structured table, with an exact inverted-file index that its first upsert makes.

    Dimension, metric and centroids are noted with the first upsert. Later ones write their own rows
    and the bounds of the cells these fall into; nothing else is rewritten until compact(). Each change is
    a version of its own; the last one committed is the store's state, also for an instance opened later.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int = 384):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.log = LogTable(spark, f"{self.path}/table")
        noted = self.log.about.get("dim", dim)
        if noted != dim:
            raise ValueError(f"the store has {noted} dimensions, not {dim}")

    @property
    def version(self) -> int:
        return self.log.version

    def rows(self) -> DataFrame:
        return self.log.read().drop("cell", "off")

    def _centroids(self, name: str) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/{name}").orderBy("cell").toArrow()  # bounded by vector_index.CENTROID_BYTES
        return vector_index.matrix(found.column("values").combine_chunks(), self.dim)

    def upsert(self, rows: DataFrame) -> None:
        """Rows (id, values, book_id and others) added, or put in place of those with their id."""
        rows = rows.withColumn("values", checked(F.col("values"), self.dim))
        about = self.log.about
        if not about:
            centroids = vector_index.fit(rows)
            about = {"dim": self.dim, "metric": "cosine", "centroids": f"centroids-{uuid.uuid4().hex[:12]}"}
            listed = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centroids)], "cell int, values array<double>")
            listed.coalesce(1).write.parquet(f"{self.path}/{about['centroids']}")
        else:
            centroids = self._centroids(about["centroids"])
        own = written(vector_index.assigned(rows, centroids))
        # Noted before the rows are: bounds of rows that are never committed only widen a cell.
        vector_index.cells_of(own).coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        self.log.upsert(own, about, sort=("book_id", "cell"))

    def delete(self, ids: DataFrame) -> None:
        """Takes out the rows with these ids (id)."""
        self.log.delete(ids)

    def compact(self, share: float = 0.25) -> list[int]:
        """Merges what upserts have added into those buckets where that is `share` of what is there already."""
        return self.log.compact(share)

    def nearest(self, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """(qid, id, score, rank) of the k nearest for queries (qid, values, optional books: null for any); exact."""
        if not self.log.about:
            raise ValueError("the store is empty")
        books = F.col("books") if "books" in queries.columns else F.lit(None).cast("array<string>")
        asked = queries.select("qid", checked(F.col("values"), self.dim).alias("values"), books.alias("books"))
        cells = vector_index.merged(self.spark.read.parquet(f"{self.path}/cells"))
        return vector_index.search(self.log.read, cells, self._centroids(self.log.about["centroids"]), asked, k)

    def query(self, vector: list[float], k: int = TOP_K, books: list[str] | None = None) -> DataFrame:
        """The k nearest rows with their columns but `values`, and score."""
        if len(vector) != self.dim:
            raise ValueError(f"the query has {len(vector)} dimensions, the store {self.dim}")
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector], books)], "qid int, values array<double>, books array<string>")
        found = self.nearest(asked, k).select("id", "score").collect()
        hits = self.spark.createDataFrame([tuple(r) for r in found], f"id {self.rows().schema['id'].dataType.simpleString()}, score double")
        own = self.log.read(F.col("id").isin([r["id"] for r in found])).drop("values", "cell", "off")
        return own.join(hits, "id").orderBy(F.desc("score"), "id")


def vector_store(backend: str, spark: SparkSession, path: str, dim: int = 384) -> VectorStore:
    """Only the exact store is built; the hosted ones are named and refused."""
    if backend == "table":
        return TableStore(spark, path, dim)
    if backend in ("upstash", "qdrant"):
        raise NotImplementedError(backend)
    raise ValueError(f"unknown vector backend {backend}")
