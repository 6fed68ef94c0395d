"""Exact deduplication by content-defined chunk recipes.

Each normalised text (A-Z lower-cased) is cut where a rolling hash of its bytes says so; a document
becomes the ordered list of its chunks' identifiers. An identifier is a digest that has been
verified: the bytes of every chunk whose digest occurs twice are moved once and compared. Documents
with equal lists are equal, so long texts are never sorted, joined or grouped themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, freeing, in_filter, key_filter, one_of_each, raw, row_key, slices, written
from loomlight.ship import map_arrow

WINDOW, AVERAGE, LEAST, MOST = 32, 2048, 256, 16384


def boundaries(data: np.ndarray, bounds: np.ndarray, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends over texts that end at `bounds`, and how many each text has. Only a text's own bytes decide."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] * np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64))
        h ^= h >> np.uint64(33)
    marks = np.flatnonzero((h & np.uint64(average - 1)) == 0) + 1
    split = np.searchsorted(marks, bounds, "left").tolist()
    marks, out, counts, lo, a = marks.tolist(), [], np.zeros(len(bounds), np.int64), 0, 0
    for i, b in enumerate(bounds.tolist()):
        at, n = a, len(out)
        for e in marks[lo : split[i]]:
            if e < a + WINDOW or e - at < least:
                continue
            while e - at > most:
                at += most
                out.append(at)
            if e - at >= least:
                out.append(e)
                at = e
        while b - at > most:
            at += most
            out.append(at)
        if b > at:
            out.append(b)
        counts[i], lo, a = len(out) - n, split[i], b
    return np.array(out, np.int64), counts


def identifier(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _cut(batch: pa.RecordBatch, digest):
    texts = [t.lower() for t in raw(batch.column("text"))]
    data = b"".join(texts)
    bounds = np.cumsum([len(t) for t in texts])
    ends, counts = boundaries(np.frombuffer(data, np.uint8), bounds)
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    chunks = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return texts, chunks, [digest(c) for c in chunks], counts


def recipes(docs: DataFrame, digest=identifier) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, recipe (its chunks' digests joined), key (of the row)."""

    def run(batches):
        claim("exact_dedup")
        for batch in slices(batches, 2 << 20):
            texts, _, keys, counts = _cut(batch, digest)
            ends = np.cumsum(counts).tolist()
            lists = [b"".join(keys[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array(lists, pa.binary()),
                    batch.column("key"),
                ],
                names=["doc_id", "text_sha256", "recipe", "key"],
            )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key")),
        run,
        "doc_id long, text_sha256 string, recipe binary, key string",
    )


def _repeated(listed: DataFrame) -> DataFrame:
    """(h, low) of every digest that occurs at least twice: its two halves."""

    def run(batches):
        claim("exact_dedup")
        for b in batches:
            all_ = np.frombuffer(b"".join(b.column("recipe").to_pylist()), "<i8").reshape(-1, 2)
            keys, n = np.unique(all_, axis=0, return_counts=True) if len(all_) else (all_, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], names=["h", "low", "n"])

    counts = map_arrow(listed.select("recipe"), run, "h long, low long, n long").groupBy("h", "low").agg(F.sum("n").alias("n"))
    return written(counts.where("n > 1").select("h", "low"))


def verify(docs: DataFrame, listed: DataFrame, most: int | None = None, digest=identifier) -> None:
    """Compares the bytes of chunks with one digest; raises if two differ.

    A filter as large as the repeated digests ask for tells tasks what to move. Where it would be too
    large to broadcast, all chunks move once, to a join with the repeated digests.
    """
    repeated = _repeated(listed)
    words = key_filter(repeated, most)
    seen = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        claim("exact_dedup")
        sent: set[tuple[bytes, int]] = set()  # with a hash of the bytes: chunks of one digest that differ all go
        for batch in slices(batches, 2 << 20):
            _, chunks, keys, _ = _cut(batch, digest)
            if not keys:
                continue
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            hit = np.ones(len(keys), bool) if seen.value is None else in_filter(seen.value, halves[:, 0])
            keep = [i for i in np.flatnonzero(hit).tolist() if (own := (keys[i], hash(chunks[i]))) not in sent and (sent.add(own) or True)]
            if len(sent) > 1 << 18:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[keep, 0]), pa.array(halves[keep, 1]), pa.array([chunks[i] for i in keep], pa.binary())],
                names=["h", "low", "body"],
            )

    moved = map_arrow(docs.select("text"), run, "h long, low long, body binary")
    if words is None:
        moved = moved.join(repeated, ["h", "low"], "left_semi")
    with freeing(docs.sparkSession):
        differ = moved.groupBy("h", "low").agg(F.min("body").alias("x"), F.max("body").alias("y")).where("x <> y").select("h", "low").limit(3).collect()
    if differ:
        raise ValueError(f"chunks differ under one digest: {[tuple(r) for r in differ]}")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its equal texts), group_size, kept, text_sha256.

    Null equals empty. Rows that repeat a doc_id with its text are all counted and all get its
    answer; a group without any doc_id keeps none. Further columns of `docs` are ignored; an empty
    table gives no rows.
    """
    listed = written(recipes(docs))
    verify(docs, listed)
    # Written, so that the join below has an exchange on both sides and large groups can be split.
    alike = written(listed.groupBy("recipe").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("recipe", "r"))
    joined = listed.join(alike, F.col("recipe") == F.col("r"), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, exactly one of each group of equal texts, with their columns.

    That is the one with the largest doc_id; a group without any doc_id keeps one row too.
    """
    listed = written(recipes(docs))
    verify(docs, listed)
    return one_of_each(docs, listed, "recipe", largest=True)
