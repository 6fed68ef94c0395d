"""A content-addressed store of token ids.

A rolling hash cuts each document's ids into chunks. `objects` holds each distinct chunk once under
its digest; `recipes` lists, in ascending doc_id order, each document's chunk digests; `manifest`
has one Merkle root for each recipe file's block of documents and one over all blocks. Reading
verifies digests, chunk lengths and roots.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.llm.common import remove, runs, scratch, slices, written
from loomlight.llm.tokens import encoder, tokenizer_json
from loomlight.ship import map_arrow

END_ID = 2
WINDOW, AVERAGE, LEAST, MOST = 16, 256, 32, 2048
POLYNOMIAL = 0xEDB88320  # of zlib's crc32


def cuts(ids: np.ndarray, bounds: np.ndarray, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of chunks over documents that end at `bounds`: where a rolling hash of WINDOW ids of one document has its low bits clear."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k] * np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64))
        h ^= h >> np.uint64(32)
    ends = np.flatnonzero((h & np.uint64(average - 1)) == 0) + 1
    out, starts, lo = [], np.concatenate([[0], bounds[:-1]]), 0
    split = np.searchsorted(ends, bounds, "left")
    ends, split = ends.tolist(), split.tolist()
    for i, (a, b) in enumerate(zip(starts.tolist(), bounds.tolist(), strict=True)):
        at, first = a, a + WINDOW
        for e in ends[lo : split[i]]:
            if e < first or e - at < least:
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
        lo = split[i]
    return np.array(out, np.int64)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, docs_per_block: int = 20_000) -> None:
    """Encodes all `docs` (doc_id, text) and writes the store below `path`.

    Null or empty texts are the end id alone. Rows with one doc_id, or without any, are kept each,
    next to each other, in any order. Ids take two bytes where the vocabulary allows, else four.
    Further columns are ignored; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    buckets = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = _packed(docs, tokenizer_json(tokenizer), end_id, buckets)
    written(_distinct(found), f"{path}/chunks", by="kind")
    recipes = _chunks(spark, path, "recipe").select("doc_id", F.col("body").alias("keys"), "lens")
    # Rows of one doc_id may be many: the second column lets them go to several blocks.
    recipes = recipes.withColumn("salt", F.monotonically_increasing_id())
    n = max(1, -(-recipes.count() // docs_per_block))
    order = [F.col("doc_id").asc_nulls_first(), F.col("salt")]
    ordered = recipes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    written(ordered.select("doc_id", F.spark_partition_id().alias("block"), place.alias("place"), "keys", "lens"), f"{path}/recipes")
    remove(spark, f"{path}/chunks/kind=recipe")
    written(_blocks(spark.read.parquet(f"{path}/recipes")), f"{path}/manifest")
    root = _root(spark.read.parquet(f"{path}/manifest").select("block", "root").collect())
    spark.createDataFrame([(root,)], "root string").coalesce(1).write.parquet(f"{path}/root")


def _packed(docs: DataFrame, definition: str, end_id: int, buckets: int) -> DataFrame:
    """Rows of bucket -1 and below: recipes (doc_id, keys, lens); others: a batch's distinct chunks of a bucket, their keys, lengths and bodies joined."""
    share = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        enc, row = encoder(share.value), 512 * 31 * TaskContext.get().partitionId()
        for batch in slices(batches, 8 << 20):
            ids, counts = enc.encode(batch.column("text"))
            bounds = np.cumsum(counts + 1)
            full = np.full(int(bounds[-1]), end_id, enc.dtype)
            mask = np.ones(len(full), bool)
            mask[bounds - 1] = False
            full[mask] = ids
            ends = cuts(full, bounds)
            width = full.itemsize
            view, offsets = memoryview(full).cast("B"), np.concatenate([[0], ends * width])
            at = offsets.tolist()
            keys = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)])
            lens = (np.diff(offsets) // width).astype("<u4")
            upto = np.concatenate([[0], np.searchsorted(ends, bounds, "right")])
            part = -1 - (row + np.arange(len(counts))) // 512 % 4096
            row += len(counts)
            yield _rows(
                len(counts),
                bucket=pa.array(part.astype(np.int32)),
                doc_id=batch.column("doc_id").cast(pa.int64()),
                keys=_bytes(16 * upto, keys),
                lens=_bytes(4 * upto, lens.tobytes()),
            )
            first = np.unique(np.frombuffer(keys, "V16"), return_index=True)[1]
            own = np.frombuffer(keys, "V16")[first]
            bucket = own.view("<u1").reshape(-1, 16)[:, :2].astype(np.int64) @ [256, 1] * buckets >> 16
            bodies = _bytes(offsets, full.tobytes()).take(pa.array(first))
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            to = np.append(cut, len(own))
            of = np.concatenate([[0], np.cumsum(lens[first].astype(np.int64))])[to] * width
            yield _rows(
                len(cut),
                bucket=pa.array(bucket[cut].astype(np.int32)),
                keys=_bytes(16 * to, own.tobytes()),
                lens=_bytes(4 * to, lens[first].tobytes()),
                body=_bytes(of, bodies.buffers()[2]),
                width=pa.array([width] * len(cut), pa.int32()),
            )

    return map_arrow(docs.select("doc_id", "text"), run, "bucket int, doc_id long, keys binary, lens binary, body binary, width int")


_PACKED = pa.schema(
    [
        ("bucket", pa.int32()),
        ("doc_id", pa.int64()),
        ("keys", pa.binary()),
        ("lens", pa.binary()),
        ("body", pa.binary()),
        ("width", pa.int32()),
    ]
)
_CHUNKS = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("body", pa.binary()), ("lens", pa.binary())])


def _rows(n: int, schema: pa.Schema = _PACKED, **columns: pa.Array) -> pa.RecordBatch:
    """Columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _bytes(offsets: np.ndarray, data) -> pa.Array:
    """The pieces of `data` between offsets as an array, without a copy of each. A batch's data stays below 2 GB."""
    buffer = data if isinstance(data, pa.Buffer) else pa.py_buffer(data)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), buffer])


def _distinct(packed: DataFrame) -> DataFrame:
    """kind `recipe`: as they came; kind `object`: every chunk once. One bucket's chunks are in a task's memory at a time."""

    def objects(held: list[pa.RecordBatch]):
        keys, bodies = [], []
        for b in held:
            for k, n, body, width in zip(*(b.column(c).to_pylist() for c in ("keys", "lens", "body", "width")), strict=True):
                size = np.frombuffer(n, "<u4").astype(np.int64) * width
                keys.append(k), bodies.append(_bytes(np.concatenate([[0], np.cumsum(size)]), body))
        all_ = np.frombuffer(b"".join(keys), "V16")
        first = np.unique(all_, return_index=True)[1]
        once = pa.concat_arrays(bodies).take(pa.array(first))
        key = _bytes(16 * np.arange(len(first) + 1), all_[first].tobytes())
        for i in range(0, len(first), 8192):
            n = min(8192, len(first) - i)
            yield _rows(n, _CHUNKS, kind=pa.array(["object"] * n), key=key.slice(i, n), body=once.slice(i, n))

    def run(batches):
        for (bucket,), held in runs(batches, "bucket"):
            if bucket >= 0:
                yield from objects(held)
                continue
            for b in held:
                yield _rows(
                    b.num_rows,
                    _CHUNKS,
                    kind=pa.array(["recipe"] * b.num_rows),
                    doc_id=b.column("doc_id"),
                    body=b.column("keys"),
                    lens=b.column("lens"),
                )

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "kind string, key binary, doc_id long, body binary, lens binary")


def _chunks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, body binary, lens binary, kind string").parquet(f"{path}/chunks").where(F.col("kind") == kind)


def _blocks(recipes: DataFrame) -> DataFrame:
    """Each block's Merkle root over its documents in order, and its ids. A block has a bounded number of documents."""
    leaf = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"|"), "keys", "lens"), 256)
    n = _sum_lens()
    return recipes.select("block", "place", leaf.alias("leaf"), n.alias("n")).groupBy("block").agg(
        F.sum("n").alias("ids"),
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), ""), 256
        ).alias("root"),
    )


def _sum_lens():
    """Ids of a recipe: its little-endian lengths added."""
    hexed = F.hex("lens")
    word = lambda i: F.concat(*(F.substring(hexed, i * 8 + k, 2) for k in (7, 5, 3, 1)))
    return F.aggregate(
        F.sequence(F.lit(0), (F.length("lens") / 4).cast("int") - 1),
        F.lit(0).cast("long"),
        lambda s, i: s + F.conv(word(i), 16, 10).cast("long"),
    )


def _root(rows) -> str:
    """Over the blocks' roots; one row a block of documents."""
    return hashlib.sha256("".join(r["root"] for r in sorted(rows, key=lambda r: r["block"])).encode()).hexdigest()


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo crc32's, bits reflected."""
    out, a, b = np.zeros(len(a), np.uint32), a.astype(np.uint32), b.astype(np.uint32)
    for _ in range(32):
        out ^= np.where(a & np.uint32(0x80000000), b, np.uint32(0))
        a = a << np.uint32(1)
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def _powers(base: np.ndarray) -> np.ndarray:
    """base to the powers 0 to 255."""
    out = np.array([1 << 31], np.uint32)
    for _ in range(8):
        out = np.concatenate([out, times(out, np.broadcast_to(base, len(out)))])
        base = times(base, base)
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 values carried over as many following bytes; those of a document's chunks, so shifted, combine by exclusive or."""
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    powers = _powers(np.array([1 << 23], np.uint32))  # x^8
    while n.any():
        out = times(out, powers[n & 255])
        powers, n = _powers(times(powers[255:], powers[1:2])), n >> 8
    return out


def _entries(recipes: DataFrame) -> DataFrame:
    """One row per chunk of each recipe: block, place, doc_id, key, n, the ids after it in its document, and all of the document's."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, lens = b.column("keys").to_pylist(), b.column("lens").to_pylist()
            k = np.array([len(x) // 4 for x in lens])
            size = np.frombuffer(b"".join(lens), "<u4").astype(np.int64)
            row, first = np.repeat(np.arange(len(k)), k), np.cumsum(k) - k
            upto = np.concatenate([[0], np.cumsum(size)])
            total = upto[first + k] - upto[first]
            after = (upto[first] + total)[row] - upto[1:]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c).take(take) for c in ("block", "place", "doc_id")),
                    _bytes(16 * np.arange(len(row) + 1), b"".join(keys)),
                    pa.array(size),
                    pa.array(after),
                    pa.array(total[row]),
                ],
                names=["block", "place", "doc_id", "key", "n", "after", "total"],
            )

    return map_arrow(
        recipes.select("block", "place", "doc_id", "keys", "lens"),
        run,
        "block int, place long, doc_id long, key binary, n long, after long, total long",
    )


def verify(spark: SparkSession, path: str) -> None:
    """Raises if a block's or the whole manifest's root differs from what the recipe files now give."""
    manifest = spark.read.parquet(f"{path}/manifest")
    now = _blocks(spark.read.parquet(f"{path}/recipes")).select(F.col("block").alias("b"), F.col("root").alias("r"), F.col("ids").alias("i"))
    wrong = manifest.join(now, F.col("block") == F.col("b"), "full").where(
        ~F.col("root").eqNullSafe(F.col("r")) | ~F.col("ids").eqNullSafe(F.col("i"))
    ).limit(5).collect()
    root = spark.read.parquet(f"{path}/root").collect()[0]["root"]
    if wrong or root != _root(manifest.select("block", "root").collect()):
        raise ValueError(f"the store at {path} fails its manifest: {wrong}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit little-endian ids).

    Each object is read, checked against its digest and reduced to a crc; only crcs travel.
    """
    verify(spark, path)
    objects = _chunks(spark, path, "object").select("key", "body")
    wide = _width(spark, path)

    def reduce(batches):
        for b in batches:
            keys, body = b.column("key").to_pylist(), b.column("body").to_pylist()
            for k, x in zip(keys, body, strict=True):
                if hashlib.blake2b(x, digest_size=16).digest() != k:
                    raise ValueError(f"object {k.hex()} is damaged")
            ids = np.frombuffer(b"".join(body), wide).astype("<u4")
            size = np.array([len(x) for x in body], np.int64) // np.dtype(wide).itemsize
            view, ends = memoryview(ids).cast("B"), np.concatenate([[0], 4 * np.cumsum(size)]).tolist()
            crc = [zlib.crc32(view[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(crc, pa.int64()), pa.array(size)], names=["key", "crc", "size"])

    found = map_arrow(objects, reduce, "key binary, crc long, size long").withColumnRenamed("key", "k")
    joined = _entries(spark.read.parquet(f"{path}/recipes")).join(found, F.col("key") == F.col("k"), "left")

    def carry(batches):
        for b in batches:
            crc, size, n, after = (b.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "size", "n", "after"))
            if b.column("size").null_count or (size != n).any():
                raise ValueError("a recipe names an object that is absent or of another length")
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("block", "place", "doc_id", "total")), pa.array(shifted(crc, 4 * after).astype(np.int64))],
                names=["block", "place", "doc_id", "total", "crc"],
            )

    whole = map_arrow(joined, carry, "block int, place long, doc_id long, total long, crc long").groupBy("block", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("total").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    return _with_start(spark, path, written(whole))


def _width(spark: SparkSession, path: str) -> str:
    """Bytes an id takes, told from one object and its recipe's length."""
    r = spark.read.parquet(f"{path}/recipes").select("keys", "lens").take(1)
    if not r:
        return "<u2"
    key, n = bytes(r[0]["keys"][:16]), int(np.frombuffer(r[0]["lens"], "<u4")[0])
    body = _chunks(spark, path, "object").where(F.col("key") == F.lit(key)).select("body").take(1)[0]["body"]
    return f"<u{len(body) // n}"


def _with_start(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Adds `start`: ids before the block, from the manifest, and before the document within its block."""
    rows = sorted(spark.read.parquet(f"{path}/manifest").select("block", "ids").collect())
    before = np.cumsum([0, *(r["ids"] for r in rows)]).tolist()
    heads = spark.createDataFrame([(r["block"], b) for r, b in zip(rows, before, strict=False)], "head int, before long")  # a row a block
    own = F.sum("n_tokens").over(W.partitionBy("block").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return docs.withColumn("own", F.coalesce(own, F.lit(0))).join(heads, F.col("block") == F.col("head")).select(
        "doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of long) of every document, put together again from its chunks."""
    wide = _width(spark, path)
    objects = _chunks(spark, path, "object").select(F.col("key").alias("k"), "body")
    parts = _entries(spark.read.parquet(f"{path}/recipes")).join(objects, F.col("key") == F.col("k"))
    whole = parts.groupBy("block", "place").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("part"), "body"))).alias("parts")
    )

    def join(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(p["body"] for p in x), wide).astype(np.int64) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return map_arrow(whole.select("doc_id", "parts"), join, "doc_id long, ids array<long>")


def store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes the store (below the shared folder unless `path` is given) and reads it back as digests."""
    path = path or scratch(docs.sparkSession)
    write(docs, path, tokenizer)
    return digests(docs.sparkSession, path)
