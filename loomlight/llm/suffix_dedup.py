"""Removal of repeated substrings by suffix arrays.

A substring of LENGTH bytes has, among its 32-byte grams, one with the least hash; equal substrings
have equal ones. So consecutive windows that share this anchor form a unit (the windows' bytes, at
most twice the length), and only units with one anchor can hold equal windows. Units whose anchor
occurs once drop out. Each task then builds suffix arrays over the distinct units of
whole anchors by two-stage sorting: suffixes smaller than their successors are sorted directly, the
others are induced by scanning the buckets of first bytes. Adjacent common prefixes of LENGTH bytes
join windows into classes; a class with two places in the corpus is repeated, wherever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, in_filter, key_filter, raw, slices, written
from loomlight.ship import map_arrow

LENGTH, GRAM = 200, 32
#: Bytes of unit text in one suffix array, and units of one anchor beyond which they are dealt out again, by another hash and then by window.
BATCH, HOT = 3 << 20, 10_000
#: Low bits of a key that hold a gram's place within one stretch of the data.
PLACE_BITS = 23


def anchors(data: np.ndarray, length: int = LENGTH, place_bits: int = PLACE_BITS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each window start's anchor place, and the hashes of all grams. The leftmost of equal least hashes wins.

    Places are packed below the hashes, so data of more grams goes in stretches that overlap by a window.
    """
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        k = 1
        while k < GRAM:  # h[i] covers data[i : i + k]
            h[:-k] = h[:-k] * np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) + h[k:]
            k *= 2
    h = h[: max(0, len(data) - GRAM + 1)]
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h = (h ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    bits = np.uint64((1 << place_bits) - 1)
    width = length - GRAM + 1
    step = (1 << place_bits) - width + 1
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(h) - width + 1, step):
        part = h[a : a + step + width - 1]
        key, have = (part & ~bits) | np.arange(len(part), dtype=np.uint64), 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        rest = width - have
        if rest:
            key = np.minimum(key[:-rest], key[rest:])
        out.append((key & bits).astype(np.int64) + a)
    return np.concatenate(out), h


def units(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, seed: int = 0):
    """Runs of windows with one anchor, within single texts: text number, first start (in data), windows, anchor hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    place, h = anchors(data, length, seed=seed)
    begin = np.concatenate([[0], bounds[:-1]])
    size = np.maximum(0, bounds - begin - length + 1)
    doc = np.repeat(np.arange(len(bounds)), size)
    if not len(doc):
        return none, none, none, none
    start = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(doc))
    at = place[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(doc)))
    return doc[first], start[first], count, h[at[first]].view(np.int64)


def suffix_order(text: np.ndarray, need: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The suffixes marked in `need` in order (to `length` bytes at least), by two-stage sorting.

    Needed suffixes larger than their successors pull in those successors, up to one that is smaller
    than its own; only the latter are compared directly.
    """
    n = len(text)
    turn = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.full(n, n - 1)
    if len(turn):
        nxt[: turn[-1] + 1] = np.repeat(turn, np.diff(turn, prepend=-1))
    smaller = np.zeros(n, bool)
    inner = nxt < n - 1
    smaller[inner] = text[nxt[inner]] < text[nxt[inner] + 1]  # the end of the text is the least suffix
    need = need.copy()
    stop = np.where(smaller, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # where the successors of a larger suffix end
    want = np.flatnonzero(need & ~smaller)
    reach = np.minimum(stop[want], n - 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, want, 1)
    np.add.at(change, reach + 1, -1)
    need |= np.cumsum(change[:-1]) > 0
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length)
    direct = np.flatnonzero(need & smaller)
    lead = padded[direct].astype(np.uint16) << 8 | padded[direct + 1]
    by_lead = np.argsort(lead, kind="stable")
    direct, lead = direct[by_lead], lead[by_lead]
    edges = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1], [True]])) if len(direct) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            rows = np.ascontiguousarray(view[direct[a:b]])
            direct[a:b] = direct[a:b][np.argsort(rows.view(f"S{length}").ravel(), kind="stable")]
    own = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    last = n - 1  # the last suffix is induced by the empty one
    if n and need[last]:
        waiting[text[last]].append(np.array([last]))
    for c in range(256):
        ready = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        found = []
        while len(ready):
            found.append(ready)
            before = ready[ready > 0] - 1
            ready = before[(text[before] == c) & need[before] & ~smaller[before]]
        found.append(direct[own[c] : own[c + 1]])
        bucket = np.concatenate(found)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & need[before]]
        if len(before):
            chars = text[before]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(chars)).tolist(), strict=True):
                waiting[chars[x]].append(before[x:y])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH, step: int = 1 << 15) -> np.ndarray:
    """For each but the first suffix, the bytes it shares with the one before it, up to `length`."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(length, np.uint8)]), length)
    out = np.empty(max(0, len(order) - 1), np.int64)
    for a in range(0, len(out), step):
        b = min(len(out), a + step)
        same = view[order[a:b]] == view[order[a + 1 : b + 1]]
        out[a:b] = np.where(same.all(1), length, same.argmin(1))
    return out


def repeated(blobs: list[bytes], counts: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each unit, marks of its windows that occur at two places of the corpus at least."""
    text = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs])
    begin = np.cumsum(sizes) - sizes
    need = np.zeros(len(text), bool)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
    need[starts] = True
    number = np.full(len(text), -1)
    number[starts] = np.arange(len(starts))
    order = suffix_order(text, need, length)
    order = order[number[order] >= 0]
    shared = common_prefixes(text, order, length) >= length
    group = np.concatenate([[0], np.cumsum(~shared)])
    which = number[order]
    total = np.bincount(group, weights[row[which]])
    marks = np.zeros(len(starts), bool)
    marks[which] = total[group] >= 2
    return np.split(marks, np.cumsum(counts)[:-1])


def _runs(marks: np.ndarray) -> bytes:
    """Starts and ends of the runs of True, as little-endian 32-bit numbers."""
    return np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]))).astype("<i4").tobytes()


def _anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """(dig, h): the anchors of each text."""

    def run(batches):
        claim("suffix_dedup")
        for batch in slices(batches, 512 << 10):
            texts = raw(batch.column("text"))
            doc, *_, h = units(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), length)
            pairs = np.unique(np.stack([batch.column("dig").to_numpy()[doc], h], 1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["dig", "h"])

    return map_arrow(docs.select("text", "dig"), run, "dig long, h long")


def _repeated(docs: DataFrame, length: int) -> DataFrame:
    """(h): every anchor that occurs twice."""

    def run(batches):
        claim("suffix_dedup")
        for batch in slices(batches, 512 << 10):
            texts = raw(batch.column("text"))
            *_, h = units(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), length)
            keys, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["h", "n"])

    return written(map_arrow(docs.select("text"), run, "h long, n tinyint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))


PLACES = "kind string, unit binary, h long, count int, weight long, body binary, doc_id long, dig long, start long"


def _places(docs: DataFrame, length: int, most: int | None) -> DataFrame:
    """Rows of kind `unit` (once for each task) and kind `place` (each occurrence), of units whose anchor may repeat.

    A filter as large as the repeated anchors ask for picks the units. Where it would be too large to
    broadcast, each text is joined with its own repeated anchors; texts then move once.
    """
    repeated = _repeated(docs, length)
    words = key_filter(repeated, most)
    seen = docs.sparkSession.sparkContext.broadcast(words)
    if words is None:
        own = _anchors_of(docs, length).distinct().join(repeated, "h", "left_semi")
        own = written(own.groupBy("dig").agg(F.collect_list("h").alias("hs")).withColumnRenamed("dig", "od"))  # of one text
        docs = docs.join(own, F.col("dig") == F.col("od")).drop("od")
    schema = pa.schema(
        [
            ("kind", pa.string()),
            ("unit", pa.binary()),
            ("h", pa.int64()),
            ("count", pa.int32()),
            ("weight", pa.int64()),
            ("body", pa.binary()),
            ("doc_id", pa.int64()),
            ("dig", pa.int64()),
            ("start", pa.int64()),
        ]
    )

    def emit(kind, unit, h, count, weight, body, doc_id, dig, start):
        n = len(unit)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * n, pa.string()),
                pa.array(unit, pa.binary()),
                pa.array(h, pa.int64()),
                pa.array(count, pa.int32()),
                pa.array(weight, pa.int64()),
                pa.array(body, pa.binary()),
                pa.array(doc_id, pa.int64()),
                pa.array(dig, pa.int64()),
                pa.array(start, pa.int64()),
            ],
            schema=schema,
        )

    def flush(own: dict):
        rows = list(own.items())
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            none = [None] * len(part)
            yield emit(
                "unit",
                [k for k, _ in part],
                [v[0] for _, v in part],
                [v[1] for _, v in part],
                [v[2] for _, v in part],
                [v[3] for _, v in part],
                none,
                none,
                none,
            )

    def run(batches):
        claim("suffix_dedup")
        own, held = {}, 0
        for batch in slices(batches, 512 << 10):
            texts = raw(batch.column("text"))
            data, bounds = b"".join(texts), np.cumsum([len(t) for t in texts])
            doc, first, count, h = units(np.frombuffer(data, np.uint8), bounds, length)
            if seen.value is None:
                keep = np.zeros(len(h), bool)
                for i, hs in enumerate(batch.column("hs")):
                    of = slice(*np.searchsorted(doc, [i, i + 1]))
                    keep[of] = np.isin(h[of], hs.values.to_numpy())
            else:
                keep = in_filter(seen.value, h)
            doc, first, count, h = doc[keep], first[keep], count[keep], h[keep]
            keys = []
            for a, c, x in zip(first.tolist(), count.tolist(), h.tolist(), strict=True):
                body = data[a : a + c + length - 1]
                key = hashlib.blake2b(body, digest_size=16).digest()
                keys.append(key)
                if (v := own.get(key)) is None:
                    own[key] = [x, c, 1, body]
                    held += len(body) + 200
                else:
                    v[2] += 1
            ids, digs = (batch.column(c).take(pa.array(doc)) for c in ("doc_id", "dig"))
            none = [None] * len(keys)
            if keys:
                yield emit("place", keys, none, none, none, none, ids, digs, first - np.concatenate([[0], bounds[:-1]])[doc])
            if held > 48 << 20:
                yield from flush(own)
                own, held = {}, 0
        yield from flush(own)

    return map_arrow(docs, run, PLACES)


def _sorted_units(rows: DataFrame, key: str, length: int) -> DataFrame:
    """Suffix arrays over whole keys, task by task; rows (unit, count, weight, body) may repeat a unit. Returns unit and the runs of its repeated windows."""

    def batches_of(it) -> Iterator[list]:
        """Lists of [unit, count, weight, body] with all units of their keys."""
        done, group, held, last = [], [], 0, None
        for b in it:
            for k, unit, count, weight, body in zip(*(b.column(c).to_pylist() for c in (key, "unit", "count", "weight", "body")), strict=True):
                if k != last:
                    if held > BATCH:
                        yield done + group
                        done, held = [], 0
                    else:
                        done += group
                    group, last = [], k
                if group and group[-1][0] == unit:
                    group[-1][2] += weight
                else:
                    group.append([unit, count, weight, body])
                    held += len(body)
        if done or group:
            yield done + group

    def run(it):
        for part in batches_of(it):
            marks = repeated([x[3] for x in part], np.array([x[1] for x in part]), np.array([x[2] for x in part], float), length)
            rows_ = [(x[0], _runs(m)) for x, m in zip(part, marks, strict=True) if m.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows_], pa.binary()), pa.array([r[1] for r in rows_], pa.binary())], names=["unit", "runs"]
            )

    dealt = rows.select(key, "unit", "count", "weight", "body").repartition(F.col(key)).sortWithinPartitions(key, "unit")
    return map_arrow(dealt, run, "unit binary, runs binary")


def _windows(units_: DataFrame, length: int) -> DataFrame:
    """Single windows of hot units: key (of both ends of the window), parent, place, and the window as a unit of its own."""

    def run(it):
        for b in it:
            for unit, count, weight, body in zip(*(b.column(c).to_pylist() for c in ("unit", "count", "weight", "body")), strict=True):
                parts = [body[i : i + length] for i in range(count)]
                ends = [hashlib.blake2b(p[:64] + p[-64:], digest_size=8).digest() for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(b"".join(ends), "<i8")),
                        pa.array([unit] * count, pa.binary()),
                        pa.array(np.arange(count), pa.int32()),
                        pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in parts], pa.binary()),
                        pa.array([weight] * count, pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["ends", "parent", "place", "unit", "weight", "body"],
                )

    return map_arrow(units_.select("unit", "count", "weight", "body"), run, "ends long, parent binary, place int, unit binary, weight long, body binary")


def _again(units_: DataFrame, length: int, seed: int) -> DataFrame:
    """Units cut anew by the anchors of another hash: h, parent, place, unit, count, weight, body."""

    def run(it):
        claim("suffix_dedup")
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                bodies = part.column("body").to_pylist()
                data, bounds = b"".join(bodies), np.cumsum([len(x) for x in bodies])
                doc, first, count, h = units(np.frombuffer(data, np.uint8), bounds, length, seed)
                own = [data[i : i + n + length - 1] for i, n in zip(first.tolist(), count.tolist(), strict=True)]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h),
                        part.column("unit").take(take),
                        pa.array((first - np.concatenate([[0], bounds[:-1]])[doc]).astype(np.int32)),
                        pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in own], pa.binary()),
                        pa.array(count.astype(np.int32)),
                        part.column("weight").take(take),
                        pa.array(own, pa.binary()),
                    ],
                    names=["h", "parent", "place", "unit", "count", "weight", "body"],
                )

    return map_arrow(units_.select("unit", "weight", "body"), run, "h long, parent binary, place int, unit binary, count int, weight long, body binary")


def _crowded(units_: DataFrame, hot: int) -> DataFrame:
    """(hh): anchors of more than `hot` different units. Tasks may have sent the same ones, so those that may be such are counted again."""
    many = written(units_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("h").alias("hh")))
    if many.isEmpty():
        return many
    counts = units_.join(many, F.col("h") == F.col("hh"), "left_semi").groupBy("h").agg(F.count_distinct("unit").alias("n"))
    return written(counts.where(F.col("n") > hot).select(F.col("h").alias("hh")))


def _found(units_: DataFrame, length: int, hot: int, turn: int = 0) -> DataFrame:
    """(unit, runs) of written units (h, unit, count, weight, body; units may repeat). Those of hot anchors are cut by other hashes, twice, and then into windows."""
    crowded = _crowded(units_, hot)
    if crowded.isEmpty():
        return _sorted_units(units_, "h", length)
    on = F.col("h") == F.col("hh")
    rest = _sorted_units(units_.join(crowded, on, "left_anti"), "h", length)
    one = units_.join(crowded, on, "left_semi").groupBy("unit").agg(
        F.first("count").alias("count"), F.sum("weight").alias("weight"), F.first("body").alias("body")
    )
    if turn < 2:
        each = written(_again(one, length, 0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64)))
        own = written(each.groupBy("h", "unit").agg(F.first("count").alias("count"), F.sum("weight").alias("weight"), F.first("body").alias("body")))
        inner = _found(own, length, hot, turn + 1)
    else:
        each = written(_windows(one, length))
        own = each.groupBy("ends", "unit", "body").agg(F.sum("weight").alias("weight")).withColumn("count", F.lit(1))
        inner = _sorted_units(own, "ends", length)
    inner = written(inner.select(F.col("unit").alias("u"), "runs"))
    parts = each.join(inner, F.col("unit") == F.col("u")).groupBy("parent").agg(F.collect_list(F.struct("place", "runs")).alias("parts"))  # of one unit: at most its windows

    def run(it):
        for b in it:
            runs = []
            for rows in b.column("parts").to_pylist():
                marks = np.zeros(length + 1, bool)
                for r in rows:
                    x = np.frombuffer(r["runs"], "<i4") + r["place"]
                    for i, j in zip(x[::2].tolist(), x[1::2].tolist(), strict=True):
                        marks[i:j] = True
                runs.append(_runs(marks))
            yield pa.RecordBatch.from_arrays([b.column("parent"), pa.array(runs, pa.binary())], names=["unit", "runs"])

    return rest.unionByName(map_arrow(parts, run, "unit binary, runs binary"))


def spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, most: int | None = None) -> DataFrame:
    """(doc_id, dig, places): of each document with repeated bytes, pairs of unit start and runs of repeated windows."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dig"))
    every = written(_places(text, length, most), by="kind")
    unit_rows, place_rows = every.where("kind = 'unit'"), every.where("kind = 'place'").select("unit", "doc_id", "dig", "start")
    found = written(_found(unit_rows, length, hot)).withColumnRenamed("unit", "u")
    joined = place_rows.join(found, F.col("unit") == F.col("u")).select("doc_id", "dig", "start", "runs").distinct()
    return joined.groupBy("doc_id", "dig").agg(F.collect_list(F.struct("start", "runs")).alias("places"))


def remove(docs: DataFrame, length: int = LENGTH, hot: int = HOT, most: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (byte spans), kept_sha256.

    Every byte under a string of `length` bytes that starts at another place too is removed. Null
    equals empty text. Repeated rows count as further places, so texts of `length` bytes that repeat
    lose all bytes. An empty table gives no rows; further columns of `docs` are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dig"))
    found = spans(docs, length, hot, most).select(F.col("doc_id").alias("d"), F.col("dig").alias("g"), "places")
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dig") == F.col("g")), "left").select("doc_id", "text", "places")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
            ("kept", pa.binary()),
            ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches):
        claim("suffix_dedup")
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            out["doc_id"] = batch.column("doc_id").to_pylist()
            for text, places in zip(raw(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                kept, cut = text, []
                if places:
                    change = np.zeros(len(text) + 1, np.int32)
                    for p in places:
                        runs = np.frombuffer(p["runs"], "<i4").astype(np.int64) + p["start"]
                        np.add.at(change, runs[::2], 1)
                        np.add.at(change, runs[1::2] + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
                    cut = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                out["n_bytes"].append(len(text)), out["n_removed"].append(len(text) - len(kept)), out["n_spans"].append(len(cut))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest()), out["kept"].append(kept), out["removed"].append(cut)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return map_arrow(
        joined,
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>",
    )
