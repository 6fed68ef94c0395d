"""Best-fit packing of token sequences by a configuration linear program.

Items are pieces of documents, known to the driver only as a histogram of lengths (at most
`capacity` entries at any size of the corpus). Large lengths fall into classes; the linear program
over configurations (multisets of classes that fit a sequence) is solved by multiplicative weights,
each round pricing one configuration by an unbounded-knapsack dynamic program. Multiplicities are
rounded down, and what is left, with the short items, goes best-fit into the gaps. Plans, ranks and
places are intervals over lengths, so no step sees single documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import rank_within, slices, written
from loomlight.llm.tokens import encoder, tokenizer_json
from loomlight.ship import map_arrow

CAPACITY = 4096
END_ID = 1


def classes_of(hist: dict[int, int], most: int, unit: int) -> list[tuple[int, list[list[int]]]]:
    """Up to `most` classes of lengths with about equal counts: (length rounded up to `unit`, [length, count] falling)."""
    total, out, got = sum(hist.values()), [], 0
    for length in sorted(hist, reverse=True):
        size = -(-length // unit)
        if out and (got < total / most and out[-1][0] - size <= 16 or out[-1][0] == size):
            out[-1][1].append([length, hist[length]])
            got += hist[length]
        else:
            out.append((size, [[length, hist[length]]]))
            got = hist[length]
    return out


def price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of classes that fits: unbounded knapsack by dynamic programming."""
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            x = best[c - s[:k]] + v[:k]
            j = int(x.argmax())
            if x[j] > best[c]:
                best[c], pick[c] = x[j], j
    out, c = defaultdict(int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[int(order[pick[c]])] += 1
            c -= int(s[pick[c]])
    return dict(out)


def solve(sizes: np.ndarray, need: np.ndarray, capacity: int, step: float = 0.1, rounds: int = 900) -> list[tuple[dict[int, int], float]]:
    """Fractional configurations covering `need`, by multiplicative weights over the classes.

    A class starts with a price in proportion to its size, the dual of the volume bound; every round
    takes the best priced configuration and lowers the weights of what it covers.
    """
    price_of, covered, out = sizes / capacity, np.zeros(len(sizes)), defaultdict(float)
    for _ in range(rounds):
        config = price(sizes, price_of * np.exp(-2.0 * covered), capacity)
        if not config:
            break
        k = np.fromiter(config, int)
        a = np.fromiter(config.values(), float)
        much = step * (need[k] / a).min()
        covered[k] += a * much / need[k]
        out[tuple(sorted(config.items()))] += much
        if covered.min() >= 1:
            break
    return [(dict(c), x) for c, x in sorted(out.items(), key=lambda y: -y[1])]


def plan(hist: dict[int, int], capacity: int = CAPACITY, small: int = 256, classes: int = 192, unit: int = 8, passes: int = 2) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, count, offset), and the number of sequences.

    A row puts `count` items of `length`, from `first rank` on, into as many following sequences at
    one offset. Works on the histogram alone; its size depends on the lengths, not on the items.
    """
    hist = {int(k): int(n) for k, n in hist.items() if n > 0}
    given, rows, bins, n_bins = defaultdict(int), [], defaultdict(list), 0

    def put(length: int, count: int, first: int, at: int) -> None:
        rows.append((length, given[length], first, count, at))
        given[length] += count

    left = dict(hist)
    there = sorted(left)

    def take(length: int, count: int, first: int, used: int) -> None:
        put(length, count, first, used)
        left[length] -= count
        if not left[length]:
            there.pop(bisect_left(there, length))

    for _ in range(passes):
        groups = classes_of({k: n for k, n in left.items() if n and k > small}, classes, unit)
        if not groups:
            break
        members = [[length for length, _ in g[1]] for g in groups]
        sizes, need = np.array([g[0] for g in groups]), np.array([sum(n for _, n in g[1]) for g in groups], float)
        for config, x in solve(sizes, need, capacity // unit):
            m = min(int(x), *(sum(left[y] for y in members[k]) // a for k, a in config.items()))
            if m < 1:
                continue
            segments, slots = [(n_bins, m, 0)], sorted((k for k, a in config.items() for _ in range(a)), key=lambda k: -sizes[k])
            for slot, k in enumerate(slots):
                after, last = [], slot == len(slots) - 1
                for first, count, used in segments:
                    while count:
                        if last:  # rounding: the last item is the one that fits best, of any class
                            i = bisect_right(there, capacity - used) - 1
                            if i < 0:
                                after.append((first, count, used))
                                break
                            length = there[i]
                        else:
                            length = next(y for y in members[k] if left[y])
                        much = min(count, left[length])
                        take(length, much, first, used)
                        after.append((first, much, used + length))
                        first, count = first + much, count - much
                segments = after
            n_bins += m
            for first, count, used in segments:
                bins[capacity - used].append((first, count))
    free = sorted(x for x in bins if x)
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        count = left[length]
        while count:
            i = bisect_left(free, length)
            if i == len(free):
                per = capacity // length
                opened = -(-count // per)
                bins[capacity].append((n_bins, opened))
                n_bins += opened
                if capacity not in free:
                    free.append(capacity)
                continue
            gap = free[i]
            first, m = bins[gap].pop()
            if not bins[gap]:
                free.pop(i)
            much = min(m, count)
            put(length, much, first, capacity - gap)
            count -= much
            for slack, seg in ((gap, (first + much, m - much)), (gap - length, (first, much))):
                if seg[1]:
                    if slack:
                        j = bisect_left(free, slack)
                        if j == len(free) or free[j] != slack:
                            free.insert(j, slack)
                    bins[slack].append(seg)
    return np.array(rows, np.int64).reshape(-1, 5), n_bins


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids; only longer documents are cut. `with_ids` adds the ids as little-endian binary."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def run(batches):
        enc = encoder(definition.value)
        for batch in slices(batches, 8 << 20):
            ids, counts = enc.encode(batch.column("text"))
            counts = counts + 1
            ends = np.cumsum(counts)
            full = np.empty(int(ends[-1]), "<u4")
            mask = np.ones(len(full), bool)
            mask[ends - 1] = False
            full[mask], full[~mask] = ids, end_id
            parts = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            base = (ends - counts)[row] + start
            view = memoryview(full).cast("B")
            blobs = [view[4 * b : 4 * (b + n)] for b, n in zip(base.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(row)).cast(pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([bytes(b) for b in blobs], pa.binary())] if with_ids else []), schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, ddl)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with sequence_id and offset; `with_ids` keeps the ids.

    Null or empty texts become a piece of the end id alone; repeated rows are packed each; an empty
    table gives no rows; further columns of `docs` are ignored. Ties in length are packed in any order.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids))
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan(hist, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    share = spark.sparkContext.broadcast(rows)
    ranked = rank_within(cut, "length", ["doc_id", "piece", "ids_crc32"])
    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches):
        p = share.value
        key = p[:, 0] * (1 << 44) + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(p[i, 2] + rank - p[i, 1]), pa.array(p[i, 4])], names=names)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return map_arrow(ranked, place, ddl)
