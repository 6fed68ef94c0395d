"""Exact Jaccard self-join of word-shingle sets, with set relations used to skip work.

1. Each set's tokens are dealt by hash into somewhat more parts than partners can differ in, so
   partners have whole parts in common. Sets that share too few parts with others drop out, exactly.
2. The others enter inverted lists by their prefix tokens, rarest first by exact counts, in blocks
   by size and position.
3. Answers are derived along set relations. Every set is verified against the most frequent leader
   of its lists; sets joined to one leader share its class and are not compared for it again.
4. The lists are then read block by block. Block pairs whose sizes or positions rule out the overlap
   are skipped, as are those whose sets already share one class; what remains is verified.
5. A class keeps its leader's tokens once and of each other set only the difference from the leader.
   Every overlap within the class follows from two differences, and blocks of sets that are near
   enough to the leader, or too far apart, are counted or skipped as a whole.

All steps are shuffles of bounded groups, whatever the size of the corpus; nothing is sized to fit
one machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.llm.common import claim, one_of_each, remove, row_key, runs, scratch, slices, written
from loomlight.llm.components import components
from loomlight.ship import map_arrow

#: Parts beyond those that partners may differ in: one for each so many.
SLACK = 10
#: Parts that a task holds before it sends them on, and tokens of one block when tokens are counted.
HELD, COUNTED = 4 << 20, 1 << 20
#: Positions in one block of an inverted list.
BLOCK = 16
#: Most rows (8 bytes each) of the texts wanted again that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 21
#: An owner of a part that needs no answer, and a number of shared parts that no set reaches.
NOBODY, NEVER = 0xFFFFFFFF, 1 << 30


class Sets:
    """Shingle sets of texts, and what a threshold in percent asks of partners."""

    def __init__(self, words: int, threshold: int):
        self.k, self.t = words, threshold
        edges = [1]
        while edges[-1] < 1 << 32 and threshold < 100:
            edges.append(edges[-1] * 100 // threshold + 1)
        #: A partner of a set in one band of sizes, if larger, is in the same band or the next.
        self.edges = np.array(edges, np.int64)
        least = self.edges[1:] - 1
        #: For each band: tokens that a set of it and a larger partner differ in at most; parts of these that must be equal.
        self.apart = (100 - threshold) * (least + least * 100 // threshold) // (100 + threshold)
        self.equal = 2 + self.apart // SLACK

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text's shingles; words of one batch are hashed once each."""
        import xxhash

        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        flat = split.flatten()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        coded = flat.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))
        index = coded.indices.to_numpy(zero_copy_only=False)
        if "" in own:  # outer white space leaves empty strings at the ends
            real = index != own.index("")
            index, doc = index[real], doc[real]
        h = table[index]
        counts = np.bincount(doc, minlength=len(counts))
        with np.errstate(over="ignore"):
            mixed = np.zeros(len(h), np.uint64)
            for j in range(self.k):
                shifted = np.zeros(len(h), np.uint64)
                shifted[: max(0, len(h) - j)] = h[j:]
                mixed = (mixed ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
        out, at = [], 0
        for n in counts.tolist():
            if n >= self.k:
                out.append(np.unique(mixed[at : at + n - self.k + 1]))
            elif n:
                out.append(np.frombuffer(hashlib.blake2b(h[at : at + n].tobytes(), digest_size=8).digest(), np.uint64).copy())
            else:
                out.append(h[:0])
            at += n
        return out

    def least(self, n: int) -> int:
        """Common tokens a set of n tokens needs with any partner."""
        return -(-n * self.t // 100)

    def parts(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(side, hashes of the set's parts, parts that it must share) as the smaller partner (side 0) and as the larger one (1).

        Of `apart + equal` parts, partners differ in at most `apart`. An empty part counts as shared.
        """
        band = int(np.searchsorted(self.edges, len(s), "right")) - 1
        for side, j in ((0, band), (1, band - 1)):
            if not 0 <= j < len(self.apart) or not self.apart[j]:
                continue  # partners under this band are equal sets
            many = int(self.apart[j] + self.equal[j])
            part = ((s >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            with np.errstate(over="ignore"):
                h = s * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h = np.add.reduceat(h * np.uint64(0xD6E8FEB86659FD93), cut)
                h ^= part[cut].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= np.uint64(j + 1) * np.uint64(0x165667B19E3779F9)
                h *= np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            yield side, h, int(self.equal[j]) - (many - len(cut))


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte place by byte place, so that equal high bytes stand together and compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplaned(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _falling(keys: np.ndarray) -> bytes:
    """Sorted numbers as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _risen(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(blob, np.uint64), dtype=np.uint64)


_ROW = [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("tk", pa.int64()), ("key", pa.string())]
_SENT = pa.schema(
    [
        ("part", pa.int32()),
        ("owner", pa.int64()),
        *_ROW,
        ("need0", pa.int32()),
        ("need1", pa.int32()),
        ("parts", pa.binary()),
        ("owners", pa.binary()),
    ]
)
_MET = pa.schema([("kind", pa.string()), ("owner", pa.int64()), *_ROW, ("need0", pa.int32()), ("need1", pa.int32()), ("shared", pa.int32())])
_ROW_DDL = "doc_id long, n long, sig binary, tk long, key string, need0 int, need1 int"


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """Columns that are not given are null."""
    arrays = [
        columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _sent(docs: DataFrame, sets: Sets, buckets: int) -> DataFrame:
    """Two kinds of rows: each document (part below 0), and packed parts of sets with their owners (part: the bucket).

    An owner is a set as its task saw it: 2 x its number, and the side. Parts that several sets of a
    task have are shared already; one of them goes on as nobody's, so a part takes one place a task.
    The numbers need the same rows in the same order if a task runs again: `docs` is read from files.
    """

    def run(batches):
        claim("jaccard_join")
        task, turn = TaskContext.get().partitionId(), 0
        known, parts, owners, needs, rows, size = {}, [], [], [], [], 0

        def flush():
            base = (task << 39) | (turn << 23)
            keys, own = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((parts, np.uint64), (owners, np.uint32)))
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
            first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
            many = np.diff(first, append=len(keys))
            need = np.array(needs, np.int64).reshape(-1, 2).ravel()
            need -= np.bincount(own[np.repeat(many > 1, many)], minlength=len(need))
            keys, own = keys[first], np.where(many > 1, np.uint32(NOBODY), own[first])
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            ends = list(zip(cut, [*cut[1:], len(keys)][: len(cut)], strict=True))
            for i in range(0, len(ends), 4096):
                some = ends[i : i + 4096]
                yield _batch(
                    _SENT,
                    len(some),
                    part=[int(bucket[a]) for a, _ in some],
                    owner=[base] * len(some),
                    parts=[_falling(keys[a:b]) for a, b in some],
                    owners=[_planes(own[a:b]) for a, b in some],
                )
            for place, (columns, n, sig, number) in enumerate(rows):
                at = np.array(number)
                have = at >= 0
                side = lambda s: pa.array(np.where(have, need[2 * at + s] if len(need) else 0, NEVER), pa.int32())  # noqa: B023, E731
                yield _batch(
                    _SENT,
                    len(n),
                    part=[-1 - (task * 31 + turn * 7 + place) % 4096] * len(n),
                    owner=pa.array(base + 2 * at, pa.int64(), mask=~have),
                    n=n,
                    sig=sig,
                    need0=side(0),
                    need1=side(1),
                    **columns,
                )

        for batch in slices(batches):
            n, sig, number = [], [], []
            for s in sets.of(batch.column("text")):
                n.append(len(s))
                if not len(s):
                    sig.append(None), number.append(-1)
                    continue
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sig.append(key)
                if key not in known:
                    known[key] = len(known)
                    need = [NEVER, NEVER]
                    for side, h, least in sets.parts(s):
                        parts.append(h), owners.append(np.full(len(h), 2 * known[key] + side, np.uint32))
                        need[side], size = least, size + len(h)
                    needs.append(need)
                number.append(known[key])
            rows.append(({c: batch.column(c) for c in ("doc_id", "tk", "key")}, n, sig, number))
            if size > HELD or len(known) > HELD // 2 - (1 << 16):
                yield from flush()
                known, parts, owners, needs, rows, size = {}, [], [], [], [], 0
                turn += 1
        yield from flush()

    ddl = f"part int, owner long, {_ROW_DDL}, parts binary, owners binary"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key(), row_key().alias("key"))
    return map_arrow(own, run, ddl)


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("tk")


def _met(sent: DataFrame) -> DataFrame:
    """kind `doc`: the documents as sent; kind `shared`: owners, with how many of their parts another task's sets have."""

    def run(batches):
        claim("jaccard_join")
        for (part,), held in runs(batches, "part"):
            if part < 0:
                for b in held:
                    yield _batch(
                        _MET,
                        b.num_rows,
                        kind=["doc"] * b.num_rows,
                        **{c: b.column(c) for c in ("owner", "doc_id", "n", "sig", "tk", "key", "need0", "need1")},
                    )
                continue
            keys, owners = [], []
            for b in held:
                for base, p, o in zip(*(b.column(c).to_pylist() for c in ("owner", "parts", "owners")), strict=True):
                    keys.append(_risen(p))
                    own = _unplaned(o, np.uint32)
                    owners.append(np.where(own == NOBODY, -1, base + own.astype(np.int64)))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            twice = np.zeros(len(keys), bool)
            twice[1:] = keys[1:] == keys[:-1]
            twice[:-1] |= twice[1:]
            who, many = np.unique(owners[twice & (owners >= 0)], return_counts=True)
            yield _batch(_MET, len(who), kind=["shared"] * len(who), owner=who, shared=many.astype(np.int32))

    dealt = sent.repartition("part").sortWithinPartitions("part")
    return map_arrow(dealt, run, f"kind string, owner long, {_ROW_DDL}, shared int")


def _live(docs: DataFrame, sets: Sets) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n, sig, key); the sets that may have partners (sig, tk of one text that has it, n)."""
    spark = docs.sparkSession
    buckets = max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = written(_met(_sent(docs, sets, buckets)), by="kind")
    base = met.where("kind = 'doc'")
    own = F.col("owner").bitwiseAND(F.lit(1))
    counts = met.where("kind = 'shared'").groupBy(F.expr("owner - (owner & 1L)").alias("o")).agg(
        F.sum(F.when(own == 0, F.col("shared")).otherwise(0)).alias("s0"),
        F.sum(F.when(own == 1, F.col("shared")).otherwise(0)).alias("s1"),
    )
    enough = (F.col("need0") <= F.coalesce("s0", F.lit(0))) | (F.col("need1") <= F.coalesce("s1", F.lit(0)))
    some = base.where("sig is not null").join(counts, F.col("owner") == F.col("o"), "left").where(enough)
    live = written(some.groupBy("sig").agg(F.min("tk").alias("tk"), F.first("n").alias("n")))
    return base.select("doc_id", "n", "sig", "key"), live


def _bodies(docs: DataFrame, sets: Sets, live: DataFrame) -> DataFrame:
    """(sig, tokens) of the live sets, read from their texts again; sets may repeat."""
    wanted = live.select(F.col("tk").alias("wk")).distinct()
    few = live.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("text").cast("string").alias("text"), _text_key())
    texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("tk") == F.col("wk"), "left_semi").select("text")

    def run(batches):
        claim("jaccard_join")
        done = set()
        for batch in slices(batches):
            keys, bodies = [], []
            for s in sets.of(batch.column("text")):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and key not in done:
                    done.add(key), keys.append(key), bodies.append(s.tobytes())
            if len(done) > 1 << 18:
                done = set()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["sig", "tokens"])

    return map_arrow(texts, run, "sig binary, tokens binary")


_BLOCK = pa.schema([("kind", pa.string()), ("blk", pa.int32()), ("sig", pa.binary()), ("tokens", pa.binary()), ("bucket", pa.int32()), ("many", pa.binary())])


def _blocked(bodies: DataFrame, blocks: int) -> DataFrame:
    """kind `set`: each set once, in blocks; kind `key`: each block's distinct tokens by bucket, with how many of its sets have them."""

    def run(batches):
        claim("jaccard_join")
        for (blk,), held in runs(batches, "blk"):
            sigs, bodies, last = [], [], None
            for b in held:
                for sig, tokens in zip(b.column("sig").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                    if sig != last:
                        sigs.append(sig), bodies.append(tokens)
                    last = sig
            for i in range(0, len(sigs), 2048):
                yield _batch(
                    _BLOCK,
                    len(sigs[i : i + 2048]),
                    kind=["set"] * len(sigs[i : i + 2048]),
                    blk=[blk] * len(sigs[i : i + 2048]),
                    sig=sigs[i : i + 2048],
                    tokens=bodies[i : i + 2048],
                )
            keys, many = np.unique(np.frombuffer(b"".join(bodies), np.uint64), return_counts=True)
            bucket = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            ends = list(zip(cut, [*cut[1:], len(keys)], strict=True))
            many = many.astype(np.uint32)
            yield _batch(
                _BLOCK,
                len(ends),
                kind=["key"] * len(ends),
                blk=[blk] * len(ends),
                bucket=bucket[cut],
                tokens=[_falling(keys[a:b]) for a, b in ends],
                many=[_planes(many[a:b]) for a, b in ends],
            )

    dealt = bodies.withColumn("blk", F.pmod(F.xxhash64("sig"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition("blk").sortWithinPartitions("blk", "sig")
    return written(map_arrow(dealt, run, "kind string, blk int, sig binary, tokens binary, bucket int, many binary"), by="kind")


def _levels(keys: DataFrame) -> DataFrame:
    """(blk, tokens, level): for each block the tokens that two sets have, and a level that grows with how many have them."""

    def run(batches):
        claim("jaccard_join")
        for _, held in runs(batches, "bucket"):
            blks = [x for b in held for x in b.column("blk").to_pylist()]
            each = [_risen(x) for b in held for x in b.column("tokens").to_pylist()]
            many = np.concatenate([_unplaned(x, np.uint32) for b in held for x in b.column("many").to_pylist()])
            all_, place = np.unique(np.concatenate(each), return_inverse=True)
            total = np.bincount(place, many, len(all_))
            level = np.minimum(255, 16 * np.log2(np.maximum(1, total))).astype(np.uint8)
            level[total < 2] = 0
            out, at = [[], []], 0
            for x in each:
                own = level[place[at : at + len(x)]]
                out[0].append(_falling(x[own > 0])), out[1].append(own[own > 0].tobytes())
                at += len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blks, pa.int32()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["blk", "tokens", "level"]
            )

    dealt = keys.select("blk", "bucket", "tokens", "many").repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, run, "blk int, tokens binary, level binary")


def _postings(distinct: DataFrame, levels: DataFrame, sets: Sets) -> DataFrame:
    """token, sig, n, pos, band, block: of each set's prefix, rarest tokens first (ties by hash), those that another set has."""

    def run(batches):
        claim("jaccard_join")
        for _, held in runs(batches, "blk"):
            keys, level, rows = [], [], []
            for b in held:
                for side, sig, tokens, own in zip(*(b.column(c).to_pylist() for c in ("side", "sig", "tokens", "level")), strict=True):
                    if side:
                        rows.append((sig, tokens))
                    else:
                        keys.append(_risen(tokens)), level.append(np.frombuffer(own, np.uint8))
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            level = np.concatenate(level) if level else np.zeros(0, np.uint8)
            order = np.argsort(keys, kind="stable")
            keys, level = keys[order], level[order]
            for i in range(0, len(rows), 2048):
                yield posted(rows[i : i + 2048], keys, level)

    def posted(rows, keys, level):
        got, sizes, pos = [], [], []
        for _, x in rows:
            s = np.frombuffer(x, np.uint64)
            near = np.minimum(np.searchsorted(keys, s), max(0, len(keys) - 1))
            own = np.where(keys[near] == s, level[near], 0) if len(keys) else np.zeros(len(s), np.uint8)
            first = np.argsort(own, kind="stable")[: len(s) - sets.least(len(s)) + 1]
            place = np.flatnonzero(own[first] > 0)
            got.append(s[first[place]]), pos.append(place), sizes.append(len(s))
        many = np.array([len(p) for p in pos], np.int64)
        row = np.repeat(np.arange(len(rows)), many)
        n, pos = np.array(sizes)[row], np.concatenate(pos)
        band = (np.searchsorted(sets.edges, n, "right") - 1).astype(np.int32)
        sig = pa.array([r[0] for r in rows], pa.binary()).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(got).view(np.int64)),
                sig,
                pa.array(n.astype(np.int64)),
                pa.array(pos.astype(np.int64)),
                pa.array(band),
                pa.array((pos // BLOCK).astype(np.int32)),
            ],
            names=["token", "sig", "n", "pos", "band", "block"],
        )

    own = distinct.select("blk", F.lit(1).alias("side"), "sig", "tokens", F.lit(None).cast("binary").alias("level"))
    asked = levels.select("blk", F.lit(0).alias("side"), F.lit(None).cast("binary").alias("sig"), "tokens", "level")
    dealt = own.unionByName(asked).repartition("blk").sortWithinPartitions("blk", "side")
    return map_arrow(dealt, run, "token long, sig binary, n long, pos long, band int, block int")


def _verified(pairs: DataFrame, distinct: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) of sigs whose sets reach the threshold, with `diff`, the tokens that only one of them has."""
    x = distinct.select(F.col("sig").alias("sx"), F.col("tokens").alias("tx"))
    y = distinct.select(F.col("sig").alias("sy"), F.col("tokens").alias("ty"))
    both = pairs.join(y, F.col("b") == F.col("sy")).select("a", "b", "ty").join(x, F.col("a") == F.col("sx")).select("a", "b", "tx", "ty")

    def run(batches):
        claim("jaccard_join")
        for batch in batches:
            keep, diffs = [], []
            for p, q in zip(batch.column("tx").to_pylist(), batch.column("ty").to_pylist(), strict=True):
                diff = _differing(p, q)
                keep.append((100 + t) * len(diff) <= (100 - t) * (len(p) + len(q)) // 8 and len(diff) * 8 < len(p) + len(q))
                if keep[-1]:
                    diffs.append(diff.tobytes())
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(diffs, pa.binary())], names=["a", "b", "diff"]
            )

    return map_arrow(both, run, "a binary, b binary, diff binary")


def _differing(p: bytes, q: bytes) -> np.ndarray:
    """The tokens that one of two sets has and the other has not, sorted."""
    both = np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])
    both.sort(kind="stable")
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    twice[:-1] |= twice[1:]
    return both[~twice]


def _posting() -> Column:
    return F.struct("sig", "n", "pos")


def _overlap_possible(x: str, y: str, t: int) -> Column:
    """Whether sizes and positions at a common token leave two postings room for the threshold."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (100 * F.least(nx, ny) >= t * F.greatest(nx, ny)) & ((100 + t) * (1 + F.least(nx - px - 1, ny - py - 1)) >= t * (nx + ny))


def _leaders(postings: DataFrame) -> DataFrame:
    """Each set (b) with the leader (a) that most of its lists have, within one size band.

    A list's leader has its token at the earliest position: fewest rarer tokens stand before it, so it
    is the one nearest to what the list's sets have in common.
    """
    lists = postings.groupBy("token", "band").agg(F.min_by("sig", F.struct("pos", "sig")).alias("lead"), F.count(F.lit(1)).alias("k"))
    lists = written(lists.where("k > 1").select(F.col("token").alias("lt"), F.col("band").alias("lb"), "lead"))
    near = postings.join(lists, (F.col("token") == F.col("lt")) & (F.col("band") == F.col("lb"))).where(F.col("sig") != F.col("lead"))
    votes = near.groupBy("sig", "lead").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("sig").agg(F.max_by("lead", F.struct("votes", "lead")).alias("lead")).select(F.col("lead").alias("a"), F.col("sig").alias("b"))


def _mixed(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings with their set's class, of tokens that sets of several classes have."""
    held = postings.join(roots, F.col("sig") == F.col("node"), "left").select(
        "token", "sig", "n", "pos", "band", "block", F.coalesce("root", "sig").alias("root")
    )
    held = written(held)
    several = written(held.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(F.col("token").alias("mt")))
    return written(held.join(several, F.col("token") == F.col("mt"), "left_semi"))


def _neighbours(held: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of sets that stand for their classes: each list's leading sets, with one set of every other class of the band or the next."""
    one = lambda name, by: F.min_by(_posting(), F.struct(*by, "sig")).alias(name)
    lists = held.groupBy("token", "band").agg(one("first", ["pos"]), F.max_by(F.struct("sig", "n", "pos"), F.struct("n", "sig")).alias("large"))
    lists = written(lists.select(F.col("token").alias("lt"), F.col("band").alias("lb"), "first", "large"))
    reps = written(held.groupBy("token", "band", "root").agg(one("own", ["pos"]), one("small", ["n"])))
    same = reps.join(lists, (F.col("token") == F.col("lt")) & (F.col("band") == F.col("lb"))).select(F.col("first").alias("x"), F.col("own").alias("y"))
    next_ = reps.join(lists, (F.col("token") == F.col("lt")) & (F.col("band") == F.col("lb") + 1)).select(F.col("large").alias("x"), F.col("small").alias("y"))
    both = same.unionByName(next_).where((F.col("x.sig") != F.col("y.sig")) & _overlap_possible("x", "y", t))
    return both.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _rest(held: DataFrame, t: int) -> DataFrame:
    """Pairs of different classes that the lists leave open, by pairs of blocks that cannot be skipped."""
    names = ("band", "block", "n0", "n1", "p0", "r0", "r1")
    blocks = written(
        held.groupBy("token", "band", "block").agg(
            F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.min("root").alias("r0"), F.max("root").alias("r1")
        )
    )
    x, y = (blocks.select(F.col("token").alias(f"t{s}"), *(F.col(c).alias(f"{c}_{s}") for c in names)) for s in "xy")
    two = x.join(y, (F.col("tx") == F.col("ty")) & (F.col("band_x") <= F.col("band_y")) & (F.col("band_y") <= F.col("band_x") + 1))
    one_class = (F.col("r0_x") == F.col("r1_x")) & (F.col("r0_y") == F.col("r1_y")) & (F.col("r0_x") == F.col("r0_y"))
    sizes = 100 * F.col("n1_x") >= t * F.col("n0_y")
    ahead = (100 + t) * (1 + F.least(F.col("n1_x") - F.col("p0_x") - 1, F.col("n1_y") - F.col("p0_y") - 1)) >= t * (F.col("n0_x") + F.col("n0_y"))
    open_ = two.where(~one_class & sizes & ahead).select("tx", "band_x", "block_x", "band_y", "block_y")
    at = lambda s: (F.col("tx") == F.col(f"token{s}")) & (F.col(f"band_{s}") == F.col(f"band{s}")) & (F.col(f"block_{s}") == F.col(f"block{s}"))
    x, y = (held.select(*(F.col(c).alias(f"{c}{s}") for c in ("token", "band", "block", "root")), _posting().alias(s)) for s in "xy")
    pairs = open_.join(x, at("x")).join(y, at("y")).where((F.col("rootx") != F.col("rooty")) & _overlap_possible("x", "y", t))
    return pairs.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _classed(docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, n, sig, key); all sets (sig, rep, copies, n, root); tokens of the live ones (sig, tokens); leaders' links (a, b, diff)."""
    spark = docs.sparkSession
    sets = Sets(words, threshold)
    base, live = _live(docs, sets)
    blocks = max(1, -(-(live.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0) // COUNTED))
    blocked = _blocked(_bodies(docs, sets, live), blocks)
    distinct = blocked.where("kind = 'set'").select("blk", "sig", "tokens")
    levels = scratch(spark)
    postings = written(_postings(distinct, written(_levels(blocked.where("kind = 'key'")), levels), sets))
    remove(spark, levels)
    links = written(_verified(_leaders(postings), distinct, threshold))
    ends = links.select("a", "b")
    roots = written(components(ends))
    held = _mixed(postings, roots)
    for pairs in (_neighbours, _rest):
        more = written(_verified(pairs(held, threshold), distinct, threshold).select("a", "b"))
        if not more.isEmpty():
            ends = ends.unionByName(more)
            roots = written(components(ends))
            held = _mixed(postings, roots) if pairs is _neighbours else held
    reps = written(base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    labels = reps.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "rep", "copies", "n", F.coalesce("root", "sig").alias("root"))
    return base, written(labels), distinct.drop("blk"), links


def _component(labels: DataFrame) -> DataFrame:
    """s, copies, label: each set's least doc_id of its class."""
    least = written(labels.groupBy("root").agg(F.min("rep").alias("label")).withColumnRenamed("root", "r"))
    return labels.join(least, F.col("root") == F.col("r")).select(F.col("sig").alias("s"), "copies", "label")


def classes(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links of `threshold` percent).

    Fewer words than a shingle has: all of them are one shingle. Null, empty and blank texts have the
    empty set and no links. Equal sets link. Rows that repeat a doc_id are documents of their own; a
    null doc_id is passed over when the least is taken. An empty table gives no rows. Ties between
    leaders are settled by digest and do not change results.
    """
    base, labels, _, _ = _classed(docs, words, threshold)
    return base.join(written(_component(labels)), F.col("sig") == F.col("s"), "left").select(*_answer())


def _answer() -> list:
    return [F.col("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")]


def _profiles(members: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Each set of `members` (sig, copies, n, root) by its difference from its class's leader: root, sig, n, copies, d (tokens), diff.

    The leader is the set that most of the class were verified against; for these the difference is known.
    """
    led = written(links.groupBy("a").agg(F.count(F.lit(1)).alias("led")))
    many = members.join(led, F.col("sig") == F.col("a"), "left").select("root", "sig", F.coalesce("led", F.lit(0)).alias("led"))
    leads = written(many.groupBy("root").agg(F.max_by("sig", F.struct("led", "sig")).alias("lead")).withColumnRenamed("root", "lr"))
    own = members.join(leads, F.col("root") == F.col("lr")).drop("lr")
    given = own.join(
        links.select("a", "b", "diff"), (F.col("sig") == F.col("b")) & (F.col("lead") == F.col("a")), "left"
    ).select("root", "sig", "n", "copies", "lead", "diff")
    given = written(given.withColumn("diff", F.when(F.col("sig") == F.col("lead"), F.lit(b"")).otherwise(F.col("diff"))))
    x = distinct.select(F.col("sig").alias("sx"), F.col("tokens").alias("tx"))
    y = distinct.select(F.col("sig").alias("sy"), F.col("tokens").alias("ty"))
    open_ = written(given.where("diff is null").drop("diff").join(x, F.col("sig") == F.col("sx")).drop("sx"))
    both = open_.join(written(y.join(leads.select("lead").distinct(), F.col("sy") == F.col("lead"), "left_semi")), F.col("lead") == F.col("sy"))

    def run(batches):
        claim("jaccard_join")
        for b in batches:
            diff = [_differing(p, q).tobytes() for p, q in zip(b.column("tx").to_pylist(), b.column("ty").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("root", "sig", "n", "copies")), pa.array(diff, pa.binary())],
                names=["root", "sig", "n", "copies", "diff"],
            )

    rest = map_arrow(both.select("root", "sig", "n", "copies", "tx", "ty"), run, "root binary, sig binary, n long, copies long, diff binary")
    every = given.where("diff is not null").select("root", "sig", "n", "copies", "diff").unionByName(rest)
    return written(every.withColumn("d", F.expr("length(diff) div 8")))


def _partners(profiles: DataFrame, t: int, most: int) -> DataFrame:
    """For each set that links to another one, the copies of all such: s, partners.

    Sets of a class stand by distance from its leader, in blocks of about `most`. Two sets differ in
    at most the sum of their distances and at least the difference of them, which settles most pairs
    of blocks at once. In the others, sets are compared by what their differences have in common.
    Rows grow with pairs of blocks, not of sets.
    """
    steps = profiles.groupBy("root", "d").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("root").orderBy("d").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")  # a row for each distance
    steps = written(steps.withColumn("g", F.floor(before / most).cast("int")).select(F.col("root").alias("sr"), F.col("d").alias("sd"), "g"))
    placed = profiles.join(steps, (F.col("root") == F.col("sr")) & (F.col("d") == F.col("sd"))).select("root", "g", "sig", "n", "copies", "d", "diff")
    placed = written(placed)
    stats = placed.groupBy("root", "g").agg(
        F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.count(F.lit(1)).alias("k"), F.sum("copies").alias("weight")
    )
    stats = written(stats.withColumn("parts", F.ceil(F.col("k") / most).cast("int")))
    names = ("g", "d0", "d1", "n0", "n1", "weight", "parts")
    x, y = (stats.select(F.col("root").alias(f"r{s}"), *(F.col(c).alias(f"{c}{s}") for c in names)) for s in "xy")
    two = x.join(y, (F.col("rx") == F.col("ry")) & (F.col("gx") <= F.col("gy")))
    sure = (100 + t) * (F.col("d1x") + F.col("d1y")) <= (100 - t) * (F.col("n0x") + F.col("n0y"))
    never = (100 + t) * (F.col("d0y") - F.col("d1x")) > (100 - t) * (F.col("n1x") + F.col("n1y"))
    two = written(two.withColumn("sure", sure).where(sure | ~never).select("rx", "gx", "gy", "sure", "weightx", "weighty", "partsx", "partsy"))
    whole = two.where("sure")
    given = whole.select("rx", F.col("gx").alias("wg"), F.col("weighty").alias("w")).unionByName(
        whole.where("gx <> gy").select("rx", F.col("gy").alias("wg"), F.col("weightx").alias("w"))
    )
    given = written(given.groupBy(F.col("rx").alias("wr"), "wg").agg(F.sum("w").alias("w"), F.lit(True).alias("there")))
    itself = written(whole.where("gx = gy").select(F.col("rx").alias("ir"), F.col("gx").alias("ig")))
    counted = placed.join(given, (F.col("root") == F.col("wr")) & (F.col("g") == F.col("wg"))).join(
        itself, (F.col("root") == F.col("ir")) & (F.col("g") == F.col("ig")), "left"
    )
    counted = counted.select(F.col("sig").alias("s"), (F.col("w") - F.when(F.col("ir").isNotNull(), F.col("copies")).otherwise(0)).alias("k"))
    number = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"parts{side}") - 1)).alias(f"p{side}")
    pairs = two.where("not sure").select("rx", "gx", "gy", "partsy", number("x")).select("rx", "gx", "px", "gy", number("y")).where("gx <> gy or px <= py")
    pairs = written(pairs.withColumn("pair", F.xxhash64("rx", "gx", "px", "gy", "py")))
    cut = stats.select(F.col("root").alias("cr"), F.col("g").alias("cg"), "parts")
    held = placed.join(
        cut, (F.col("root") == F.col("cr")) & (F.col("g") == F.col("cg"))
    ).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    held = written(held.select("root", "g", "part", "sig", "n", "copies", "diff"))
    at = lambda s: (F.col("root") == F.col("rx")) & (F.col("g") == F.col(f"g{s}")) & (F.col("part") == F.col(f"p{s}"))
    out = ["pair", "rx", "gx", "px", "gy", "py"]
    row = ["sig", "n", "copies", "diff"]
    left = held.join(pairs, at("x")).select(*out, F.lit(0).alias("side"), *row)
    right = held.join(pairs.where("gx <> gy or px <> py"), at("y")).select(*out, F.lit(1).alias("side"), *row)

    def run(batches):
        claim("jaccard_join")
        last, rows, sums = None, [], []

        def send():
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in sums], pa.binary()), pa.array([k for _, k in sums], pa.int64())], names=["s", "k"])

        for b in batches:
            for *key, side, sig, n, copies, diff in zip(*(b.column(c).to_pylist() for c in (*out, "side", *row)), strict=True):
                if key != last:
                    sums += _compared(rows, t)
                    last, rows = key, []
                    if len(sums) > 20_000:
                        yield send()
                        sums = []
                rows.append((side, sig, n, copies, diff))
        sums += _compared(rows, t)
        yield send()

    dealt = left.unionByName(right).repartition("pair").sortWithinPartitions(*out, "side")
    compared = map_arrow(dealt, run, "s binary, k long")
    return counted.unionByName(compared).groupBy("s").agg(F.sum("k").alias("partners"))


def _compared(rows: list[tuple], t: int, wide: int = 4096) -> list[tuple[bytes, int]]:
    """(sig, copies linked) for rows (side, sig, n, copies, diff) of two blocks, or of one (side 0 only) with itself.

    Differences x and y from one set leave x + y - 2 x common tokens in which two sets differ; what
    is common is counted by products of incidence matrices, `wide` tokens at a time.
    """
    sides = [[r for r in rows if r[0] == s] for s in (0, 1)]
    one = not sides[1]
    if len(sides[0]) < (2 if one else 1):
        return []
    sides[1] = sides[0] if one else sides[1]
    diffs = [[np.frombuffer(r[4], np.uint64) for r in side] for side in sides]
    n, d, weight = (
        [np.array(x, np.int64) for x in y] for y in (
            [[r[2] for r in s] for s in sides], [[len(x) for x in s] for s in diffs], [[r[3] for r in s] for s in sides]
        )
    )
    codes = [np.concatenate(x) for x in diffs]
    owner = [np.repeat(np.arange(len(x)), x) for x in d]
    shared = np.intersect1d(*codes)
    common = np.zeros((len(d[0]), len(d[1])), np.float32)  # whole numbers below 2^24
    found = []
    for who, code in zip(owner, codes, strict=True):
        place = np.minimum(np.searchsorted(shared, code), max(0, len(shared) - 1))
        own = shared[place] == code if len(shared) else np.zeros(len(code), bool)
        order = np.argsort(place[own], kind="stable")
        found.append((who[own][order], place[own][order]))
    for a in range(0, len(shared), wide):
        tables = []
        for (who, place), x in zip(found, d, strict=True):
            lo, hi = np.searchsorted(place, [a, a + wide])
            table = np.zeros((len(x), min(wide, len(shared) - a)), np.float32)
            table[who[lo:hi], place[lo:hi] - a] = 1
            tables.append(table)
        common += tables[0] @ tables[1].T
    apart = d[0][:, None] + d[1][None, :] - 2 * np.rint(common).astype(np.int64)
    total = n[0][:, None] + n[1][None, :]
    linked = ((100 + t) * apart <= (100 - t) * total) & (apart < total)
    if one:
        np.fill_diagonal(linked, False)
    out = list(zip((r[1] for r in sides[0]), (linked @ weight[1]).tolist(), strict=True))
    return out if one else out + list(zip((r[1] for r in sides[1]), (linked.T @ weight[0]).tolist(), strict=True))


def linked(docs: DataFrame, words: int = 5, threshold: int = 80, most: int = 256) -> DataFrame:
    """classes() with n_links: how many other documents (rows) a document's set reaches the threshold with, equal sets included."""
    base, labels, distinct, links = _classed(docs, words, threshold)
    several = written(labels.groupBy("root").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("root").alias("mr")))
    members = written(labels.join(several, F.col("root") == F.col("mr"), "left_semi").select("sig", "copies", "n", "root"))
    partners = written(_partners(_profiles(members, distinct, links), threshold, most).withColumnRenamed("s", "ps"))
    of_sig = _component(labels).join(partners, F.col("s") == F.col("ps"), "left")
    of_sig = written(of_sig.select("s", "label", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    return base.join(of_sig, F.col("sig") == F.col("s"), "left").select(*_answer(), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each class stays, with its columns: the one with the least doc_id, or any if the class has none."""
    base, labels, _, _ = _classed(docs, words, threshold)
    of_sig = labels.select(F.col("sig").alias("s"), "root")
    return one_of_each(docs, base.join(of_sig, F.col("sig") == F.col("s")).select("root", "doc_id", "key"), "root", largest=False)
