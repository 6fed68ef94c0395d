"""Near copies by 64-bit SimHash fingerprints and vantage-point trees over Hamming distance.

Fingerprints within 4 bits differ in one bit at most in one of three thirds of their bits. So there
are three trees, one for each third. A node of a tree has a vantage point and a few bits: it parts the
fingerprints by their distance from the vantage point on these bits, first those of the third, then
the rest. Nodes of one path have different bits, so the triangle bounds |d(x, v) - d(y, v)| of a path
add up, and a branch is pruned once they exceed 1 within the third or 4 in all. (Distances over all
64 bits lie close to 32: one bound of 4 would prune an eighth of a level.)

The upper part of a tree is built from a bounded sample and parts all fingerprints into shards. Each
is at home in one shard of a tree, and asks at those shards beyond its own that its bounds cannot
exclude. A task parts its own shard further, one vantage point a level, and compares what the bounds
leave. It reports links as a forest, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, ranges, raw, runs, slices, written
from loomlight.llm.components import components
from loomlight.ship import map_arrow

#: Bytes of one text whose words are held at once; seed of the hashes.
STRETCH, SEED = 2 << 20, 42

#: Fingerprints at home in a shard, by the sample's estimate, and fingerprints that the sample has (512 kB).
SHARD, SAMPLE = 1 << 15, 1 << 16

#: Trees, bits that their nodes look at, within the tree's part and outside it, and fingerprints of a task's shard that share a leaf, about.
PARTS, WITHIN, OUTSIDE, LEAF = 3, 3, 8, 100

#: Fingerprints that are read at once, and the most pairs compared at once.
BLOCK, PAIRS = 1 << 16, 1 << 21


def _pieces(text: bytes, most: int) -> Iterator[list[bytes]]:
    """The words of a text, from stretches of about `most` bytes."""
    at = 0
    while len(text) - at > most:
        to = at + most
        while to < len(text) and text[to] not in b" \t\n\v\f\r":
            to += 1
        yield text[at:to].split()
        at = to
    yield text[at:].split()


def _bits(words: list[bytes], sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with `sizes` words each: how often each of 64 bits is set in their k-word shingles' hashes, and how many these are.

    A text of fewer words has the whole sequence as its one shingle, one without words has none.
    """
    n = np.array(sizes, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words)]
    each = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.repeat(np.cumsum(n) - n, each) + ranges(each)
    last = first + np.repeat(np.minimum(n, k), each) - 1
    digest, seed = xxhash.xxh64_digest, SEED
    hashed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)])
    out, some = np.zeros((len(n), 64), np.int64), np.flatnonzero(each)
    if len(some):
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        out[some] = np.add.reduceat(bits, (np.cumsum(each) - each)[some], axis=0, dtype=np.int32)
    return out, each


def fingerprint_of(texts: list[bytes], k: int) -> np.ndarray:
    """The fingerprints (unsigned) of lower-cased texts; a bit is 1 if over half of the shingles' hashes have it. No words: zero."""
    counts, shingles = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    words, sizes, at = [], [], []
    for i, t in enumerate(texts):
        if len(t) <= STRETCH:
            own = t.split()
            words += own
            sizes.append(len(own))
            at.append(i)
            continue
        left: list[bytes] = []
        for piece in _pieces(t, STRETCH):
            left += piece
            if len(left) >= k:
                c, n = _bits(left, [len(left)], k)
                counts[i], shingles[i] = counts[i] + c[0], shingles[i] + n[0]
                left = left[len(left) - k + 1 :]
        if not shingles[i] and left:
            c, n = _bits(left, [len(left)], k)
            counts[i], shingles[i] = c[0], n[0]
    if at:
        counts[at], shingles[at] = _bits(words, sizes, k)
    return np.packbits(2 * counts > shingles[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of `docs` (doc_id, text): the SimHash of its shingles as a signed long. Null text: empty, fingerprint 0."""

    def run(batches):
        claim("simhash")
        for b in slices(batches, STRETCH):
            fp = fingerprint_of([t.lower() for t in raw(b.column("text"))], words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def segments(part: int, parts: int = PARTS) -> tuple[list[int], int]:
    """Masks of the bits that the nodes of a path look at, by depth, and how many of them lie in the tree's own part of the bits."""
    bits = np.arange(64)
    own = np.array_split(bits, parts)[part]
    cut = lambda some, width: [sum(1 << int(b) for b in x) for x in np.array_split(some, -(-len(some) // width))]
    within = cut(own, WITHIN)
    return within + cut(np.setdiff1d(bits, own), OUTSIDE), len(within)


def _far(x: np.ndarray, vantage, mask) -> np.ndarray:
    return np.bitwise_count((x ^ vantage) & mask).astype(np.int64)


def _vantage(points: np.ndarray, mask: np.uint64) -> np.uint64:
    """Of some of the points, the one whose distances differ most."""
    tried = points[:: max(1, len(points) // 16)][:16]
    spread = [np.var(_far(points, v, mask)) for v in tried]
    return tried[int(np.argmax(spread))]


class Tree:
    """The upper part of one tree: lists by node. Built from a sample that stands for `n` fingerprints."""

    def __init__(self, sample: np.ndarray, n: int, part: int, shard: int = SHARD):
        masks, self.within = segments(part)
        self.masks = np.array(masks, np.uint64)
        self.vantage: list[int] = []
        self.depth: list[int] = []
        self.children: list[list[tuple[int, int, int]]] = []  # (least distance, largest, node); at a leaf none
        self.shards: dict[int, int] = {}
        self._grow(np.sort(sample), 0, n / max(1, len(sample)), shard)

    def _grow(self, own: np.ndarray, depth: int, weight: float, shard: int) -> int:
        node = len(self.vantage)
        want = -(-len(own) * weight // shard)
        while want > 1 and depth < len(self.masks):  # bits in which all agree part nothing
            v = _vantage(own, self.masks[depth])
            far = _far(own, v, self.masks[depth])
            if far.min() < far.max():
                break
            depth += 1
        self.depth.append(depth)
        self.vantage.append(0)
        self.children.append([])
        if want <= 1 or depth == len(self.masks):
            self.shards[node] = len(self.shards)
            return node
        self.vantage[node] = int(v)
        most = int(self.masks[depth]).bit_count()
        count = np.bincount(far, minlength=most + 1)
        bands, low, held = [], 0, 0
        for d in range(most + 1):
            held += count[d]
            if held >= len(own) / want and count[d + 1 :].any():
                bands.append((low, d))
                low, held = d + 1, 0
        bands.append((low, most))
        self.children[node] = [(a, b, self._grow(own[(far >= a) & (far <= b)], depth + 1, weight, shard)) for a, b in bands]
        return node

    def route(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, at home) for each fingerprint and each shard that may hold one within `most` bits of it, and within the part's share of these in the part."""
        todo = [(0, np.arange(len(x)), np.full(len(x), most), np.full(len(x), most // PARTS), np.ones(len(x), bool))]
        rows, shards, homes = [], [], []
        while todo:
            node, row, left, own, home = todo.pop()
            if node in self.shards:
                rows.append(row)
                shards.append(np.full(len(row), self.shards[node]))
                homes.append(home)
                continue
            far = _far(x[row], np.uint64(self.vantage[node]), self.masks[self.depth[node]])
            for low, high, child in self.children[node]:
                bound = np.maximum(0, np.maximum(low - far, far - high))
                rest = own - bound if self.depth[node] < self.within else own
                go = np.flatnonzero((left >= bound) & (rest >= 0))
                if len(go):
                    todo.append((child, row[go], (left - bound)[go], rest[go], home[go] & (bound[go] == 0)))
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


class Shard:
    """The fingerprints of one shard in leaves of a tree with one vantage point a level, and which of them are linked."""

    def __init__(self, own: np.ndarray, most: int, part: int):
        masks, within = segments(part)
        self.most, own, code = most, np.sort(own), np.zeros(len(own), np.int64)
        self.masks, self.vantage, self.within, leaves = [], [], 0, 1
        for k, m in enumerate(np.array(masks, np.uint64)):  # levels until the leaves are small
            if leaves * LEAF >= len(own):
                break
            v = _vantage(own, m)
            finer = code * 16 + _far(own, v, m)
            if (n := len(np.unique(finer))) > leaves:
                self.masks.append(m)
                self.vantage.append(v)
                self.within += k < within
                code, leaves = np.unique(finer, return_inverse=True)[1], n
        order = np.argsort(code, kind="stable")
        self.fp, self.parent = own[order], np.arange(len(own))
        self.start = np.flatnonzero(np.diff(code[order], prepend=-1))
        self.size = np.diff(np.append(self.start, len(own)))
        self.leaf = np.ascontiguousarray(self.sign(self.fp[self.start]).T)

    def sign(self, x: np.ndarray) -> np.ndarray:
        out = [np.bitwise_count((x ^ v) & m).astype(np.int8) for v, m in zip(self.vantage, self.masks, strict=True)]
        return np.stack(out, 1) if out else np.zeros((len(x), 0), np.int8)

    def roots(self, i: np.ndarray) -> np.ndarray:
        at = self.parent[i]
        while (up := self.parent[at]).tobytes() != at.tobytes():
            at = up
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]: the larger root goes below the smaller one, until none is left apart."""
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def near(self, x: np.ndarray, sign: np.ndarray, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): x[i] and the shard's fp[j] are within the limit. All of x have one signature; leaves before `first` are left out."""
        bound, open_ = np.zeros(self.leaf.shape[1] - first, np.int8), None
        for k, own in enumerate(sign):
            if k == self.within:
                open_ = bound <= self.most // PARTS
            bound += np.abs(self.leaf[k, first:] - own)
        open_ = bound <= self.most // PARTS if open_ is None else open_ & (bound <= self.most)
        met = np.flatnonzero(open_) + first
        if not len(met):
            return
        other = np.repeat(self.start[met], self.size[met]) + ranges(self.size[met])
        theirs, step = self.fp[other], max(1, PAIRS // len(other))
        for at in range(0, len(x), step):
            hit = np.flatnonzero(np.bitwise_count(x[at : at + step, None] ^ theirs) <= self.most)
            if len(hit):
                i, j = np.divmod(hit, len(other))
                yield i + at, other[j]

    def own_links(self) -> None:
        for g, (at, n) in enumerate(zip(self.start.tolist(), self.size.tolist(), strict=True)):
            for i, j in self.near(self.fp[at : at + n], self.leaf[:, g], g):
                self.join(i + at, j)

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): fingerprints of x that the shard has links of, each with one of them; the rest of its links are joined here."""
        sign = self.sign(x)
        if sign.shape[1]:
            order = np.lexsort(sign.T)
            x, sign = x[order], sign[order]
        cut = [0, *(np.flatnonzero((sign[1:] != sign[:-1]).any(1)) + 1).tolist(), len(x)]
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for at, to in zip(cut, cut[1:], strict=False):
            for i, j in self.near(x[at:to], sign[at]):
                who, first = np.unique(i, return_index=True)
                self.join(np.repeat(j[first], np.diff(np.append(first, len(i)))), j)
                a.append(x[at + who])
                b.append(self.fp[j[first]])
        return np.concatenate(a), np.concatenate(b)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.roots(np.arange(len(self.fp)))
        below = np.flatnonzero(root != np.arange(len(root)))
        return self.fp[below], self.fp[root[below]]


def links(prints: DataFrame, most: int = 4, shard: int = SHARD) -> DataFrame:
    """(a, b) of `prints` (fp; distinct, a written table): a forest with the classes that all links of at most `most` differing bits give."""
    n = prints.count()
    every = max(1, n // SAMPLE)
    sample = prints.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toArrow().column("fp").to_numpy()
    if not len(sample):
        sample = np.zeros(1, np.int64)
    trees = [Tree(sample.view(np.uint64), n, part, shard) for part in range(PARTS)]
    first = np.cumsum([0, *(len(t.shards) for t in trees)])

    def deal(batches):
        claim("simhash")
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                fp = b.column("fp").slice(at, BLOCK)
                for part, tree in enumerate(trees):
                    row, to, home = tree.route(fp.to_numpy(zero_copy_only=False).view(np.uint64), most)
                    own = np.zeros(len(fp), np.int64)
                    own[row[home]] = to[home]
                    keep = np.flatnonzero(to >= own[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[keep] + first[part]), pa.array(~home[keep]), fp.take(pa.array(row[keep]))], names=["shard", "guest", "fp"]
                    )

    def compare(batches):
        claim("simhash")
        for (at,), held in runs(batches, "shard"):
            own = _column(held, "fp", False)
            if not len(own):
                continue
            s = Shard(own, most, int(np.searchsorted(first, at, "right")) - 1)
            s.own_links()
            for b in held:
                some = b.filter(b.column("guest"))
                if some.num_rows:
                    yield _pairs(*s.asked(some.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            yield _pairs(*s.forest())

    dealt = map_arrow(prints.select("fp"), deal, "shard long, guest boolean, fp long")
    met = dealt.repartition(int(first[-1]), "shard").sortWithinPartitions("shard", "guest")
    return map_arrow(met, compare, "a long, b long")


def _column(held: list[pa.RecordBatch], name: str, guest: bool) -> np.ndarray:
    own = [b.column(name).to_numpy(zero_copy_only=False)[b.column("guest").to_numpy(zero_copy_only=False) == guest] for b in held]
    return np.concatenate(own).view(np.uint64)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_copies(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id that links reach).

    Documents link when their fingerprints differ in at most `most` bits. Null text equals empty: its
    fingerprint is zero and links like any other. Repeated rows each get their answer. Rows without
    doc_id link others; a component without any doc_id has none. Equal fingerprints are compared once, so
    ties and large groups of copies cost one entry. Further columns of `docs` are ignored; an empty
    table gives no rows.
    """
    each = written(fingerprints(docs, words))
    prints = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    class_of = written(components(written(links(prints, most))))
    linked = class_of.join(prints, F.col("node") == F.col("fp")).select("node", "root", "least")
    top = written(linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("top")))
    alone = prints.join(class_of, F.col("fp") == F.col("node"), "left_anti").select("fp", "least")
    ids = written(alone.unionByName(class_of.join(top, F.col("root") == F.col("r")).select(F.col("node").alias("fp"), F.col("top").alias("least"))))
    return each.join(ids.select(F.col("fp").alias("_fp"), F.col("least").alias("component_id")), F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
