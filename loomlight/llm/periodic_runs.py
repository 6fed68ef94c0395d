"""Periodic runs of words: suffix trees, branching tandem repeats by the smaller half, maximal runs.

A tandem repeat of period D at i is branching if the word after it breaks the period. In the suffix
tree i and i + D then lie below different children of the node with depth D, so it is enough to look,
at every node, at the leaves of all but the largest child: for a leaf i, whether i + D or i - D lies
below another child. Every run ends with the branching repeat of its period; rotating that to the
left finds where the run begins, and repeats with one begin and end merge into a run of their least
period.

Each task builds the trees of a few megabytes of text at once, as suffix arrays by prefix doubling;
the tree's nodes are the intervals of the array of common prefixes, in a binary form in which every
child but the first meets the children before it. The words of a document (and only they) are a
sequence. Words that occur in it too seldom to be in a run part it into stretches beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, ranges, slices
from loomlight.ship import map_arrow

#: Bytes of text whose trees one task builds at once (or one document), and leaves looked at at once.
HELD, LEAVES = 4 << 20, 1 << 21


def stretches(word: np.ndarray, doc: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, part, rank): positions that may be in a run, the stretch each is in, and equal numbers for equal words of a stretch.

    Every word of a run occurs `exponent` times in it at least, and a run has `least` words. Words that
    occur less often, and stretches that are shorter, drop out until nothing changes.
    """
    at, part = np.arange(len(word)), doc
    while len(at):
        key = part * (int(word.max()) + 1) + word[at]
        _, rank, often = np.unique(key, return_inverse=True, return_counts=True)
        on = np.flatnonzero(often[rank] >= exponent)
        cut = np.ones(len(on), bool)
        cut[1:] = (np.diff(at[on]) > 1) | (part[on[1:]] != part[on[:-1]])
        part_of = np.cumsum(cut) - 1
        long = np.bincount(part_of)[part_of] >= least if len(on) else np.zeros(0, bool)
        if len(on) == len(at) and long.all() and part_of[-1] == part[-1]:
            break
        at, part = at[on][long], part_of[long]
        if len(part):
            part = np.cumsum(np.concatenate([[0], np.diff(part) != 0]))
    else:
        rank = np.zeros(0, np.int64)
    return at, part, rank


def suffixes(rank: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of sequences that lie one after another, and for k = 0, 1, ... numbers that are equal where 2^k words are.

    rank: equal for equal words of a sequence. end: by position, where its sequence ends.
    """
    n = len(rank)
    sa = np.argsort(rank, kind="stable")
    new = np.concatenate([[True], rank[sa][1:] != rank[sa][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.full(n + 1, -1, np.int32 if n < 1 << 31 else np.int64)
    place[sa] = first
    levels, step = [place.copy()], 1
    open_ = np.flatnonzero(np.bincount(first, minlength=n)[first] > 1)  # slots of the array whose suffixes are not told apart
    while len(open_):
        i = sa[open_]
        after = np.where(i + step < end[i], place[np.minimum(i + step, n)].astype(np.int64) + 1, 0)
        order = np.argsort(first[open_] * (n + 1) + after)
        group, after, i = first[open_], after[order], i[order]  # groups keep their slots
        new = np.ones(len(i), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        now = np.maximum.accumulate(np.where(new, open_, 0))
        sa[open_], first[open_] = i, now
        place[i] = now
        size = np.diff(np.append(np.flatnonzero(new), len(i)))
        open_ = open_[np.repeat(size, size) > 1]
        if len(open_):
            levels.append(place.copy())
        step *= 2
    return sa, [*levels, place] if len(levels) > 1 or not np.array_equal(levels[0], place) else levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j (i <> j)."""
    out, n = np.zeros(len(i), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        a, b = np.minimum(i + out, n), np.minimum(j + out, n)
        out += np.where((levels[k][a] == levels[k][b]) & (a < n) & (b < n), 1 << k, 0)
    return out


def smaller(values: np.ndarray, at: np.ndarray, back: bool) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or after it with one not larger. The ends of `values` are least."""
    size = 1 << max(1, len(values) - 1).bit_length()
    tree = np.full(2 * size, -1, values.dtype)
    tree[size : size + len(values)] = values
    level = size
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    limit, node, out = values[at], at + size, np.zeros(len(at), np.int64)
    less = (lambda x, most: x < most) if back else (lambda x, most: x <= most)
    who = np.arange(len(at))
    while len(who):  # up, until the neighbour's subtree has one
        beside = node + (-1 if back else 1)
        met = ((node & 1) == (1 if back else 0)) & less(tree[beside % (2 * size)], limit)
        found = np.flatnonzero(met)
        inside, wanted = beside[found], limit[found]
        while len(inside) and inside[0] < size:  # down to it; all are at one height
            near = 2 * inside + (1 if back else 0)
            inside = np.where(less(tree[near], wanted), near, near ^ 1)
        out[who[found]] = inside - size
        who, node, limit = who[~met], node[~met] >> 1, limit[~met]
    return out


def tandem(sa: np.ndarray, place: np.ndarray, lcp: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats of the given nodes, which are places in lcp (with an end of -1 on both sides)."""
    low, high, depth = smaller(lcp, nodes, True), smaller(lcp, nodes, False), lcp[nodes]
    left = nodes - low <= high - nodes  # the smaller half's leaves are gone through, the other half's are looked up
    a, b = np.where(left, low, nodes), np.where(left, nodes, high)
    c, d = np.where(left, nodes, low), np.where(left, high, nodes)
    total = np.cumsum(b - a)
    starts, periods, at = [], [], 0
    while at < len(nodes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LEAVES, "right")))
        n = (b - a)[at:to]
        i = sa[np.repeat(a[at:to], n) + ranges(n)]
        p, lo, hi = (np.repeat(x[at:to], n) for x in (depth, c, d))
        for first, other in ((i, i + p), (i - p, i - p)):
            spot = place[np.where((other >= 0) & (other < len(sa)), other, len(sa))]
            hit = (spot >= lo) & (spot < hi)
            starts.append(first[hit])
            periods.append(p[hit])
        at = to
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def find(word: np.ndarray, doc: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """The maximal runs of sequences of numbered words: rows (start, length, period), by start and period.

    doc: by word, the number of its document, ascending. A run has `least` words and `exponent` (2 or
    more) times its period at least; the period is its least one.
    """
    none = np.zeros((0, 3), np.int64)
    at, part, rank = stretches(word, doc, exponent, least)
    if not len(at):
        return none
    size = np.bincount(part)
    stop = np.cumsum(size)
    end, begin = stop[part], (stop - size)[part]
    sa, levels = suffixes(rank, end)
    n, place = len(sa), levels[-1]
    lcp = np.full(n + 1, -1, np.int64)
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[1:n] = 0
    lcp[same] = common(levels, sa[same - 1], sa[same])
    nodes = same[lcp[same] * exponent <= size[part[sa[same]]]]
    start, period = tandem(sa, place, lcp, nodes)
    stop_at = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left, by the longest steps first
        width, who = 1 << k, np.arange(len(start))
        while len(who):
            x = start[who] - width
            fits = x >= begin[stop_at[who] - 1]
            x, who = x[fits], who[fits]
            go = levels[k][x] == levels[k][x + period[who]]
            who = who[go]
            start[who] -= width
    long = stop_at - start >= np.maximum(least, exponent * period)
    runs = np.stack([start, stop_at, period], 1)[long]
    if not len(runs):
        return none
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])]
    out = np.stack([at[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(flat, "")  # what is before the first and after the last white space
    doc = doc[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.bincount(doc, minlength=len(text))


def _report(text: pa.Array, exponent: int, least: int) -> list[pa.Array]:
    words, n = _words(text)
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = find(code, doc, exponent, least)
    owner = doc[runs[:, 0]]
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))]).astype(np.int64)
    kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
    each = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
    return [pa.array(n), pa.ListArray.from_arrays(pa.array(ends), each), kept.cast(pa.string())]


def detect(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period, by start and period), collapsed.

    Words are what white space (0x20, 0x09 to 0x0D) parts. `collapsed` is the words, joined by one blank,
    without those that a run has after its first period. Null text equals empty: no words, no runs, an
    empty collapsed text. Rows are judged by themselves, so repeated rows and null doc_ids each get their
    answer. Ties do not arise: runs differ in start or period. Further columns are ignored; an empty table
    gives no rows. A task holds one document's words, some 200 bytes each, besides a few megabytes.
    """

    def run(batches):
        claim("periodic_runs")
        for b in slices(batches, HELD):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_report(b.column("text"), exponent, least)], names=["doc_id", "n_words", "runs", "collapsed"])

    ddl = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, ddl)


def longest(found: DataFrame) -> DataFrame:
    """detect()'s rows with `top`: of each document's runs the longest one, ties by start, then period; null without runs."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.withColumn("_b", best).withColumn(
        "top", F.when(F.col("_b").isNotNull(), F.struct((-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period")))
    ).drop("_b")
