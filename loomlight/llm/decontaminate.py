"""Benchmark decontamination with one Aho-Corasick automaton.

Texts become their words (A-Z lower-cased; ASCII letters and digits and all other non-ASCII
characters belong to words). A run of ten words always holds a whole block of five that starts at a
multiple of five of its item, so the automaton, over word numbers, has these blocks and the shorter
items as keys: a node for each word of the benchmark at most. It scans each text once. Blocks found
one after the other along an item are joined and extended word by word; what reaches ten words is a
hit, mapped back to the words and, in documents with hits, to code points of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, raw, slices
from loomlight.ship import map_arrow

WINDOW = 10
#: Bytes of item texts in one automaton (about 25 bytes a word there). Only a benchmark beyond that takes another pass.
BLOCK_BYTES = 100 << 20
#: Known words that are scanned side by side at most, and the number of an item without item_id.
STRETCH, NO_ID = 128, -(1 << 63)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Items:
    """Items one after the other as word numbers: `vocab` names them, `ends` and `ids` are the items'."""

    vocab: list[str]
    words: np.ndarray
    ends: np.ndarray
    ids: np.ndarray


def blocks(benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items with words, in groups of at most about `most` bytes of text; a longer item is cut into parts that overlap by a window.

    An item without item_id makes hits but is not counted among the items.
    """
    number: dict[bytes, int] = {}
    words, ends, ids, held, total = [], [], [], 0, 0

    def block() -> Items:
        joined = np.concatenate([np.zeros(0, np.int32), *words])
        return Items([w.decode() for w in number], joined, np.array(ends, np.int64), np.array(ids, np.int64))

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        own = words_of((r["text"] or "").encode())
        step = max(size, most // 8)
        for a in range(0, max(1, len(own) - size + 1) if own else 0, step):
            part = own[a : a + step + size - 1]
            words.append(np.array([number.setdefault(w, len(number)) for w in part], np.int32))
            total += len(part)
            ends.append(total), ids.append(NO_ID if r["item_id"] is None else r["item_id"])
            held += sum(map(len, part)) + len(part)
            if held > most:
                yield block()
                number, words, ends, ids, held, total = {}, [], [], [], 0, 0
    yield block()


@dataclass
class Machine:
    """The automaton. Edges, `parent << 32 | word`, are sorted, and edge i leads to node i + 1; node 0 is the root.

    `link` is the nearest node along the failures that ends a key, or 0. Keys are sorted by node:
    `key_at` is a key's place in the items' words, `key_len` its length.
    """

    items: Items
    size: int
    edges: np.ndarray
    fail: np.ndarray
    link: np.ndarray
    key_node: np.ndarray
    key_at: np.ndarray
    key_len: np.ndarray


def machine(items: Items, size: int = WINDOW) -> Machine:
    half = (size + 1) // 2
    starts = np.concatenate([[0], items.ends[:-1]]).astype(np.int64)[: len(items.ends)]
    count = items.ends - starts
    short = count < size
    many = np.where(short, 1, count // half)
    at = np.repeat(starts - half * (np.cumsum(many) - many), many) + half * np.arange(many.sum())
    length = np.repeat(np.where(short, count, half), many)
    node, levels, edges, base = np.zeros(len(at), np.int64), [], [], 1
    for d in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > d)
        unique, place = np.unique(node[on] << 32 | items.words[at[on] + d], return_inverse=True)
        node[on] = base + place
        edges.append(unique), levels.append(base)
        base += len(unique)
    edges = np.concatenate([np.zeros(0, np.int64), *edges])
    order = np.argsort(node, kind="stable")
    out = Machine(items, size, edges, np.zeros(base, np.int64), np.zeros(base, np.int64), node[order], at[order], length[order])
    ends_key = np.zeros(base, bool)
    ends_key[node] = True
    for first, stop in zip(levels, [*levels[1:], base][: len(levels)], strict=True):
        nodes = np.arange(first, stop)
        if first > 1:
            out.fail[nodes] = _step(out, out.fail[edges[nodes - 1] >> 32], edges[nodes - 1] & 0xFFFFFFFF)
        out.link[nodes] = np.where(ends_key[nodes], nodes, out.link[out.fail[nodes]])
    out.fail, out.link = out.fail.astype(np.int32), out.link.astype(np.int32)
    return out


def _step(m: Machine, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The states after one more word each."""
    out, todo, now = np.zeros(len(state), np.int64), np.arange(len(state)), state.astype(np.int64)
    while len(todo):
        key = now[todo] << 32 | word[todo]
        i = np.minimum(np.searchsorted(m.edges, key), len(m.edges) - 1)
        there = m.edges[i] == key
        out[todo[there]] = i[there] + 1
        todo = todo[~there & (now[todo] != 0)]
        now[todo] = m.fail[now[todo]]
    return out


def _keys(m: Machine, num: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of every key in word numbers (-1: unknown); `new` marks where documents begin. Runs of known words go side by side."""
    known = num >= 0
    begin = known & (new | np.concatenate([[True], ~known[:-1]]))
    start = np.flatnonzero(begin)
    stop = np.flatnonzero(known & np.concatenate([begin[1:] | ~known[1:], [True]])) + 1
    length = stop - start
    over = int(m.key_len.max()) - 1
    parts = np.maximum(1, -(-(length - over) // STRETCH))
    first = np.repeat(start - STRETCH * (np.cumsum(parts) - parts), parts) + STRETCH * np.arange(parts.sum())
    length = np.minimum(np.repeat(stop, parts), first + STRETCH + over) - first
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    state, found = np.zeros(len(first), np.int64), []
    for j in range(int(length.max(initial=0))):
        k = int(np.searchsorted(-length, -j, "left"))
        state[:k] = _step(m, state[:k], num[first[:k] + j])
        row = np.flatnonzero(m.link[state[:k]])
        node = m.link[state[row]].astype(np.int64)
        while len(row):
            found.append((first[row] + j + 1, node))
            node = m.link[m.fail[node]].astype(np.int64)
            row, node = row[node > 0], node[node > 0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, node = (np.concatenate(x) for x in zip(*found, strict=True))
    lo, hi = np.searchsorted(m.key_node, node, "left"), np.searchsorted(m.key_node, node, "right")
    many = hi - lo
    key = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(end, many) - m.key_len[key], key


def find(m: Machine, num: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, item) of every run of document words that makes a hit. `ends`: where documents end in `num`."""
    none = np.zeros(0, np.int64)
    if not len(m.edges) or not len(num):
        return none, none, none
    new = np.zeros(len(num) + 1, bool)
    new[0] = True
    new[ends] = True
    p, key = _keys(m, num, new[:-1])
    half, items = (m.size + 1) // 2, m.items
    q, length = m.key_at[key], m.key_len[key]
    item = np.searchsorted(items.ends, q, "right")
    begin = np.concatenate([[0], items.ends[:-1]])[item]
    short = items.ends[item] - begin < m.size
    a, b, who = p[short], (p + length)[short], item[short]
    p, q, item, begin = p[~short], q[~short], item[~short], begin[~short]
    # Blocks of one item that follow one another in the document too are one run.
    order = np.lexsort((p, p - q))
    p, q, item, begin = p[order], q[order], item[order], begin[order]
    once = np.concatenate([np.ones(len(p[:1]), bool), (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    p, q, item, begin = p[once], q[once], item[once], begin[once]
    doc = np.searchsorted(ends, p, "right")
    chain = np.concatenate([np.ones(len(p[:1]), bool), (p[1:] != p[:-1] + half) | (q[1:] != q[:-1] + half) | (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(chain)
    tail = np.append(head[1:], len(p))[: len(head)] - 1
    x, qx, y, qy = p[head], q[head], p[tail] + half, q[tail] + half
    item, doc, low, high = item[head], doc[head], begin[head], items.ends[item[head]]
    first, last = np.concatenate([[0], ends[:-1]])[doc], ends[doc]
    for _ in range(half - 1):  # one more block would have been found
        left = (x > first) & (qx > low)
        left[left] = num[x[left] - 1] == items.words[qx[left] - 1]
        x, qx = x - left, qx - left
        right = (y < last) & (qy < high)
        right[right] = num[y[right]] == items.words[qy[right]]
        y, qy = y + right, qy + right
    good = y - x >= m.size
    return np.concatenate([a, x[good]]), np.concatenate([b, y[good]]), np.concatenate([who, item[good]])


def _numbers(texts: list[bytes], vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers (-1: not in the benchmark), and where each text ends."""
    folded = pa.array([t.translate(_FOLD) for t in texts], pa.binary()).cast(pa.string())
    split = pc.ascii_split_whitespace(folded)
    coded = split.flatten().dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    num = number[index]
    if (blank := pc.index(coded.dictionary, "").as_py()) >= 0:  # outer separators leave empty strings
        real = index != blank
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        num = num[real]
    return num, np.cumsum(counts)


HITS = "array<struct<a:long,b:long>>"
_HITS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs' doc_id and text with n_words, hits (ranges of words, from and to) and items (ids whose windows occur).

    Null or empty documents have no words. Repeated rows give repeated answers. An empty benchmark
    hits nothing. Further columns are ignored.
    """
    before, last = _passes(docs, benchmark, size)
    return map_arrow(before, last, _SCAN)


_SCAN = f"doc_id long, text string, n_words long, hits {HITS}, items array<long>"


def _passes(docs: DataFrame, benchmark: DataFrame, size: int):
    """The table after all but the last group of items, and the last group's pass; there is one group up to BLOCK_BYTES."""
    sc = docs.sparkSession.sparkContext
    none = [F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {HITS})").alias("hits"), F.expr("cast(array() as array<bigint>)").alias("items")]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *none)
    run = None
    for items in blocks(benchmark, size):
        if run is not None:
            out = map_arrow(out, run, _SCAN)
        run = _scanner(sc.broadcast(machine(items, size)))
    return out, run


def _scanner(shared):
    def run(batches):
        claim("decontaminate")
        m = shared.value
        vocab = pa.array(m.items.vocab, pa.string())
        for batch in slices(batches):
            num, ends = _numbers(raw(batch.column("text")), vocab)
            a, b, who = find(m, num, ends)
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            doc = np.searchsorted(ends, a, "right")
            base = np.concatenate([[0], ends[:-1]])[doc]
            for i, x, y in zip(doc.tolist(), (a - base).tolist(), (b - base).tolist(), strict=True):
                hits[i].append({"a": x, "b": y})
            pairs = np.unique(np.stack([doc, m.items.ids[who]], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            for i, x in pairs[pairs[:, 1] != NO_ID].tolist():
                items[i].append(x)
            items = [sorted(set(x)) if x else x for x in items]
            n = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(n, pa.int64()),
                    pa.array(hits, _HITS),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text", "n_words", "hits", "items"],
            )

    return run


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (code points of the original, maximal runs of hit words).

    Edge cases are scan()'s.
    """
    before, last = _passes(docs, benchmark, size)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in last(batches):
            rows = defaultdict(list)
            for text, n, hits, items in zip(raw(b.column("text")), *(b.column(c).to_pylist() for c in ("n_words", "hits", "items")), strict=True):
                spans, hit = [], 0
                if hits:
                    mark = np.zeros(n + 2, np.int8)
                    for x in hits:
                        mark[x["a"] + 1 : x["b"] + 1] = 1
                    hit, turn = int(mark.sum()), np.flatnonzero(np.diff(mark)).tolist()
                    at = [m.span() for m in _WORD.finditer(text)]
                    spans = [
                        {
                            "start": len(text[: at[x][0]].decode()), "end": len(text[: at[y - 1][1]].decode())
                        } for x, y in zip(turn[::2], turn[1::2], strict=True)
                    ]
                rows["n_hit"].append(hit), rows["n_items"].append(len(items)), rows["spans"].append(spans)
                rows["sha"].append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
            contaminated = pa.array([x > 0 for x in rows["n_hit"]], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("n_words"),
                    pa.array(rows["n_hit"], pa.int64()),
                    pa.array(rows["n_items"], pa.int64()),
                    pa.array(rows["sha"], pa.string()),
                    contaminated,
                    pa.array(rows["spans"], span),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return map_arrow(
        before,
        run,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any window of the benchmark, each by its own text, with their columns."""
    for items in blocks(benchmark, size):
        if len(items.ends):
            run = _cleaner(docs.sparkSession.sparkContext.broadcast(machine(items, size)))
            rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
            docs = map_arrow(rows, run, rows.select("_row").schema).select("_row.*")
    return docs


def _cleaner(shared):
    def run(batches):
        claim("decontaminate")
        m = shared.value
        vocab = pa.array(m.items.vocab, pa.string())
        for batch in slices(batches):
            num, ends = _numbers(raw(batch.column("text")), vocab)
            good = np.ones(batch.num_rows, bool)
            good[np.searchsorted(ends, find(m, num, ends)[0], "right")] = False
            yield pa.RecordBatch.from_arrays([batch.column("_row").filter(pa.array(good))], names=["_row"])

    return run
