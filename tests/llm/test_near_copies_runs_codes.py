"""Operators 11 to 13 against brute force: SimHash classes, periodic runs, vector codes."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from loomlight.llm import components, periodic_runs, queries, simhash, vector_codes
from loomlight.storage import written


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def classes(values, most):
    """The least index that links reach, for each of unsigned values."""
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(values))]


# 11: SimHash


def fingerprint(text, k=4):
    w = [x.encode() for x in words_of(text)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]).lower(), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def prints(rows):
    return [fingerprint(t) for _, t in rows]


@pytest.mark.parametrize("stretch", [2 << 20, 64])
def test_fingerprints(rows, prints, stretch, monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH", stretch)
    assert simhash.fingerprint_of([(t or "").encode().lower() for _, t in rows], 4).tolist() == prints


def test_near_copies(docs, rows, prints):
    root = classes(prints, 4)
    want = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for (d, _), r in zip(rows, root, strict=True) if r == root[i] and d is not None]
        want.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    got = [tuple(r) for r in simhash.near_copies(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_copies_empty(no_docs):
    assert simhash.near_copies(no_docs).collect() == []


def test_a_component_without_doc_id_has_none(spark):
    rows = [(None, "a b c d e"), (None, "A b c d e"), (7, ""), (3, None), (None, " ")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got if r["fingerprint"] == "0" * 16) == [(0, 3), (3, 3), (7, 3)]
    assert [r["component_id"] for r in got if r["fingerprint"] != "0" * 16] == [None, None]


def clustered(n, centres, flips, seed=3):
    g = np.random.default_rng(seed)
    x = g.integers(0, 2**64, centres, dtype=np.uint64)[g.integers(0, centres, n)]
    for _ in range(flips):
        x = x ^ np.where(g.random(n) < 0.6, np.uint64(1) << g.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(x)


@pytest.mark.parametrize(("centres", "flips", "shard"), [(30, 6, 60), (1, 5, 40), (900, 6, 200), (4, 9, 5000)])
def test_links_of_many_shards_equal_brute_force(spark, centres, flips, shard):
    x = clustered(900, centres, flips)
    table = written(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    found = components.components(written(simhash.links(table, 4, shard)))
    root = {r["node"]: r["root"] for r in found.collect()}
    signed, want = x.view(np.int64).tolist(), classes(x.tolist(), 4)
    groups = {}
    for v, w in zip(signed, want, strict=True):
        groups.setdefault(w, []).append(v)
    assert {v: min(g) for g in groups.values() for v in g} == {v: root.get(v, v) for v in signed}


def test_bounds_spare_most_comparisons_and_shards():
    g = np.random.default_rng(1)
    for part in range(simhash.PARTS):
        tree = simhash.Tree(g.integers(0, 2**64, 1 << 14, dtype=np.uint64), 1 << 24, part)
        row, _, home = tree.route(g.integers(0, 2**64, 2000, dtype=np.uint64), 4)
        assert home.sum() == 2000 and len(tree.shards) > 300
        assert len(row) < 0.07 * 2000 * len(tree.shards)
        shard = simhash.Shard(np.unique(g.integers(0, 2**64, 1 << 15, dtype=np.uint64)), 4, part)
        met = np.abs(shard.leaf - shard.leaf[:, :1]).sum(0) <= 1
        assert shard.size[met].sum() < 0.07 * len(shard.fp)


def test_a_dense_group_gives_a_forest(spark):
    x = clustered(2000, 1, 3)
    table = written(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    assert simhash.links(table, 4, 300).count() < 36 * len(x)


# 12: periodic runs


def runs_of(w, exponent=4, least=6):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 1), (2, 6)])
def test_runs_equal_brute_force(exponent, least):
    r = random.Random(exponent * 10 + least)
    for _ in range(150):
        texts = []
        for _ in range(r.randrange(1, 6)):
            k = r.choice([1, 2, 3, 5, 30])
            w = [r.randrange(k) for _ in range(r.randrange(0, 60))]
            if r.random() < 0.5 and w:
                w = w + w[: r.randrange(1, 6)] * r.randrange(2, 9) + w[:3]
            texts.append(w)
        word, doc = np.array([x for t in texts for x in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        start = np.cumsum([0, *map(len, texts)]).tolist()
        want = [(s + start[i], n, q) for i, t in enumerate(texts) for s, n, q in runs_of(t, exponent, least)]
        assert [tuple(x) for x in periodic_runs.find(word, doc, exponent, least).tolist()] == want


@pytest.mark.parametrize("leaves", [1 << 21, 50])
def test_long_and_nested_runs(leaves, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LEAVES", leaves)
    for w in ([0] * 3000, list(range(100)) * 30, ([0] * 6 + [1]) * 40, [0, 1] * 5 + [2] * 900, [0, 0, 1, 0, 0, 1, 0] * 50):
        got = periodic_runs.find(np.array(w), np.zeros(len(w), np.int64))
        assert [tuple(x) for x in got.tolist()] == runs_of(w)


def test_periodic_runs_query(spark, docs, rows, tmp_path):
    more = [(i, "a b " * 8 + f"end {i}") for i in range(100, 160)] + [(900, "x\x1cy " * 9), (901, "x \x85y\x0bz\x0c" * 7), (902, "Q q " * 3)]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows + more:
        w = words_of(text)
        if doc_id is not None:
            h = zlib.crc32(str(doc_id).encode())
            n, g = len(w), h // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs_of(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept)))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(x[1] for x in want) and len({x[1] for x in want}) > 1


def test_periodic_runs_empty(no_docs):
    assert periodic_runs.detect(no_docs).collect() == []


# 13: vector codes


def codes_of(vectors, parts=4, entries=256, rounds=4):
    """vectors: (id, integers), ascending."""
    dim = len(vectors[0][1])
    cut = [[v[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)] for _, v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [best(c[p], books[p])[1] for c in cut]
            for e in set(own):
                some = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                books[p][e] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    out = []
    for (i, _), c in zip(vectors, cut, strict=True):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, ",".join(str(x) for b in books for e in b for x in e)


def test_nearest_takes_the_lowest_of_ties():
    g = np.random.default_rng(2)
    for dim, high in ((1, 3), (3, 2), (9, 3), (16, 900)):
        x, book = g.integers(-high, high, (400, dim)), g.integers(-high, high, (60, dim))
        index, far = vector_codes.nearest(x, book)
        d = ((x[:, None] - book) ** 2).sum(2)
        assert np.array_equal(far, d.min(1)) and np.array_equal(index, d.argmin(1))


def test_vector_codes(spark):
    r = random.Random(4)
    base = [[r.gauss(0, 0.3) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + r.gauss(0, 0.02) for x in r.choice(base)], None if i % 7 == 0 else i % 5, "c", 1) for i in range(400)]
    rows += [(401, None, 1, "c", 1), (402, [1.0, None] + [0.0] * 6, 1, "c", 1), (403, [math.nan] + [0.0] * 7, 1, "c", 1)]
    rows += [(404, [math.inf] + [0.0] * 7, 1, "c", 1), (405, [1e30] + [-1e30] * 7, 2, "c", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error long").repartition(3)
    hold = lambda x: max(-(1 << 28), min(1 << 28, math.floor(1024 * x)))
    whole = [(i, [hold(x) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want, text = codes_of(whole)
    label = {i: lab for i, _, lab, *_ in rows}
    totals = {}
    for i, _, e in want:
        totals[label[i]] = totals.get(label[i], 0) + e
    found, books = vector_codes.compress(df)
    assert sorted(tuple(x) for x in found.collect()) == sorted((i, c, e, totals[label[i]]) for i, c, e in want)
    assert books.text() == text


def test_vector_codes_edges(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], ddl))[0].collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], ddl))[1] is None
    rows = [(2, [0.5] * 8, 1), (2, [0.5] * 8, 1), (None, [0.25] * 8, 1), (3, [1.0] * 4, 1), (1, [-0.5] * 8, None)]
    got, books = vector_codes.compress(spark.createDataFrame(rows, ddl))
    assert len(books.values) == 4  # repeated rows are entries of their own
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "00000000", 0, 0), (2, "01010101", 0, 0), (2, "01010101", 0, 0), (None, "03030303", 0, 0), (3, None, None, 0)], key=str
    )
