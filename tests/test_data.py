import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlight.operators import chunks as C
from loomlight.operators import evaluate as E
from loomlight.operators import review as R
from loomlight.operators import vectors as V
from loomlight.sources import files
from loomlight.streaming.ingest import TemporaryError, ingest, pending, retry


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab c", max_size=700), max_size=12))
def test_chunks_keep_their_bounds(paras):
    got = C.pack([p for p in paras if p])
    assert all(50 <= len(c) <= 1920 and c == c.strip() for c in got)


def test_chunks_overlap_and_cut_at_spaces(spark):
    a, b = "x" * 1190, "y" * 100
    assert C.pack([a, b]) == [a, "x" * 150 + " " + b]
    long = ("word " * 500).strip()
    got = C.pack([long])
    assert all(len(c) <= 1200 for c in got[:-1]) and got[0].endswith("word")
    assert C.pack(["z" * 49]) == [] and C.pack([]) == []
    rows = C.chunk(
        spark.createDataFrame([("b", "Book", "p" * 60 + "\n\n" + "q" * 1200)], "book_id string, book string, text string")
    ).orderBy("chunk_index").collect()
    assert [r["id"] for r in rows] == ["b#0", "b#1"] and rows[0]["chars"] == 60


BUNDLE = [C.Book("one", "First Tale"), C.Book("two", "Second (Tale)", "a fast-paced"), C.Book("three", "Third")]
RAW = "Contents\nFirst Tale\nSecond (Tale)\nThird\n\n First Tale \nA Bantam Book\nbody one\nwhat a FAST-paced story\nbody two Third of it"


def test_book_starts():
    got = [(b.book_id, RAW[at : at + 8]) for at, b in C.book_starts(RAW, BUNDLE)]
    assert got == [("one", " First T"), ("two", "a FAST-p"), ("three", "Third of")]
    assert C.book_starts("anything", BUNDLE[:1]) == [(0, BUNDLE[0])]


def test_split_books(spark):
    raw = spark.createDataFrame([("r", RAW), ("other", "x")], "raw_id string, text string")
    rows = C.split_books(raw, {"r": BUNDLE}).orderBy("start").collect()
    assert "".join(r["text"] for r in rows) == RAW[rows[0]["start"] :] and [r["book_id"] for r in rows] == ["one", "two", "three"]


def test_source_filter():
    assert V.source_filter([]) is None and V.source_filter(["wiki", "got"]) is None
    assert V.source_filter(["wiki", "knight", "knight"]) == ["kotsk"]
    assert V.source_filter(["A Song of Ice and Fire", "fire-and-blood"]) == ["agot", "acok", "asos", "affc", "fab"]


@pytest.fixture
def vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "a"), (4, [0.0, 0.0], "a"), (5, [0.6, 0.8], "b")]
    return spark.createDataFrame(rows, "id long, values array<float>, book_id string")


def test_top_k(vectors):
    assert [(r["id"], r["score"]) for r in V.top_k(vectors, [2.0, 0.0], 3).collect()] == [(1, 1.0), (2, 1.0), (5, 0.6)]
    assert [r["id"] for r in V.top_k(vectors, [1.0, 0.0], 8, ["a"]).collect()] == [1, 3, 4]
    assert [r["id"] for r in V.top_k(vectors, [1.0, 0.0], 8, min_score=0.5).collect()] == [1, 2, 5]


def test_top_k_batch_in_blocks(spark, vectors, monkeypatch):
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "qid long, values array<double>")
    want = {(i, r["id"], r["score"]) for i in range(5) for r in V.top_k(vectors, [float(i), 1.0], 2).collect()}
    for block in (4_000_000, 3):
        monkeypatch.setattr(V, "BLOCK_VALUES", block)
        assert {(r["qid"], r["id"], r["score"]) for r in V.top_k_batch(vectors, q, 2).collect()} == want
    assert V.top_k_batch(vectors, q.limit(0), 2).count() == 0
    own = q.withColumn("book_id", F.lit("b"))
    assert {r["id"] for r in V.top_k_batch(vectors, own, 8).collect()} == {2, 5}


def test_store(spark, vectors, tmp_path):
    store = V.vector_store("table", spark, str(tmp_path / "v"), 2)
    store.upsert(vectors)
    store.upsert(spark.createDataFrame([(1, [0.0, 1.0], "a"), (9, [1.0, 0.1], "a")], "id long, values array<float>, book_id string"))
    assert [r["id"] for r in store.query([1.0, 0.0], 2, ["a"]).collect()] == [9, 4] or [r["id"] for r in store.query([1.0, 0.0], 1, ["a"]).collect()] == [9]
    with pytest.raises(ValueError, match="dimensions"):
        store.query([1.0], 1)
    with pytest.raises(Exception, match="wrong vector size"):
        store.upsert(spark.createDataFrame([(7, [1.0], "a")], "id long, values array<float>, book_id string"))
    with pytest.raises(NotImplementedError):
        V.vector_store("qdrant", spark, "x")
    with pytest.raises(ValueError, match="there already"):
        V.insert(vectors, vectors)


def test_embedder_is_deterministic(spark):
    rows = spark.createDataFrame([("a b",), ("b  a",), ("",), (None,)], "t string").select(V.hashing_embedder(16)("t").alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-6 and rows[2]["v"] == rows[3]["v"] == [0.0] * 16


def test_parts(spark):
    rows = spark.range(0, 23_000, 2).withColumnRenamed("id", "k")
    got = V.parts(rows, "k", 1000).groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("a")).orderBy("part").collect()
    assert [r["n"] for r in got] == [1000] * 11 + [500] and [r["a"] for r in got] == [2000 * i for i in range(12)]


def test_review(spark):
    said = [
        ("c1", "x", 'ok [{"subject":"A","relation":"parent-of","object":"B","evidence":"e1"}]'),
        ("c2", "x", '[{"subject":"A","relation":"parent-of","object":"B","evidence":7},{"subject":"A","relation":"rival-of","object":"B"}]'),
        ("c3", "x", '[{"subject":"B","relation":"spouse-of","object":"Q"}]'),
        ("c4", "x", "torn [{"),
        ("c5", "x", '[{"subject":"B","relation":"spouse-of","object":"A","evidence":"' + "y" * 400 + '"}]'),
    ]
    index = spark.createDataFrame([("a", "ida", 0), ("b", "idb", 0)], "key string, id string, n_aliases int")
    rows = R.candidates(spark.createDataFrame(said, "chunk_id string, book_id string, output string"), index)
    assert rows.count() == 4 and rows.agg(F.max(F.length("evidence"))).collect()[0][0] == 300
    grouped = R.groups(rows, spark.createDataFrame([("spouse|ida|idb",)], "key string"))
    got = {r["key"]: (r["cls"], r["n"], r["n_chunks"]) for r in grouped.collect()}
    assert got == {"parent|ida|idb": ("novel", 2, 2), "spouse|ida|idb": ("confirms-seed", 1, 1), "unresolved|spouse|B|Q": ("needs-node", 1, 1)}
    names = spark.createDataFrame([("ida", "Ida")], "id string, name string")
    work = [r["line"] for r in R.worklist(grouped, names=names).collect()]
    assert work[0] == "- **B —spouse-of→ Q**  _(seen 1× in 1 chunk(s); status: pending)_"
    assert work[1] == "- **Ida —parent-of→ idb**  _(seen 2× in 2 chunk(s); status: pending)_\n    - “e1”\n    - “7”"
    verdicts = spark.createDataFrame([("parent|ida|idb", "a"), ("spouse|ida|idb", "s"), ("unresolved|spouse|B|Q", "r")], "key string, verdict string")
    decided = R.decide(grouped, verdicts, rows).orderBy("status").collect()
    assert [(r["type"], r["status"], r["evidence_chunks"]) for r in decided] == [("parent", "approved", ["c1", "c2"]), ("spouse", "rejected", None)]
    assert R.undecided(grouped, spark.createDataFrame([("parent|ida|idb",)], "key string")).count() == 0


def test_review_states_merge(spark):
    import random

    r = random.Random(6)
    said = [(i, r.choice("AB"), r.choice("CD"), r.choice(["", "e1", "e2", "e3", "e4"])) for i in range(300)]
    text = '[{"subject":"%s","relation":"parent-of","object":"%s","evidence":"%s"}]'
    outputs = spark.createDataFrame([(f"c{i % 90}", "x", text % (a, b, e), 1000 - i) for i, a, b, e in said], "chunk_id string, book_id string, output string, ordinal long")
    rows = R.candidates(outputs, spark.createDataFrame([(k.lower(), k, 0) for k in "ABC"], "key string, id string, n_aliases int"))
    seeds = spark.createDataFrame([("parent|A|C",)], "key string")
    want = {}
    for i, a, b, e in reversed(said):  # in order of the ordinal
        n, chunks, quotes = want.setdefault((a, b), (0, set(), []))
        want[a, b] = n + 1, chunks | {i % 90}, quotes + [e] if e and e not in quotes and len(quotes) < 2 else quotes
    key = lambda a, b: f"parent|{a}|C" if b == "C" else f"unresolved|parent|{a}|{b}"
    whole = {r["key"]: (r["n"], r["n_chunks"], r["evidence"], r["cls"]) for r in R.groups(rows, seeds).collect()}
    cls = lambda a, b: "needs-node" if b == "D" else "confirms-seed" if a == "A" else "novel"
    assert whole == {key(a, b): (n, len(c), q, cls(a, b)) for (a, b), (n, c, q) in want.items()}
    epochs = [R.states(rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == i)) for i in range(3)]
    merged = R.grouped_states(R.merge(R.merge(epochs[0].unionByName(epochs[1])).unionByName(epochs[2])), seeds)
    for g in merged.collect():
        n, chunks, quotes, cls = whole[g["key"]]
        assert (g["n"], g["evidence"], g["cls"]) == (n, quotes, cls) and abs(g["n_chunks"] - chunks) <= 0.05 * chunks + 1


def test_review_groups_keep_every_piece_of_evidence(spark, tmp_path):
    import duckdb

    from loomlight.plans.data_queries import QUERIES

    spark.sql("select id c_custkey, concat('Customer#', lpad(id, 9, '0')) c_name, 'M' c_mktsegment from range(40)").write.parquet(str(tmp_path / "customer.parquet"))
    # Line numbers 1, 4 and 7 make spouses, 3 and 6 parents; the latest line of a pair comes first.
    lines = [(1, 7, 1, 2), (2, 1, 1, 2), (2, 1, 1, 2), (3, 4, 2, 1), (4, 6, 1, 2), (5, 3, 1, 2), (6, 4, 5, 2), (7, 1, 5, 2), (8, 7, 5, 2), (9, 4, 1, 3)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines.withColumn("l_returnflag", F.lit("A")).write.parquet(str(tmp_path / "lineitem.parquet"))
    query, sql = QUERIES["review_groups"]
    got = {tuple(r) for r in query(spark, str(tmp_path)).collect()}
    unresolved = "unresolved|spouse|Customer#900000005|Customer#000000002"
    assert got == {
        ("spouse|1|2", 4, 3, "line 7; line 1; line 4", "confirms-seed"),
        ("parent|1|2", 2, 2, "line 6; line 3", "novel"),
        (unresolved, 3, 3, "line 4; line 1; line 7", "needs-node"),
        ("spouse|1|3", 1, 1, "line 4", "novel"),
    }
    con = duckdb.connect()
    for name in ("customer", "lineitem"):
        con.sql(f"create view {name} as from '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(con.sql(sql).fetchall()) == got


def test_review_states_merge_with_every_piece(spark):
    said = [(i, "e%d" % (i * 7 % 5) if i % 4 else "") for i in range(40)]
    text = '[{"subject":"A","relation":"parent-of","object":"B","evidence":"%s"}]'
    outputs = spark.createDataFrame([(f"c{i}", "x", text % e, i) for i, e in said], "chunk_id string, book_id string, output string, ordinal long")
    rows = R.candidates(outputs, spark.createDataFrame([("a", "ida", 0), ("b", "idb", 0)], "key string, id string, n_aliases int"))
    seeds = spark.createDataFrame([("parent|x|y",)], "key string")
    want = list(dict.fromkeys(e for _, e in said if e))
    whole = R.groups(rows, seeds, most=None)
    assert [r["evidence"] for r in whole.collect()] == [want] and len(want) == 5
    epochs = [R.states(rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == i), most=None) for i in range(2)]
    merged = R.grouped_states(R.merge(epochs[0].unionByName(epochs[1]), most=None), seeds)
    assert [r["evidence"] for r in merged.collect()] == [want]
    # A worklist shows the first two, however many a group has.
    assert R.worklist(whole).collect()[0]["line"].split("\n")[1:] == [f"    - “{e}”" for e in want[:2]]


def test_regex_extractor(spark):
    rows = spark.createDataFrame(
        [("c", "b", "There was Jon Reed, son of Mary Reed. Ann Poe married to Bo Poe.")], "chunk_id string, book_id string, text string"
    )
    got = R.candidates(rows.withColumn("output", R.regex_extractor())).select("type", "raw_subject", "raw_object").collect()
    assert {tuple(r) for r in got} == {("parent", "Mary Reed", "Jon Reed"), ("spouse", "Ann Poe", "Bo Poe")}


def test_checks(spark):
    cases = spark.createDataFrame(
        [("1", ["Ann"], True, False, ["Bo"]), ("2", None, False, True, None), ("3", ["x"], True, False, None)],
        "id string, expected_facts array<string>, required_citation boolean, must_refuse boolean, must_not_reveal array<string>",
    )
    answers = spark.createDataFrame([("1", "ANN met bo", 2), ("2", "The sources do not cover that", 0)], "id string, answer string, n_citations int")
    got = {(r["id"], r["name"]): (r["pass"], r["detail"]) for r in E.checks(cases, answers).collect()}
    assert got["1", "expected-facts-present"] == (True, []) and got[
        "1", "spoiler-ceiling-respected"
    ] == (False, ["Bo"]) and got["2", "refuses-out-of-corpus"][0]
    assert got["3", "citation-present"][0] is False and got["3", "expected-facts-present"] == (False, ["x"])
    assert tuple(E.totals(E.checks(cases, answers)).collect()[0]) == (3, 3, 3)


def test_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"type":"parent","src":"a"}\n\n{"__processed":"c1"}\n{"type":"spo')
    assert files.read_candidates(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "v.jsonl").write_text('{"id":"a"}\n{"id":"a"}\n{"id":"b"}\n{"id":"')
    assert {r["id"] for r in files.done_ids(spark, str(tmp_path / "v.jsonl")).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "v.jsonl"), "id string", strict=True).collect()
    seed = {
        "meta": {"version": "1"},
        "nodes": [{"id": "a", "name": "A", "aliases": ["x"]}],
        "edges": [{"type": "parent", "from": "a", "to": "b"}, {"type": "spouse", "a": "a", "b": "c"}],
    }
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=1))
    nodes, edges = files.read_seed(spark, str(tmp_path / "seed.json"))
    assert nodes.count() == 1 and [(r["src"], r["dst"]) for r in edges.orderBy("edge_ord").collect()] == [("a", "b"), ("a", "c")]
    assert files.read_reviewed(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "vars").write_text("# c\nA=1\nB=\"x y\"\nA=2\nC='q=r'\n\n")
    assert {r["key"]: r["value"] for r in files.read_settings(spark, str(tmp_path / "vars")).collect()} == {"A": "1", "B": "x y", "C": "q=r"}
    (tmp_path / "cases.json").write_text(json.dumps({"questions": [{"id": "q1", "question": "?", "expected_facts": ["x"]}]}))
    assert files.read_cases(spark, str(tmp_path / "cases.json")).collect()[0]["expected_facts"] == ["x"]
    files.write_parts(spark.range(25), str(tmp_path / "parts"), 10)
    assert all(p.read_text().count("\n") <= 10 for p in (tmp_path / "parts").glob("*.json"))
    files.write_raw(spark.createDataFrame([("one", "text")], "raw_id string, text string"), str(tmp_path / "raw"))
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "raw-one.txt").write_text("a\nb")
    assert [tuple(r) for r in files.raw_texts(spark, str(tmp_path / "texts")).collect()] == [("one", "a\nb")]


def test_pdf_scan(spark, tmp_path):
    import pandas as pd

    for name in ("b.pdf", "a.PDF", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())

    @F.pandas_udf("text string, num_pages int")
    def extract(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": content.map(lambda c: c.decode()), "num_pages": 2})

    assert [(r["file"], r["text"]) for r in files.pdf_texts(spark, str(tmp_path), extract).collect()] == [("a.PDF", "a.PDF"), ("b.pdf", "b.pdf")]


def test_ingest_resumes(spark, tmp_path):
    source, sink, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    work = lambda df: df.withColumn("error", F.when(F.col("id") % 10 == 3, "busy"))
    for part in (range(0, 20), range(20, 30)):
        spark.createDataFrame([(i,) for i in part], "id long").write.mode("append").parquet(source)
        ingest(spark, source, "id long", sink, mark, work)
    done = spark.read.parquet(f"{sink}/processed")
    assert done.count() == 27 and spark.read.parquet(f"{sink}/results").count() == 27
    assert {r["id"] for r in pending(spark.read.parquet(source), done).collect()} == {3, 13, 23}


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise TemporaryError
        return "done"

    assert retry(call, wait=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(TemporaryError):
        retry(lambda: (_ for _ in ()).throw(TemporaryError()), tries=1, wait=waits.append)


def test_reviewed_edges_come_back(spark, tmp_path):
    edges = [
        {"type": "parent", "from": "a", "to": "b", "source": "x", "status": "approved", "evidenceChunks": ["c1"]},
        {"type": "spouse", "a": "a", "b": "c", "status": "rejected"},
    ]
    (tmp_path / "reviewed.json").write_text(json.dumps(edges))
    rows = files.read_reviewed(spark, str(tmp_path / "reviewed.json"))
    want = [("parent", "a", "b", "approved", ["c1"]), ("spouse", "a", "c", "rejected", None)]
    key = lambda df: sorted([tuple(r) for r in df.select("type", "src", "dst", "status", "evidence_chunks").collect()], key=repr)
    assert key(rows) == sorted(want, key=repr)
    files.write_reviewed(rows, str(tmp_path / "again"))
    assert key(files.read_reviewed(spark, str(tmp_path / "again"))) == sorted(want, key=repr)


def test_raw_texts_come_back(spark, tmp_path):
    rows = [("one", "a\nb\n"), ("t w/o", "x"), ("blank", "")]
    files.write_raw(spark.createDataFrame(rows, "raw_id string, text string"), str(tmp_path / "raw"))
    assert sorted(map(tuple, files.raw_texts(spark, str(tmp_path / "raw")).collect())) == sorted(rows)


def test_a_store_opened_again_goes_on(spark, vectors, tmp_path):
    path = str(tmp_path / "v")
    V.TableStore(spark, path, 2).upsert(vectors)
    again = V.TableStore(spark, path, 2)
    assert {r["id"] for r in again.query([1.0, 0.0], 8).collect()} == {1, 2, 3, 4, 5}
    again.upsert(spark.createDataFrame([(9, [1.0, 0.1], "a")], "id long, values array<float>, book_id string"))
    assert V.TableStore(spark, path, 2).version == 2 and V.TableStore(spark, path, 2).rows().count() == 6
    with pytest.raises(ValueError, match="dimensions"):
        V.TableStore(spark, path, 3)


def test_books_of_sources(spark):
    rows = spark.createDataFrame([([],), (None,), (["wiki"],), (["knight", "wiki", "fire-and-blood"],)], "s array<string>")
    got = [r["b"] for r in rows.select(V.books_of(F.col("s")).alias("b")).collect()]
    assert got == [V.SOURCES[V.DEFAULT_SOURCE]] * 2 + [None, ["kotsk", "fab"]]


def test_hashed_words_equal_the_plain_rule(spark):
    import hashlib

    got = spark.createDataFrame([(" The the\tcat ",), ("",), (None,)], "t string").select(V.hashed_words(F.col("t"), 8).alias("v")).collect()
    want = [0.0] * 8
    for w in ("the", "the", "cat"):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        want[h % 8] += 1.0 if h // 8 % 2 == 0 else -1.0
    assert got[0]["v"] == want and got[1]["v"] == got[2]["v"] == [0.0] * 8


def test_small_parts(spark, tmp_path):
    from loomlight.functions.text import authorized, scan_report

    rows = spark.createDataFrame([("Bearer k",), ("Bearer x",), ("k",), (None,)], "h string")
    got = [(r["a"]["ok"], r["a"]["reason"]) for r in rows.select(authorized(F.col("h"), "k").alias("a")).collect()]
    assert got == [(True, None), (False, "invalid token"), (False, "missing bearer token"), (False, "missing bearer token")]
    assert rows.select(authorized(F.col("h"), None)["ok"].alias("x")).distinct().collect() == [(True,)]
    scans = spark.createDataFrame([("a.pdf", "x" * 900, 1), ("b.pdf", "x", 1), ("c.pdf", None, None)], "file string, text string, num_pages int")
    got = {r["file"]: (r["verdict"], r["any_scanned"]) for r in scan_report(scans).collect()}
    assert got == {"a.pdf": ("TEXT", True), "b.pdf": ("SCANNED", True), "c.pdf": ("ERROR", True)}
    chunks = spark.createDataFrame([("b", 1), ("a", 2), ("a", 0)], "book_id string, chunk_index int")
    assert [tuple(r) for r in R.first_chunks(chunks, 2).collect()] == [("a", 0), ("a", 2)]
    (tmp_path / "vars").write_text("A=1\nB=2\n")
    assert files.settings(spark, str(tmp_path / "vars"), {"B": "given"}) == {"A": "1", "B": "given"}
    lines = spark.createDataFrame([("novel", -2, 1, "k", "- x"), ("novel", -9, 2, "j", "- y")], "section string, place int, seen int, key string, line string")
    want = ["# Edges to review", "## Novel (resolved, not in seed) — 2", "- y", "- x", "## Needs node (unresolved name) — 0"]
    assert [r["line"].strip() for r in R.worklist_text(lines).collect()] == want


def plain_chunks(paras, target=1200, overlap=150, hard=1920, least=50):
    """The rule restated: full pieces close before `target`, each begins with the end of the one before."""
    done, held = [], ""
    for p in paras:
        if held and len(held) + 1 + len(p) > target:
            done.append(held)
            held = held[-overlap:]
        held = held + " " + p if held else p
        while len(held) > hard:
            at = held[: target + 1].rfind(" ")
            at = at if at > target // 2 else target
            done.append(held[:at])
            held = held[at - overlap :].lstrip()
    return [x.strip() for x in [*done, held] if len(x.strip()) >= least]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab ", min_size=1, max_size=900), st.integers(1, 5000).map(lambda n: "x" * n), st.integers(1, 900).map(lambda n: "word " * n)), max_size=9))
def test_chunks_equal_the_plain_rule(paras):
    assert C.pack(paras) == plain_chunks(paras)
