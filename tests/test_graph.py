import random

import pytest
from pyspark.sql import functions as F

from loomlight.operators import graph as G
from loomlight.operators.answers import NOTE, REFUSAL, answer, compose
from loomlight.operators import entities as E
from loomlight.operators.entities import resolve, resolve_names
from loomlight.functions.text import normalize_name
from loomlight.operators.vectors import hashed_words
from loomlight.plans.ask import ask, graph_facts, graph_side

NODE, EDGE = "id string, name string, house string, gender string, aliases array<string>, node_ord long", "type string, src string, dst string, source string, status string, edge_ord long"

PEOPLE = [
    ("ada", "Ada Marsh", "Marsh", "female", ["The Tall", "Ada of the Fen"]),
    ("ada2", "Ada Marsh", "Marsh", "female", []),
    ("bo", "Bo Marsh", "", "male", []),
    ("cy", "Cy Marsh", None, "male", ["Egg"]),
    ("di", "Di Reed", "Reed", "female", ["Miller's Girl"]),
    ("ed", "Ed Marsh", "Marsh", "male", []),
    ("flo", "Flo Marsh", "Marsh", "female", []),
    ("gus", "Gus Marsh", "Marsh", None, []),
    ("tim1", "Tim Holt", "Holt", "male", []),
    ("tim2", "Tim Holt", "Holt", "male", []),
    ("kid", "Kid Holt", "Holt", "male", []),
]
TIES = [
    ("parent", "ada", "cy"), ("parent", "bo", "cy"), ("parent", "cy", "ed"), ("parent", "di", "ed"), ("parent", "cy", "flo"), ("parent", "di", "flo"),
    ("parent", "cy", "gus"), ("spouse", "cy", "di"), ("spouse", "bo", "ada"), ("parent", "tim1", "kid"), ("parent", "ghost", "tim2"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(*p, i) for i, p in enumerate(PEOPLE)], NODE)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*e, "seed", None, i) for i, e in enumerate(TIES)], EDGE)


@pytest.fixture(scope="module")
def graph(nodes, edges):
    return G.compile_graph(nodes, edges)


def names(rows):
    return [r["object"] for r in rows.orderBy("place").collect()]


def asked(spark, graph, text):
    return graph_facts(spark.createDataFrame([(1, text)], "qid long, question string"), graph)


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Who were Ed Marsh's parents?", ["Cy Marsh", "Di Reed"]),
        ("Who was Ed Marsh's mother?", ["Di Reed"]),
        ("Who were Ed Marsh's siblings?", ["Flo Marsh", "Gus Marsh"]),
        ("Who was Flo Marsh's grandmother?", ["Ada Marsh"]),
        ("Who were the ancestors of Ed Marsh?", ["Cy Marsh", "Ada Marsh", "Bo Marsh", "Di Reed"]),
        ("Who was the wife of Cy Marsh?", ["Di Reed"]),
        ("Name the children of The Tall", ["Cy Marsh"]),
        ("Name the sons of Miller's Girl", ["Ed Marsh"]),
        ("Who was Egg's father?", []),
        ("Where is Ed Marsh?", []),
        ("Who was the father of Tim Holt?", []),
        ("Who were the parents of Tim Holt?", ["ghost"]),
    ],
)
def test_questions(spark, graph, question, want):
    assert names(asked(spark, graph, question)) == want


def test_prominent_namesake_wins_and_equals_are_ambiguous(spark, graph):
    q = spark.createDataFrame([(1, "ada marsh"), (2, "of tim holt x"), (3, "nobody")], "qid long, norm string")
    got = {(r["qid"], r["id"], r["ambiguous"]) for r in resolve(q, G.name_index(graph.nodes)).collect()}
    assert got == {(1, "ada", False), (2, "tim1", True), (2, "tim2", True)}


def test_answers(spark, graph):
    q = spark.createDataFrame(
        [(1, "Who were Ed Marsh's parents?", ["knight"]), (2, "Who are the parents of Tim Holt?", []), (3, "Weather?", None)],
        "qid long, question string, sources array<string>",
    )
    got = {r["qid"]: r for r in ask(q, graph).collect()}
    assert got[1]["answer"] == "Ed Marsh's parents were Cy Marsh (father) and Di Reed (mother)."
    assert [c["locator"] for c in got[1]["citations"]] == ["Ed Marsh → father → Cy Marsh", "Ed Marsh → mother → Di Reed"]
    assert got[1]["meta"].startswith("provider=gemini (gemini-3-flash) · sources=[knight] ·")
    assert got[2]["answer"] == "Tim Holt's parent was ghost." + NOTE
    assert got[3]["answer"] == REFUSAL and got[3]["citations"] == []


def test_passage_comes_after_facts_and_before_refusal(spark, graph):
    q = spark.createDataFrame([(1, "Who was Ed Marsh's mother?", []), (2, "Weather?", [])], "qid long, question string, sources array<string>")
    top = spark.createDataFrame([(i, "Book", "chunk 4", None, "Rain.") for i in (1, 2)], "qid long, work string, locator string, url string, text string")
    got = {r["qid"]: r for r in answer(q, compose(graph_facts(q, graph)), top).collect()}
    assert got[1]["answer"] == "Ed Marsh's mother was Di Reed." and [c["work"] for c in got[1]["citations"]] == ["Genealogy graph", "Book"]
    assert got[2]["answer"] == "Rain." and [c["locator"] for c in got[2]["citations"]] == ["chunk 4"]


def test_twelve_facts_at_most(spark, nodes):
    many = spark.createDataFrame([("parent", "ada", f"k{i:02}", "seed", None, 99 - i) for i in range(20)], EDGE)
    got = names(asked(spark, G.compile_graph(nodes, many), "children of Ada of the Fen"))
    assert got == [f"k{i:02}" for i in range(19, 7, -1)]


def test_compile_and_warnings(spark, nodes, edges):
    twice = nodes.unionByName(spark.createDataFrame([("ada", "Ada Again", "M", "female", [], 50)], NODE))
    more = edges.unionByName(
        spark.createDataFrame(
            [
                ("parent", "ada", "cy", "x", None, 20),
                ("spouse", "di", "cy", "x", None, 21),
                ("parent", "ed", "ed", "x", None, 22),
                ("rival", "ed", "cy", "x", None, 23),
                ("parent", "ed", "ada", "x", None, 24),
                ("parent", "flo", "cy", "x", None, 25),
            ],
            EDGE,
        )
    )
    reviewed = spark.createDataFrame(
        [
            ("parent", "ed", "kid", "r", "approved", 1),
            ("parent", "ada", "cy", "r", None, 2),
            ("parent", "ed", "gone", "r", "", 3),
            ("spouse", "ed", "kid", "r", "rejected", 4),
        ],
        EDGE,
    )
    g = G.compile_graph(twice, more, reviewed)
    assert g.nodes.where("id = 'ada'").select("name", "node_ord").collect() == [("Ada Again", 0)]
    assert G.counts(g).collect()[0].asDict() == {"nodes": 11, "parent_edges": 13, "spouse_edges": 2, "added_from_review": 1}
    kinds = {(r["kind"], r["key"]) for r in G.warnings(twice, more, reviewed).collect()}
    assert {
        ("duplicate-node", "ada"),
        ("duplicate-edge", "parent|ada|cy"),
        ("duplicate-edge", "spouse|cy|di"),
        ("unknown-node", "parent|ed|gone"),
        ("self-edge", "parent|ed|ed"),
        ("more-than-two-parents", "cy"),
        ("ancestor-cycle", "ed"),
        ("ancestor-cycle", "ada"),
    } <= kinds
    assert sum(k == "unknown-type" for k, _ in kinds) == 1


def test_ordered_closure_is_a_guarded_walk(spark):
    r = random.Random(9)
    for _ in range(3):
        n = 9
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(16)]
        links, seen = [], set()
        for a, b in pairs:
            if a != b and (a, b) not in seen:
                seen.add((a, b))
                links.append((a, b))
        g = G.Graph(spark.createDataFrame([], NODE), spark.createDataFrame([("parent", str(b), str(a), "s", None, i) for i, (a, b) in enumerate(links)], EDGE))
        up = {}
        for i, (a, b) in enumerate(links):
            up.setdefault(str(a), []).append(str(b))

        def walk(x, out, mark):
            for p in up.get(x, []):
                if p not in mark:
                    mark.add(p)
                    out.append(p)
                    walk(p, out, mark)
            return out

        got = {}
        for row in G.ordered_closure(g, "parent").orderBy("id", "path").collect():
            got.setdefault(row["id"], []).append(row["other"])
        assert {k: set(v) for k, v in got.items()} == {x: set(walk(x, [], set())) for x in up}
        assert {(x["id"], x["other"]) for x in G.closure(g, "parent").collect()} == {(k, o) for k, v in got.items() for o in v}


def test_resolve_names(spark, graph):
    raw = spark.createDataFrame([(x,) for x in ["Ed Marsh", "Lord Ed Marsh", "Miller", "Tim Holt", "", "Nobody", "a"]], "raw string")
    index = G.name_index(graph.nodes)
    compat = {r["raw"]: r["id"] for r in resolve_names(raw, index).collect()}
    strict = {r["raw"]: r["id"] for r in resolve_names(raw, index, "strict").collect()}
    assert compat["Ed Marsh"] == strict["Lord Ed Marsh"] == "ed"
    assert compat["Miller"] == "di" and strict["Miller"] is None
    assert compat["a"] == "ada" and strict["a"] is None  # the longest key that contains it
    assert compat["Tim Holt"] is compat["Nobody"] is compat[""] is None


def test_load_script(spark, graph):
    lines = [r["line"] for r in G.load_script(graph).orderBy("part", "ord").collect()]
    assert lines[:2] == ["DELETE FROM edges;", "DELETE FROM nodes;"]
    assert "INSERT INTO nodes (id, name, house, gender) VALUES ('bo', 'Bo Marsh', NULL, 'male');" in lines
    assert lines[-1] == "INSERT INTO edges (type, src, dst, source) VALUES ('parent', 'ghost', 'tim2', 'seed');"


def test_normal_names_in_the_index(spark, graph):
    keys = {r["key"] for r in G.name_index(graph.nodes).collect()}
    assert {"miller s girl", "the tall", "egg"} <= keys
    assert graph.nodes.select(normalize_name(F.lit(None).cast("string")).alias("x")).collect()[0]["x"] == ""


def test_sql_backend_has_the_same_facts(spark, nodes, edges, graph):
    for rel in ("parent", "child", "spouse", "sibling", "grandparent", "grandchild", "ancestor", "descendant"):
        known = {r["id"] for r in nodes.collect()}
        want = {(r["id"], r["other"]) for r in G.relatives(graph, rel).collect() if r["other"] in known and r["id"] in known}
        assert {(r["id"], r["other"]) for r in G.sql_relatives(graph, rel, graph.nodes).collect()} == want
    q = spark.createDataFrame([(1, "Who were Ed Marsh's parents?", ["knight"])], "qid long, question string, sources array<string>")
    assert ask(q, graph, backend="sql").collect()[0]["answer"] == "Ed Marsh's parents were Cy Marsh (father) and Di Reed (mother)."


def test_a_failing_relation_leaves_other_questions_their_facts(spark, graph, monkeypatch):
    import loomlight.plans.ask as A
    from pyspark.errors import AnalysisException

    def broken(g, rel, starts, plain=A.sql_relatives):
        if rel == "ancestor":
            raise AnalysisException("no such table")
        return plain(g, rel, starts)

    monkeypatch.setattr(A, "sql_relatives", broken)
    rows = [(1, "Who were the ancestors of Bo Marsh?"), (2, "Who were Ed Marsh's parents?"), (3, "What is rain?")]
    q = spark.createDataFrame([(i, t, ["knight"]) for i, t in rows], "qid long, question string, sources array<string>")
    got = {r["qid"]: r for r in ask(q, graph, backend="sql").collect()}
    assert "no such table" in got[1]["error"] and got[1]["answer"] and not got[1]["citations"]
    assert got[2]["error"] is None and got[2]["answer"] == "Ed Marsh's parents were Cy Marsh (father) and Di Reed (mother)."
    assert got[3]["error"] is None
    _, errors = graph_side(q, graph, backend="sql")
    assert [r["qid"] for r in errors.collect()] == [1]
    monkeypatch.setattr(A, "sql_relatives", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ask(q, graph, backend="sql")


def test_a_cycle_ends_the_sql_walk(spark, nodes):
    loop = spark.createDataFrame([("parent", "ada", "bo", "s", None, 0), ("parent", "bo", "ada", "s", None, 1)], EDGE)
    q = spark.createDataFrame([(1, "Who were the ancestors of Bo Marsh?")], "qid long, question string")
    rows, errors = graph_side(q, G.compile_graph(nodes, loop), backend="sql")
    assert rows.count() == 2 and errors.isEmpty()
    assert graph_facts(q, G.compile_graph(nodes, loop)).count() == 2


def random_graph(spark, seed, n=24, m=30):
    r = random.Random(seed)
    nodes = spark.createDataFrame([(str(i), f"N{i}", None, None, [], i) for i in range(n)], NODE)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    return G.compile_graph(nodes, spark.createDataFrame([("parent", str(a), str(b), "s", None, i) for i, (a, b) in enumerate(pairs)], EDGE)), pairs


def test_sql_closure_equals_the_other_one_on_cycles(spark):
    g, _ = random_graph(spark, 4)
    for rel, kind in (("ancestor", "parent"), ("descendant", "child")):
        want = {tuple(r) for r in G.closure(g, kind).collect()}
        assert any(a == b for a, b in want)
        assert {(r["id"], r["other"]) for r in G.sql_relatives(g, rel, g.nodes).collect()} == want
        some = g.nodes.where("id in ('3', '7')")
        assert {(r["id"], r["other"]) for r in G.sql_relatives(g, rel, some).collect()} == {p for p in want if p[0] in ("3", "7")}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("reach_", "step_", "starts_"))]


def test_strongly_connected_components(spark):
    for seed, n, m in ((1, 24, 30), (2, 10, 30)):
        _, pairs = random_graph(spark, seed, n, m)
        reach = {i: {b for a, b in pairs if a == i and a != b} for i in range(n)}
        for k in range(n):
            for i in range(n):
                if k in reach[i]:
                    reach[i] |= reach[k]
        want = {}
        for i in range(n):
            own = sorted({j for j in reach[i] if i in reach[j]} | {i})
            if len(own) > 1:
                want[i] = (own[0], len(own))
        edges = spark.createDataFrame(pairs + pairs[:3], "src long, dst long")
        assert {r["id"]: (r["component"], r["size"]) for r in G.strongly_connected(edges).collect()} == want
    assert G.strongly_connected(edges.limit(0)).collect() == []


def test_windows_meet_only_what_contains(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ab ") for _ in range(n)).strip()
    keys, texts = sorted({text(r.randrange(1, 9)) for _ in range(60)} - {""}), [text(r.randrange(0, 30)) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "qid long, norm string")
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    assert {tuple(x) for x in E.contained(t, k, 3).collect()} == {(i, x) for i, n in enumerate(texts) for x in keys if len(x) >= 3 and x in n}
    names = spark.createDataFrame([(n, n) for n in {text(r.randrange(0, 5)) for _ in range(30)}], "raw string, norm string")
    want = {(n["raw"], min(c, key=lambda x: (-len(x), x))) for n in names.collect() if n["raw"] and (c := [x for x in keys if n["raw"] in x])}
    assert {tuple(x) for x in E.inside(names, k).collect()} == want
    assert E.contained(t, k.limit(0)).collect() == [] and E.inside(names.limit(0), k).collect() == []


def test_candidates_are_hits(spark):
    """Rows that leave the join are those of the result: no key is compared with a text that does not have it."""
    keys = spark.createDataFrame([(f"customer 00000{i:04}",) for i in range(1500)], "key string")
    texts = spark.createDataFrame([(i, f"who were customer 00000{i:04} s parents") for i in range(0, 1500, 3)], "qid long, norm string")
    parts = texts.select("qid", F.explode(E.windows(F.col("norm"), E.lengths(keys, "key", 4))).alias("w"))
    assert parts.join(keys, F.col("w") == F.col("key")).count() == E.contained(texts, keys).count() == 500


def test_retrieval_filters_by_each_question(spark, graph):
    texts = ["rain falls on the fen", "snow falls on the hill", "rain on the wall"]
    rows = [(i, t, b, b.upper(), i) for i, (t, b) in enumerate(zip(texts, ("fab", "agot", "kotsk"), strict=True))]
    embed = lambda c: hashed_words(c, 64)
    vectors = spark.createDataFrame(rows, "id long, text string, book_id string, book string, chunk_index int").withColumn("values", embed(F.col("text")))
    q = spark.createDataFrame(
        [(1, "rain on the wall", ["fire-and-blood"]), (2, "rain on the wall", []), (3, "rain on the wall", ["wiki"]), (4, "  ", [])],
        "qid long, question string, sources array<string>",
    )
    got = {r["qid"]: r for r in ask(q, graph, vectors=vectors, embed=embed).collect()}
    assert {i: r["answer"] for i, r in got.items()} == {1: texts[0], 2: texts[1], 3: texts[2]}
    assert got[1]["citations"][0]["work"] == "FAB" and got[1]["citations"][0]["locator"] == "chunk 0"


def test_command_line(spark, tmp_path, capsys):
    import json

    from loomlight.__main__ import main

    seed = {
        "meta": {"version": "1"},
        "nodes": [{"id": i, "name": n, "gender": x} for i, n, _, x, _ in PEOPLE],
        "edges": [{"type": t, "from": a, "to": b} for t, a, b in TIES if t == "parent"],
    }
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    cases = {
        "questions": [
            {"id": "q1", "question": "Who was Ed Marsh's mother?", "sources": [], "expected_facts": ["Di Reed"], "required_citation": True},
            {"id": "q2", "question": "Weather?", "must_refuse": True},
        ]
    }
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    at = str(tmp_path / "seed.json")
    assert main(["build-graph", at, str(tmp_path / "graph")], spark) == 0 and main(["build-graph", at, str(tmp_path / "graph"), "--strict"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "graph/meta")).collect()[0]["parent_edges"] == 9
    assert main(["ask", at, "Who was Ed Marsh's mother?"], spark) == 0 and "Ed Marsh's mother was Di Reed." in capsys.readouterr().out
    assert main(["eval", at, str(tmp_path / "cases.json")], spark) == 0 and "3 passed, 0 failed, 2 skipped" in capsys.readouterr().out
