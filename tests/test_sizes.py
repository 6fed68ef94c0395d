"""What grows with the data never goes through the driver, and equal work is done once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight import storage
from loomlight.operators import chunks as C
from loomlight.operators import graph as G
from loomlight.operators.answers import answer, compose
from loomlight.operators.closure_store import ClosureStore
from loomlight.operators.entities import resolve, resolve_names
from loomlight.operators import vector_index as I
from loomlight.operators import vectors as V
from loomlight.operators.graph import Graph
from loomlight.plans import ask as A
from loomlight.plans.ask import graph_facts

NODE, EDGE = "id long, name string, house string, gender string, aliases array<string>, node_ord long", "type string, src long, dst long, source string, status string, edge_ord long"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def broadcasts(monkeypatch):
    """The plans with broadcasts among those of tables that the graph side has written so far."""
    seen = []

    def noted(df, *a, **b):
        if "Broadcast" in (plan := planned(df)):
            seen.append(plan)
        return storage.written(df, *a, **b)

    for module in (A, G):
        monkeypatch.setattr(module, "written", noted)
    return lambda: seen


def test_names_are_resolved_without_a_broadcast(spark):
    rows = spark.range(50).select(F.col("id").alias("qid"), F.concat(F.lit("who is person "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("norm"))
    index = rows.select(F.substring("norm", 8, 20).alias("key"), F.col("qid").alias("id"), F.lit(0).alias("n_aliases"))
    found = resolve(rows, index)
    assert "Broadcast" not in planned(found)
    assert found.where("qid = id and not ambiguous").count() == found.count() == 50
    for mode in ("compat", "strict"):
        assert "Broadcast" not in planned(resolve_names(index.select(F.col("key").alias("raw")), index, mode))


def family(spark, n=24):
    """n people, two parents each, as the derived graph has them."""
    people = spark.range(n).select("id", F.concat(F.lit("Person"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"), F.lit("h").alias("house"), F.lit("male").alias("gender"), F.expr("cast(array() as array<string>)").alias("aliases"), F.col("id").alias("node_ord"))
    links = spark.createDataFrame([("parent", k // 3 - i, k, "seed", None, 2 * k + i) for k in range(3, n) for i in (0, 1)], EDGE)
    return Graph(people, links)


def asked(spark, words, n=24):
    return family(spark, n).nodes.select(F.col("id").alias("qid"), F.concat(F.lit("Who were "), "name", F.lit(f"'s {words}?")).alias("question"), F.lit(None).cast("array<string>").alias("sources"))


def test_facts_of_questions_are_found_without_a_broadcast(spark, broadcasts):
    for words in ("parents", "siblings", "ancestors"):
        found = graph_facts(asked(spark, words), family(spark))
        assert found.count() and not broadcasts() and "Broadcast" not in planned(found)


def test_facts_are_cited_without_a_broadcast(spark):
    said = compose(graph_facts(asked(spark, "parents"), family(spark)))
    assert "Broadcast" not in planned(said)
    cited = answer(asked(spark, "parents"), said, None)
    assert "Broadcast" not in planned(cited) and cited.where("size(citations) = 2").count() == 21


def passages(spark):
    rows = [(i, [float(i % 3), 1.0, float(i % 5), 0.5], "abfc"[i % 4], "book", i, f"text {i}") for i in range(40)]
    return spark.createDataFrame(rows, "id long, values array<double>, book_id string, book string, chunk_index long, text string").replace({"a": "agot", "b": "fab"}, subset=["book_id"])


def embed(text):
    return F.array((F.length(text) % 2).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0))


def test_equal_questions_ask_for_passages_once(spark, monkeypatch):
    texts = [(i, "ab" if i % 3 else "abc", [None, ["fire-and-blood"], ["unknown"], []][i % 4]) for i in range(1, 49)]
    q = spark.createDataFrame(texts, "qid long, question string, sources array<string>")
    want = A.top_k_batch(passages(spark), q.select("qid", embed(F.col("question")).alias("values"), A.books_of(F.col("sources")).alias("books")), 3)
    seen, scan = [], A.top_k_batch
    monkeypatch.setattr(A, "top_k_batch", lambda vectors, queries, k: seen.append(queries.count()) or scan(vectors, queries, k))
    got = A.retrieve(q, passages(spark), embed, 3)
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "id", "score").collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 3 * 48
    assert seen == [6]  # two vectors, three selections of books


def test_texts_are_kept_once_for_equal_questions(spark, monkeypatch):
    texts = []

    def noted(df, *a, **b):
        out = storage.written(df, *a, **b)
        if "text" in out.columns:
            texts.append(out.count())
        return out

    monkeypatch.setattr(A, "written", noted)
    rows = A.ask(asked(spark, "parents"), family(spark), vectors=passages(spark), embed=embed).collect()
    assert texts == [1] and len(rows) == 24
    assert {r["qid"]: len(r["citations"]) for r in rows} == {k: 3 if k >= 3 else 1 for k in range(24)}
    assert all(r["answer"].startswith("text ") for r in rows if r["qid"] < 3)


def test_books_with_one_start_are_cut_in_their_order(spark):
    rows = [(raw, book, 0, "abc") for book in (2, 0, 1, 3) for raw in range(40)]
    starts = spark.createDataFrame(rows, "raw_id long, book_id int, start long, text string").repartition(5)
    cut = C.slices(starts).select("book_id", "text").distinct().collect()
    assert sorted(map(tuple, cut)) == [(0, ""), (1, ""), (2, ""), (3, "abc")]


def test_facts_are_counted_by_object_without_paths(spark, monkeypatch):
    links = [("parent", a, b, "seed", None, i) for i, (a, b) in enumerate([(1, 3), (2, 3), (1, 4), (2, 4), (3, 5), (9, 5), (5, 6), (6, 9), (7, 7)])]
    links += [("spouse", 1, 2, "seed", None, 90), ("spouse", 2, 1, "seed", None, 91), ("parent", 1, 3, "seed", None, 92)]
    people = family(spark, 9).nodes.withColumn("gender", F.when(F.col("id") % 3 == 0, "male").when(F.col("id") % 3 == 1, "female").otherwise(""))
    g = Graph(people, spark.createDataFrame(links, EDGE))  # 9 is no one's node
    want = G.facts(g).groupBy("rel", "relation", "object_id").count()
    monkeypatch.setattr(G, "ordered_closure", None)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.fact_objects(g)) == rows(want)


def test_a_query_is_sent_to_piles_of_cells_once(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 10))  # no clusters: the bounds spare little
    store = V.TableStore(spark, str(tmp_path / "s"), 10)
    store.upsert(spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id long, values array<double>, book_id string"))
    sent, met = [], I.met

    def noted(vectors, queries, keys, k, dim):
        rows = queries.collect()
        sent.append((len(rows), sum(len(r["places"]) if "places" in r else 1 for r in rows)))
        return met(vectors, queries, keys, k, dim)

    monkeypatch.setattr(I, "met", noted)
    monkeypatch.setattr(I, "ROWS", 7)
    found = store.nearest(spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "qid long, values array<double>"), 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [sorted(range(400), key=lambda j: (-round(float(unit[j] @ unit[i]), 6), j))[:5] for i in range(30)]
    assert [r["id"] for r in found.orderBy("qid", "rank").collect()] == [j for w in want for j in w]
    (seeds, _), (rest, cells) = sent
    assert seeds == 30 and rest <= 30 < 100 < cells


def test_ends_that_reach_one_another_are_spelt_out_at_the_end(spark, monkeypatch):
    store, found = ClosureStore(spark, storage.scratch(spark), buckets=2), []
    store.create(Graph(family(spark).nodes, spark.createDataFrame([("parent", 100, 3, "seed", None, 0), ("parent", 101, 100, "seed", None, 1)], EDGE)), "parent")
    unknown = ClosureStore._unknown
    monkeypatch.setattr(ClosureStore, "_unknown", lambda self, rows: found.append(rows.count()) or unknown(self, rows))
    ring = spark.createDataFrame([(i, (i + 1) % 8) for i in range(8)], "id long, other long")
    assert store.extend(ring).count() == 8 * 8 + 7 * 2  # 3 is known to lead to both
    assert found == [8 * 10]  # each pair is made once, in one turn
