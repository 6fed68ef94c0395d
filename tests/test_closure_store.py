import random

import pytest
from pyspark.sql import functions as F

from loomlight.operators import graph as G
from loomlight.operators.closure_store import ClosureStore
from loomlight.sources.log_table import Conflict
from loomlight.storage import scratch

EDGE = "type string, src long, dst long, source string, status string, edge_ord long"


def graph(spark, links):
    return G.Graph(spark.createDataFrame([], "id long, name string"), spark.createDataFrame([("parent", b, a, "seed", None, i) for i, (a, b) in enumerate(links)], EDGE))


def reach(links):
    """Plain search from every node."""
    out = set()
    for start in {a for a, _ in links}:
        todo, seen = [b for a, b in links if a == start and b != start], set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [b for a, b in links if a == x and a != b]
        out |= {(start, x) for x in seen}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_extended_equals_compiled_again(spark, seed):
    r = random.Random(seed)
    draw = lambda n: [(r.randrange(18), r.randrange(18)) for _ in range(n)]
    seed_links, batches = draw(9), [draw(5), draw(6)]
    store = ClosureStore(spark, scratch(spark), buckets=4)
    store.create(graph(spark, seed_links), "parent")
    known, every = reach(seed_links), list(seed_links)
    for batch in batches:
        every += batch
        rows = spark.createDataFrame([*batch, *batch, (None, 3), (4, None), (5, 5)], "id long, other long")
        new = {tuple(x) for x in store.extend(rows).select("id", "other").collect()}
        assert new == reach(every) - known
        known |= new
    stored = store.pairs().select("id", "other").collect()
    assert len(stored) == len(known) and {tuple(x) for x in stored} == known
    again = ClosureStore(spark, store.path)
    assert again.epochs == store.epochs and again.pairs().count() == len(known)


def test_work_follows_the_new_pairs(spark):
    chains = [(100 * c + i, 100 * c + i + 1) for c in range(20) for i in range(8)]
    store = ClosureStore(spark, scratch(spark))
    assert store.create(graph(spark, chains), "parent").count() == 20 * 36
    link = spark.createDataFrame([(8, 100), (0, 8)], "id long, other long")
    assert store.extend(link).count() == 9 * 9  # of the chain's nodes to the other chain's; 0 to 8 is known
    part = store.reached_from(spark.createDataFrame([(4,)], "id long"))
    assert part.count() == 4 + 9
    near = spark.createDataFrame([(4,)], "id long")
    folders = store._read("id", near).select(F.regexp_extract(F.input_file_name(), "(epoch[^/]*)/id/(_bucket=[0-9]+)", 2)).distinct().collect()
    assert len(folders) == 1  # of sixteen
    before = store.epochs
    assert store.extend(spark.createDataFrame([(2, 104)], "id long, other long")).count() == 0 and store.epochs == before


def test_of_two_writers_one_wins(spark):
    path = scratch(spark)
    one = ClosureStore(spark, path)
    one.create(graph(spark, [(1, 2)]), "parent")
    two = ClosureStore(spark, path)
    one.extend(spark.createDataFrame([(2, 3)], "id long, other long"))
    with pytest.raises(Conflict):
        two.extend(spark.createDataFrame([(2, 4)], "id long, other long"))
    two.refresh()
    assert two.extend(spark.createDataFrame([(2, 4)], "id long, other long")).count() == 2
    assert {tuple(x) for x in two.pairs().select("id", "other", "since").collect()} == {(1, 2, 0), (1, 3, 1), (2, 3, 1), (1, 4, 2), (2, 4, 2)}


def test_an_empty_store(spark):
    store = ClosureStore(spark, scratch(spark), kind="string")
    assert store.pairs().count() == 0
    assert {tuple(x) for x in store.extend(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, other string")).collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}
