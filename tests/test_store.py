"""The log-structured table and the exact vector index against plain restatements."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight.operators import vector_index as I
from loomlight.operators import vectors as V
from loomlight.sources import log_table
from loomlight.sources.log_table import Conflict, LogTable
from loomlight.storage import put_new


def held(table):
    return {r["id"]: (r["a"], r["b"]) for r in table.read().collect()}


def rows_of(spark, model):
    return spark.createDataFrame([(i, *v) for i, v in model.items()], "id long, a string, b array<double>")


def test_log_table_follows_a_dictionary(spark, tmp_path):
    r, want, path = random.Random(3), {}, str(tmp_path / "t")
    for turn in range(7):
        table = LogTable(spark, path, buckets=4)  # opened again each time
        if turn in (2, 5):
            gone = {i for i in range(60) if r.random() < 0.2}
            table.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
            want = {i: v for i, v in want.items() if i not in gone}
        else:
            new = {i: (f"{turn}-{i}", [float(turn)]) for i in range(60) if r.random() < (0.9 if not turn else 0.3)}
            table.upsert(rows_of(spark, new))
            want |= new
        assert held(table) == want
        if turn in (3, 6):
            table.compact(0.3)
            assert held(table) == want and held(LogTable(spark, path)) == want
    assert {r["id"] for r in table.read(F.col("a") == "4-7").collect()} == {i for i, v in want.items() if v[0] == "4-7"}
    assert table.vacuum() and held(LogTable(spark, path)) == want


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_an_upsert_writes_in_proportion_to_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    table = LogTable(spark, path, buckets=4)
    table.upsert(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")))
    before = size(path)
    table.upsert(spark.range(100).select("id", F.lit("new").alias("x")))
    assert size(path) - before < before / 20
    assert table.read().where("x = 'new'").count() == 100 and table.read().count() == 20_000


def test_only_full_buckets_are_merged(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(spark.range(400).select("id", F.lit("old").alias("x")))
    one = spark.range(400).where(F.pmod(F.xxhash64("id"), F.lit(4)) == 1)
    table.upsert(one.select("id", F.lit("new").alias("x")))
    table.upsert(spark.createDataFrame([(i, "few") for i in range(8)], "id long, x string"))
    bases = {b: v["folder"] for b, v in table.state["base"].items()}
    assert table.compact(0.5) == [1]
    assert [b for b, v in table.state["base"].items() if bases[b] != v["folder"]] == ["1"]
    assert table.read().where("x = 'few'").count() == 8 and table.read().count() == 400


def test_of_two_writers_one_succeeds(spark, tmp_path):
    path = str(tmp_path / "t")
    LogTable(spark, path, buckets=2).upsert(rows_of(spark, {1: ("x", [])}))
    first, second = LogTable(spark, path), LogTable(spark, path)
    first.upsert(rows_of(spark, {2: ("y", [])}))
    with pytest.raises(Conflict):
        second.upsert(rows_of(spark, {3: ("z", [])}))
    second.refresh()
    second.upsert(rows_of(spark, {3: ("z", [])}))
    assert set(held(LogTable(spark, path))) == {1, 2, 3}


def test_what_a_lost_writer_left_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    table = LogTable(spark, path, buckets=2)
    table.upsert(rows_of(spark, {1: ("x", [1.0])}))
    assert put_new(spark, f"{path}/manifest/{2:012d}.json", '{"version": 2, "del')
    again = LogTable(spark, path)
    assert again.version == 1 and held(again) == {1: ("x", [1.0])}
    again.upsert(rows_of(spark, {2: ("y", None)}))
    assert again.version == 3 and set(held(LogTable(spark, path))) == {1, 2}


def test_repeated_keys_empty_changes_and_other_columns(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), buckets=2)
    assert table.compact() == [] and table.vacuum() == []
    table.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id long, a string"))
    table.upsert(spark.createDataFrame([], "id long, a string"))
    assert table.version == 1
    table.upsert(spark.createDataFrame([(2, 5, "c")], "id long, other int, a string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "b"), (2, "c")]
    nothing = LogTable(spark, str(tmp_path / "n"), buckets=2)
    nothing.upsert(spark.createDataFrame([], "id long, a string"))
    assert nothing.read().collect() == []
    nothing.upsert(spark.createDataFrame([(1, "a")], "id long, a string"))
    assert nothing.read().count() == 1


# The index


def clustered(n=600, dim=12, centres=15, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(centres, dim))[g.integers(0, centres, n)] + g.normal(size=(n, dim)) * 0.05
    x[5], x[6], x[7] = 0, x[8], x[8] * 3  # no length; ties
    return x.astype(np.float32)


def best(x, ids, books, q, k, chosen):
    unit = lambda v: v / n if (n := np.linalg.norm(v)) else v
    q = unit(q.astype(float))
    scored = [(-round(float(unit(v.astype(float)) @ q), 6), i) for v, i, b in zip(x, ids, books, strict=True) if chosen is None or b in chosen]
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    x = clustered()
    books = ["abc"[i % 3] if i % 10 else None for i in range(len(x))]
    df = spark.createDataFrame([(f"v{i:04}", v.tolist(), b, i) for i, (v, b) in enumerate(zip(x, books, strict=True))], "id string, values array<float>, book_id string, chars int")
    s = V.TableStore(spark, str(tmp_path_factory.mktemp("store") / "s"), 12)
    s.upsert(df)
    return s, x, [f"v{i:04}" for i in range(len(x))], books


@pytest.mark.parametrize("limits", [{}, {"CELLS": 1}, {"PART_BYTES": 900, "ASKING": 3, "SCORES": 50}])
def test_index_equals_a_scan(spark, store, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(I, name, value)
    s, x, ids, books = store
    asked = [(i, x[i * 20], [None, ["a"], ["b", "c"], ["zz"]][i % 4]) for i in range(30)] + [(99, x[5], None), (98, -x[30], None)]
    q = spark.createDataFrame([(i, v.tolist(), b) for i, v, b in asked], "qid long, values array<float>, books array<string>")
    got = {}
    for r in s.nearest(q, 7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    want = {i: b for i, v, chosen in asked if (b := best(x, ids, books, v, 7, chosen))}
    assert {i: [h for h, _ in v] for i, v in got.items()} == {i: [h for h, _ in v] for i, v in want.items()}
    assert all(abs(a - b) < 2e-6 for i in want for (_, a), (_, b) in zip(got[i], want[i], strict=True))


def test_a_query_opens_few_cells(spark, store):
    s, x, _, _ = store
    q = spark.createDataFrame([(i, x[i * 11].tolist(), None) for i in range(1, 40)], "qid long, values array<float>, books array<string>")
    cells = I.merged(spark.read.parquet(f"{s.path}/cells"))
    found = I._Search(s.log.read, cells, s._centroids(s.log.about["centroids"]), q, 8)
    found.best().collect()
    n = found.cells.n
    read = sum(int(n[r["place"]]) for part in found.opened for r in part.select("place").collect())
    assert read < 0.35 * 39 * len(x)
    twice = found.opened[0].select("qid", "place").intersectAll(found.opened[1].select("qid", "place"))
    assert twice.count() == 0


def test_store_after_changes(spark, store, tmp_path):
    _, x, ids, books = store
    df = spark.createDataFrame([(i, v.tolist(), b) for i, v, b in zip(ids, x, books, strict=True)], "id string, values array<float>, book_id string")
    s = V.TableStore(spark, str(tmp_path / "s"), 12)
    with pytest.raises(ValueError, match="empty"):
        s.nearest(df.select(F.lit(1).alias("qid"), "values"))
    s.upsert(df)
    s.upsert(df.where("id like '%3'").withColumn("values", F.transform("values", lambda v: -v)))
    s.delete(df.where("id like '%4'").select("id"))
    y = np.array([-v if i.endswith("3") else v for i, v in zip(ids, x, strict=True)])
    on = [j for j, i in enumerate(ids) if not i.endswith("4")]
    q = spark.createDataFrame([(i, x[i * 20].tolist()) for i in range(20)], "qid long, values array<float>")
    for turn in range(2):
        got = {}
        for r in V.TableStore(spark, s.path, 12).nearest(q, 5).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == {i: [h for h, _ in best(y[on], [ids[j] for j in on], [None] * len(on), x[i * 20], 5, None)] for i in range(20)}
        if not turn:
            assert s.compact(0.0)
    top = s.query(x[20].tolist(), 3)
    assert "values" not in top.columns and [r["id"] for r in top.collect()][0] == ids[20]


def test_keeps_the_names_of_its_columns_apart():
    assert {log_table.BUCKET, log_table.SEQ, log_table.GONE}.isdisjoint({"cell", "off", "id", "values", "book_id"})
