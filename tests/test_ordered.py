import json

import pytest
from pyspark.sql import functions as F

from loomlight.sources import files
from loomlight.sources.ordered import write_ordered


def lines(path):
    return [[json.loads(x) for x in p.read_text().splitlines()] for p in sorted(path.iterdir()) if not p.name.startswith(".")]


def test_parts_in_order_with_stable_names(spark, tmp_path):
    rows = spark.range(0, 2300).select((F.col("id") * 3).alias("k"), F.concat(F.lit("ä"), "id").alias("text"), F.lit("own").alias("part"), F.lit(None).cast("string").alias("no"))
    files.write_parts(rows.repartition(7), str(tmp_path / "out"), 1000, "k")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["part-001.json", "part-002.json", "part-003.json"]
    assert [r for part in lines(tmp_path / "out") for r in part] == [{"k": 3 * i, "text": f"ä{i}", "part": "own"} for i in range(2300)]
    assert [len(p) for p in lines(tmp_path / "out")] == [1000, 1000, 300]
    got = files.read_parts(spark, str(tmp_path / "out"), "k long, text string")
    assert {r["part"]: r["n"] for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()} == {1: 1000, 2: 1000, 3: 300}
    files.write_parts(rows.limit(0), str(tmp_path / "out"), 1000, "k")
    assert lines(tmp_path / "out") == [] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_job_leaves_the_old_parts(spark, tmp_path):
    at = str(tmp_path / "out")
    write_ordered(spark.range(10), at, "id", 4)
    before = lines(tmp_path / "out")
    bad = spark.range(20).withColumn("x", F.when(F.col("id") == 13, F.raise_error(F.lit("torn"))).otherwise("fine"))
    with pytest.raises(Exception, match="torn"):
        write_ordered(bad, at, "id", 4)
    assert lines(tmp_path / "out") == before and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_store_is_extended_on_its_own_path(spark, tmp_path):
    (tmp_path / "reviewed.json").write_text(json.dumps([{"type": "parent", "from": "a", "to": "b", "status": "approved"}]))
    at = str(tmp_path / "reviewed.json")
    for i in range(3):
        one = spark.createDataFrame([("spouse", f"s{i}", "t", None, "rejected", [f"c{i}"])], "type string, src string, dst string, source string, status string, evidence_chunks array<string>")
        files.add_reviewed(spark, one, at)
    rows = files.read_reviewed(spark, at).orderBy("edge_ord").collect()
    assert [(r["src"], r["status"], r["evidence_chunks"]) for r in rows] == [("a", "approved", None), *((f"s{i}", "rejected", [f"c{i}"]) for i in range(3))]
