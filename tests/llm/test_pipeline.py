"""The pipeline's stages on a small corpus whose right result is known."""

import random

import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    good = [(i, line(80)) for i in range(300)]
    leak = line(30)
    base = line(150).split()
    near = []
    for i in range(5):
        own = list(base)
        own[10 + i] = "changed"
        near.append((400 + i, " ".join(own)))
    junk = [(500 + i, " | ".join(w.upper() + "!!" for w in line(8).split() * 6)) for i in range(120)]
    rows = good + [(300, good[7][1]), (301, good[7][1].upper().lower())] + [(310, f"{line(20)} {leak} {line(20)}")] + near + junk
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(spark, folder):
    import corpus_pipeline

    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {*range(300)} - {7} | {301, 400}


def test_all_but_the_last_stage_keep_the_columns(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
