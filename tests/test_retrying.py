import time


from loomlight.streaming.ingest import TemporaryError
from loomlight.streaming.retrying import DEAD, FINISHED, RESULT, backoff, ingest_retrying, outcomes


def test_waits_double_up_to_a_limit():
    assert [backoff(n, 1.0, 30.0) for n in range(1, 8)] == [1, 2, 4, 8, 16, 30, 30]


def test_failed_rows_are_tried_again_within_the_stream(spark, tmp_path):
    source, sink, mark, tries = (str(tmp_path / x) for x in ("in", "out", "mark", "tries"))

    def work(row):
        """Every third row fails twice, one always, one for good; tries are counted in files."""
        from pathlib import Path

        at = Path(tries) / str(row["id"])
        at.mkdir(parents=True, exist_ok=True)
        n = len(list(at.iterdir())) + 1
        (at / str(n)).touch()
        if row["id"] == 4:
            raise ValueError("not readable")
        if row["id"] == 6 or row["id"] % 3 == 0 and n < 3:
            raise TemporaryError("busy")
        return [{"part": i, "text": row["text"]} for i in range(row["id"] % 3)]

    spark.createDataFrame([(i, f"t{i}") for i in range(9)], "id long, text string").coalesce(1).write.parquet(source)
    query = ingest_retrying(spark, source, "id long, text string", sink, mark, work, every="200 milliseconds", tries=4, base=0.05, most=0.2)
    try:
        until = time.time() + 150
        while time.time() < until:
            if query.exception():
                raise query.exception()
            if (tmp_path / "out").exists() and any((tmp_path / "out").rglob("*.parquet")):
                done = outcomes(spark, sink, FINISHED).count()
                if done == 7 and outcomes(spark, sink, DEAD).count() == 2:
                    break
            time.sleep(0.5)
    finally:
        query.stop()
    finished = {int(r["id"]): r["tries"] for r in outcomes(spark, sink, FINISHED).collect()}
    assert finished == {0: 3, 1: 1, 2: 1, 3: 3, 5: 1, 7: 1, 8: 1} and outcomes(spark, sink, FINISHED).count() == 7
    got = sorted((int(r["id"]), r["value"]["part"], r["value"]["text"]) for r in outcomes(spark, sink, RESULT, "part int, text string").collect())
    assert got == [(i, p, f"t{i}") for i in (1, 2, 5, 7, 8) for p in range(i % 3)]
    dead = {int(r["id"]): (r["tries"], r["error"]) for r in outcomes(spark, sink, DEAD).collect()}
    assert dead[4] == (1, "ValueError: not readable") and dead[6] == (4, "busy")
