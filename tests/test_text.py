import unicodedata

import pytest
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.functions.relations import detect, label, plural


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Rhaenyra's Élan", "rhaenyra s elan"), (None, ""), ("  A--B\tc ", "a b c"), ("ÀÉÎ ö", "aei o"), ("ﬁne №5", "fine o5"), ("日本", "")],
)
def test_normalize_name(spark, raw, want):
    if raw == "ﬁne №5":  # the decomposed capital is dropped, as case is folded first
        want = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in unicodedata.normalize("NFKD", raw.lower()))
        want = " ".join(want.split())
    assert one(spark, X.normalize_name(F.col("t")), t=raw) == want


def test_paragraphs(spark):
    raw = "An imag-\nination.\r\n\n\n  Two \t lines\nhere \n\n \n\nlast"
    assert one(spark, X.paragraphs(F.col("t")), t=raw) == ["An imagination.", "Two lines here", "last"]


def test_source_id(spark):
    rules = [("bundle", "b"), ("fire", "f")]
    assert one(spark, X.source_id(F.col("t"), rules), t="The BUNDLE of Fire.pdf") == "b"
    assert one(spark, X.source_id(F.col("t"), rules), t="My  Own_Book (2nd ed) of quite considerable length.pdf") == "my-own-book-2nd-ed-of-quite-considerable"
    assert one(spark, X.source_id(F.col("t"), rules), t="Up.PDF") == "up-pdf"


@pytest.mark.parametrize(("chars", "pages", "want"), [(1600, 2, (800, "TEXT")), (799, 1, (799, "PARTIAL")), (99, 1, (99, "SCANNED")), (5, 2, (3, "SCANNED")), (900, 0, (900, "TEXT"))])
def test_quality_of_scans(spark, chars, pages, want):
    per = X.chars_per_page(F.col("t"), F.col("p"))
    assert one(spark, F.struct(per.alias("a"), X.scan_verdict(per).alias("b")), t="x" * chars, p=pages) == want


@pytest.mark.parametrize(
    ("said", "n"),
    [
        ('[{"subject":"a"}]', 1),
        ('Sure!\n```json\n[{"subject":"a"},\n{"subject":"b"}]\n```', 2),
        ("no list", 0),
        ('[{"subject":"a"', 0),
        ('{"subject":"a"}', 0),
        (None, 0),
        ("[]", 0),
    ],
)
def test_parse_json_array(spark, said, n):
    assert len(one(spark, X.parse_json_array(F.col("t"), "struct<subject:string>"), t=said)) == n


@pytest.mark.parametrize(("items", "want"), [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")])
def test_list_join(spark, items, want):
    row = spark.createDataFrame([(items,)], "x array<string>")
    assert row.select(X.list_join(F.col("x")).alias("y")).collect()[0]["y"] == want


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("who was x s father", ("parent", "male")),
        ("who were x s fathers", None),
        ("great grandmother of x", ("grandparent", "female")),
        ("siblings of x daughter of y", ("child", "female")),
        ("what followed", ("spouse", None)),
        ("the tissue", ("child", None)),
        ("parental matters", ("parent", None)),
        ("her wives", ("spouse", "female")),
        ("what x descended", ("descendant", None)),
        ("x is descended from whom", ("ancestor", None)),
        ("", None),
    ],
)
def test_detect(spark, question, want):
    got = one(spark, detect(F.col("t")), t=question)
    assert (tuple(got) if got else None) == want


def test_labels(spark):
    rows = spark.createDataFrame([("parent", "male"), ("spouse", "female"), ("child", None), ("ancestor", "male"), ("rival", "male")], "rel string, g string")
    assert [r["x"] for r in rows.select(label(F.col("rel"), F.col("g")).alias("x")).collect()] == ["father", "wife", "child", "ancestor", "rival"]
    words = spark.createDataFrame([("wife",), ("child",), ("father",)], "w string")
    assert [r["x"] for r in words.select(plural(F.col("w")).alias("x")).collect()] == ["wives", "children", "fathers"]


def test_sql_quote(spark):
    assert one(spark, X.sql_quote(F.col("t")), t="O'Neil") == "'O''Neil'"
    assert one(spark, X.sql_quote(F.col("t")), t="") == "NULL"


def test_page_text(spark):
    assert one(spark, X.page_text(F.col("t")), t="<p>One<script>x<y</script> <b>two</b></p>") == "One two"
