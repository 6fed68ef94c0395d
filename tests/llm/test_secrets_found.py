"""What the models of the secret scan must find, and what they must leave alone."""

import random
import string

import pytest
from pyspark.sql import functions as F

from loomlight.llm import secret_scan

LETTERS = string.ascii_letters + string.digits
FORMS = {
    "mixed": LETTERS,
    "url": LETTERS + "-_",
    "capitals": string.ascii_uppercase + string.digits,
    "small": string.ascii_lowercase + string.digits,
}
HARMLESS = """
2024-01-15-12-30-45-000123
invoice_2024_00123_customer_000456
v1/api/users/12345/orders/67890/items
555-123-4567-890-1234-5678
20240115T123045Z
release-v12-rc3-build20240501
org/apache/spark/sql/catalyst/expressions
getUserAccountByIdAndName2
HTTPServerRequestHandlerFactory
MAX_RETRY_COUNT_PER_SESSION
+49-170-1234567-8901
usr/local/lib/python3/site-packages/numpy/core
ISBN-978-3-16-148410-0
windows-x86_64-linux-gnu-utf8
internationalization
backup-2024-05-01-full-0007
node12-eu-west-1a-prod-03
SKU-000123-XL-BLUE
""".split()


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(11)
    planted = [(form, n, "".join(r.choice(own) for _ in range(n))) for form, own in FORMS.items() for n in (12, 16, 20, 28, 44) for _ in range(25)]
    lines = [f"see {v} there" for _, _, v in planted] + [f"see {v} there" for v in HARMLESS]
    # The ordinary class learns from whole documents beside the planted lines.
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").unionByName(real)
    return planted, {r["doc_id"]: r for r in secret_scan.digest(table).collect()}


def test_random_strings_are_found(found):
    planted, got = found
    hit = [any(s.startswith("markov") for s in got[i]["spans"].split(",")) or got[i]["n_hex"] > 0 for i in range(len(planted))]
    assert sum(hit) / len(hit) >= 0.9
    # Separators leave a string fewer transitions to judge by, so the form with separators is the weakest.
    for form in FORMS:
        own = [h for h, p in zip(hit, planted, strict=True) if p[0] == form]
        assert sum(own) / len(own) >= (0.8 if form == "url" else 0.9), form
    # The whole string is marked where it has no separator.
    whole = [f"markov:4:{4 + n}" in got[i]["spans"] for i, (form, n, _) in enumerate(planted) if form == "mixed" and hit[i]]
    assert all(whole)


def test_ordinary_strings_are_left_alone(found):
    planted, got = found
    marked = [v for i, v in enumerate(HARMLESS, len(planted)) if got[i]["spans"]]
    assert marked == [] and not any("markov" in r["spans"] for i, r in got.items() if i < 0)


def test_stretches_within_a_run(spark):
    a, b, c = "Zq8Xv3Lm9Tr2Wb7Kc5", "hT5rW9zQ2mKx7Bv4", "deadbeefdeadbeef0123"
    text = f"usr/share/{a}/users/orders/documents/customers/reports/{b}/index {a[:8]}{c}Q{b}"
    plain = [(i, "usr share users orders documents customers reports index") for i in range(2, 12)]
    table = spark.createDataFrame([(1, text), *plain], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in secret_scan.digest(table).collect()}[1]
    at = text.index(c)
    want = [("markov", text.index(a), len(a)), ("markov", text.index(b), len(b)), ("hex", at, len(c)), ("markov", at + len(c), 1 + len(b))]
    assert got == [f"{k}:{s}:{s + n}" for k, s, n in want]
