"""Checks of answers against a test set, and their totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.storage import written

# Fixed value: how a refusal reads.
REFUSED = r"(?i)do not cover|cannot|no( relevant)? (information|answer)|not (found|covered)"


def missing(text: Column, wanted: Column) -> Column:
    """The phrases that the text lacks, letter case aside."""
    return F.filter(wanted, lambda w: ~F.contains(F.lower(text), F.lower(w)))


def leaked(text: Column, forbidden: Column) -> Column:
    """The phrases that the text has, letter case aside."""
    return F.filter(forbidden, lambda w: F.contains(F.lower(text), F.lower(w)))


def checks(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, name, pass, detail) of cases (id, expected_facts, required_citation, must_refuse, must_not_reveal) with answers (id, answer, n_citations).

    Only the checks a case asks for; the judge is always skipped (pass is null). A case without an
    answer is checked against an empty one.
    """
    both = cases.join(answers, "id", "left")
    text = F.coalesce("answer", F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    row = lambda name, wanted, ok, detail: F.when(wanted, F.struct(F.lit(name).alias("name"), ok.alias("pass"), detail.alias("detail")))
    every = F.array(
        row("citation-present", F.col("required_citation"), F.coalesce("n_citations", F.lit(0)) > 0, none),
        row(
            "expected-facts-present",
            F.coalesce(F.size("expected_facts"), F.lit(0)) > 0,
            F.size(missing(text, F.col("expected_facts"))) == 0,
            missing(text, F.col("expected_facts")),
        ),
        row("refuses-out-of-corpus", F.col("must_refuse"), text.rlike(REFUSED), none),
        row(
            "spoiler-ceiling-respected",
            F.col("must_not_reveal").isNotNull(),
            F.size(leaked(text, F.col("must_not_reveal"))) == 0,
            leaked(text, F.col("must_not_reveal")),
        ),
        row("llm-judge-correctness", F.lit(True), F.lit(None).cast("boolean"), none),
    )
    return both.select("id", F.explode(F.filter(every, lambda c: c.isNotNull())).alias("c")).select("id", "c.*")


def totals(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if(F.col("pass")).alias("passed"),
        F.count_if(~F.col("pass")).alias("failed"),
        F.count_if(F.col("pass").isNull()).alias("skipped"),
    )


def run(cases: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The checks and their totals for a test set (id, question, sources and what is expected).

    `answer` takes questions (qid, question, sources) and gives answers (qid, answer, citations), as
    ask() does. A case that gets no answer fails what it asks for.
    """
    numbered = written(cases.withColumn("qid", F.monotonically_increasing_id()))
    said = answer(numbered.select("qid", "question", "sources")).select("qid", "answer", F.size("citations").alias("n_citations"))
    answers = numbered.select("id", "qid").join(said, "qid").drop("qid")
    checked = written(checks(numbered.drop("qid"), answers))
    return checked, totals(checked)
