"""Deterministic answers: sentences from facts, one citation a fact, precedence of graph, passage, refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions.relations import plural
from loomlight.functions.text import list_join
from loomlight.storage import shuffled

# The sentences of answers, and the providers.
REFUSAL = "The sources provided do not cover that. (stub)"
NOTE = " (Note: the name matched more than one person in the genealogy; results are shown for each.)"
GRAPH_WORK = "Genealogy graph"
PROVIDERS = {"gemini": "gemini-3-flash", "groq": "llama-3.3-70b", "cerebras": "llama-3.3-70b", "ollama": "gemma2:2b"}
META_TAIL = " · phase 2 — retrieval + genealogy graph live, generation stubbed (LLM in phase 3)"


def provider(name: str | None) -> str:
    return name if name in PROVIDERS else "gemini"


def meta(name: str | None, sources: Column) -> Column:
    """The provider and the sources as they were asked for."""
    own = provider(name)
    return F.concat(
        F.lit(f"provider={own} ({PROVIDERS[own]}) · sources=["),
        F.array_join(F.coalesce(sources, F.expr("cast(array() as array<string>)")), ", "),
        F.lit("]" + META_TAIL),
    )


def compose(facts: DataFrame) -> DataFrame:
    """(qid, answer, citations) from facts (qid, place, subject, rel, relation, object, ambiguous).

    One clause a subject, in order of its first fact: one label gives the gendered noun, several give
    the relation's plural with the label after each name.
    """
    clause = facts.groupBy("qid", "subject").agg(
        F.min("place").alias("first"),
        F.array_sort(F.collect_list(F.struct("place", "object", "relation"))).alias("f"),
        F.count_distinct("relation").alias("labels"),
        F.first("rel").alias("rel"),
        F.bool_or("ambiguous").alias("ambiguous"),
    )
    n = F.size("f")
    one = F.element_at("f", 1)["relation"]
    noun = F.when(F.col("labels") > 1, plural(F.col("rel"))).when(n > 1, plural(one)).otherwise(one)
    items = F.when(
        F.col("labels") > 1, F.transform("f", lambda x: F.concat(x["object"], F.lit(" ("), x["relation"], F.lit(")")))
    ).otherwise(F.transform("f", lambda x: x["object"]))
    text = F.concat("subject", F.lit("'s "), noun, F.when(n > 1, " were ").otherwise(" was "), list_join(items), F.lit("."))
    cites = F.transform(
        "f",
        lambda x: F.struct(
            x["place"].alias("place"),
            F.lit(GRAPH_WORK).alias("work"),
            F.concat(F.col("subject"), F.lit(" → "), x["relation"], F.lit(" → "), x["object"]).alias("locator"),
        ),
    )
    rows = clause.select("qid", "first", "ambiguous", text.alias("text"), cites.alias("cites"))
    whole = rows.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("first", "text"))).alias("t"),
        F.array_sort(F.flatten(F.collect_list("cites"))).alias("c"),
        F.bool_or("ambiguous").alias("ambiguous"),
    )
    answer = F.concat(F.array_join(F.transform("t", lambda x: x["text"]), " "), F.when(F.col("ambiguous"), NOTE).otherwise(""))
    return whole.select(
        "qid",
        answer.alias("answer"),
        F.transform(
            "c", lambda x: F.struct(x["work"].alias("work"), x["locator"].alias("locator"), F.lit(None).cast("string").alias("url"))
        ).alias("citations"),
    )


def answer(questions: DataFrame, composed: DataFrame, top: DataFrame | None, provider_name: str | None = None, key: str = "qid") -> DataFrame:
    """(qid, answer, citations, meta): facts first, else the top passage, else the refusal. A passage is cited after the facts.

    questions: qid, sources. top: qid, work, locator, url, text of the best passage; None without a vector side.
    Where questions share passages, `key` is the column of both that tells which one is whose.
    """
    joined = questions.select(*dict.fromkeys(("qid", "sources", key))).join(shuffled(composed), "qid", "left")
    if top is None:
        joined = joined.select("*", *(F.lit(None).cast("string").alias(c) for c in ("work", "locator", "url", "text")))
    else:
        joined = joined.join(shuffled(top.select(key, "work", "locator", "url", "text")), key, "left")
    none = F.expr("cast(array() as array<struct<work:string,locator:string,url:string>>)")
    passage = F.when(F.col("work").isNotNull(), F.array(F.struct("work", "locator", "url"))).otherwise(none)
    return joined.select(
        "qid",
        F.coalesce("answer", "text", F.lit(REFUSAL)).alias("answer"),
        F.concat(F.coalesce("citations", none), passage).alias("citations"),
        meta(provider_name, F.col("sources")).alias("meta"),
    )
