"""Entities named in questions, and single raw names.

Containment is tested without word boundaries, and without comparing texts with keys: what contains a
key has a window of its length that equals it. So the windows of a text, one set for each length that
keys have, meet the keys in an equi-join, and whatever meets is a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.functions.text import normalize_name
from loomlight.storage import shuffled, written

#: Keys that questions are searched for have so many characters at least.
LEAST = 4


def lengths(texts: DataFrame, column: str, least: int = 1) -> list[int]:
    """The distinct lengths of a column's values from `least` on; as many as the longest value has characters at most."""
    found = texts.select(F.length(column).alias("n")).where(F.col("n") >= least).distinct().collect()
    return sorted(r["n"] for r in found)


def windows(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of the given lengths."""
    none = F.expr("cast(array() as array<string>)")

    def of(n: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))
        return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(none)

    return F.flatten(F.transform(F.array(*(F.lit(n) for n in sizes)), of)) if sizes else none


def contained(texts: DataFrame, keys: DataFrame, least: int = LEAST) -> DataFrame:
    """(qid, key) where the normalised text has the key; keys shorter than `least` are passed over."""
    keys = keys.where(F.length("key") >= least).select("key").distinct()
    parts = texts.select("qid", F.explode(windows(F.col("norm"), lengths(keys, "key"))).alias("w"))
    return parts.join(shuffled(keys), F.col("w") == F.col("key")).select("qid", "key").distinct()


def resolve(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, id, key, ambiguous): of the longest keys a question has, the ids with the most aliases; ambiguous if several stay.

    questions: qid, norm. index: key, id, n_aliases. Keys need four characters.
    """
    hits = contained(questions, index.select("key"))
    longest = hits.withColumn("_r", F.rank().over(W.partitionBy("qid").orderBy(F.desc(F.length("key"))))).where("_r = 1")
    ids = longest.join(shuffled(index), "key").groupBy("qid", "id").agg(F.min("key").alias("key"), F.max("n_aliases").alias("n_aliases"))
    top = ids.withColumn("_r", F.rank().over(W.partitionBy("qid").orderBy(F.desc("n_aliases")))).where("_r = 1")
    return top.select("qid", "id", "key", (F.count(F.lit(1)).over(W.partitionBy("qid")) > 1).alias("ambiguous"))


def inside(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(raw, key): for each name (raw, norm) the longest of the keys that contain it, ties by text.

    The windows of keys, of the lengths that names have, are narrowed to names before they are grouped, and
    a window keeps one key on its way: so no list of all keys with a common window arises.
    """
    wanted = names.select("norm").where("norm <> ''").distinct()
    parts = keys.select("key", F.explode(windows(F.col("key"), lengths(wanted, "norm"))).alias("w"))
    best = parts.join(shuffled(wanted), F.col("w") == F.col("norm"), "left_semi").groupBy("w").agg(F.min_by("key", F.struct(-F.length("key"), "key")).alias("key"))
    return names.select("raw", "norm").join(shuffled(best), F.col("norm") == F.col("w")).select("raw", "key")


def resolve_names(names: DataFrame, index: DataFrame, mode: str = "compat") -> DataFrame:
    """(raw, id): a unique exact key, else the longest key of five characters and one id that contains the name or is contained in it.

    Mode `strict` leaves out keys that contain the name. Ties take the first key of the index, by
    text. Names that nothing matches, and empty ones, keep a null id.
    """
    raw = names.select("raw").distinct().withColumn("norm", normalize_name(F.col("raw")))
    unique = index.groupBy("key").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").select("key", "id")
    unique = written(unique)  # read five times below
    exact = raw.join(shuffled(unique), F.col("norm") == F.col("key")).select("raw", "id")
    open_ = written(raw.where("norm <> ''").join(shuffled(exact), "raw", "left_anti"))
    long = unique.where(F.length("key") >= 5)
    forward = contained(open_.select(F.col("raw").alias("qid"), "norm"), long.select("key"), 5).select(F.col("qid").alias("raw"), "key")
    found = forward
    if mode == "compat":
        found = forward.unionByName(inside(open_, long))
    best = found.join(shuffled(long), "key").groupBy("raw").agg(F.min_by("id", F.struct(-F.length("key"), "key")).alias("id"))
    return names.select("raw").distinct().join(shuffled(exact.unionByName(best)), "raw", "left")
