"""The closure of a relation as a written table that new links extend, without working it out again.

Pairs (id, other) say that steps lead from id to other. Each change is an epoch: its new pairs alone, written
twice, in folders by a hash bucket of `id` and by one of `other`, so both ends can be looked up by reading
few folders. Links are only added, as in an add-only merge; so epochs never share a pair, and a reader
takes them as they are. The state is the latest manifest, created once and never changed: a writer that
finds its number taken has lost, and what it wrote is not seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.operators.graph import Graph, closure, reach
from loomlight.sources.log_table import Conflict
from loomlight.storage import freeing, get_text, names_in, put_new, shuffled, written


@dataclass
class ClosureStore:
    """The store at `path`; ids of type `kind`."""

    spark: SparkSession
    path: str
    kind: str = "long"
    buckets: int = 16

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        """Takes over what others have committed."""
        names = [n for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit()]
        self.state = json.loads(get_text(self.spark, f"{self.path}/manifest/{max(names)}")) if names else None
        if self.state:
            self.kind, self.buckets = self.state["kind"], self.state["buckets"]

    @property
    def epochs(self) -> list[str]:
        return self.state["epochs"] if self.state else []

    def _read(self, side: str, near: DataFrame | None = None) -> DataFrame:
        """(id, other, since), with `near` (one column) only the buckets of the `side` column that its values fall in."""
        schema = f"id {self.kind}, other {self.kind}, _bucket int"
        at = None
        if near is not None:
            at = [r[0] for r in near.select(self._bucket(near.columns[0])).distinct().collect()]  # at most `buckets` numbers
        out = None
        for since, name in enumerate(self.epochs):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{side}")
            rows = rows if at is None else rows.where(F.col("_bucket").isin(at))
            one = rows.select("id", "other", F.lit(since).alias("since"))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], f"id {self.kind}, other {self.kind}, since int") if out is None else out

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(F.col(column).cast(self.kind)), F.lit(self.buckets)).cast("int")

    def pairs(self) -> DataFrame:
        """(id, other, since): every pair and the number of the epoch that it came with."""
        return self._read("id")

    def reached_from(self, ids: DataFrame) -> DataFrame:
        """(id, other) from ids (id)."""
        return self._read("id", ids.select("id")).join(shuffled(ids.select("id").distinct()), "id", "left_semi").select("id", "other")

    def reaching(self, others: DataFrame) -> DataFrame:
        """(id, other) to others (other)."""
        near = others.select("other")
        return self._read("other", near).join(shuffled(near.distinct()), "other", "left_semi").select("id", "other")

    def create(self, g: Graph, kind: str) -> DataFrame:
        """The first epoch: the closure of one kind of a graph's links."""
        if self.state:
            raise Conflict(f"{self.path} exists")
        return self._commit(closure(g, kind))

    def extend(self, added: DataFrame) -> DataFrame:
        """The pairs that added links (id, other) bring, committed as an epoch; nothing is committed if there are none.

        A link that a known pair implies adds nothing. Ends of new links that reach one another lead to the same and
        are reached from the same, so one of them stands for all. Between those that stand, a step is a new link,
        what was known to lead to one or what was known to lie behind one; what such steps reach, each turn joining
        the pairs of the turn before only, is then spelt out for all, less what is known. So each pair is made once.
        Self links, nulls and repeated links count for nothing.
        """
        links = added.select(F.col("id").cast(self.kind), F.col("other").cast(self.kind)).where("id <> other").distinct()
        links = written(links)
        links = written(links.join(shuffled(self.reached_from(links)), ["id", "other"], "left_anti"))
        if links.isEmpty():
            return links
        alike = self._alike(links)
        before = self.reaching(links.select(F.col("id").alias("other")))
        behind = self.reached_from(links.select(F.col("other").alias("id")))
        starts = _standing(links.select("id").unionByName(before.select("id")).distinct(), alike, "id").distinct()
        steps = _between(links.unionByName(before).unionByName(behind), alike)
        pairs = reach(steps, written(starts)).unionByName(alike.select(F.col("one").alias("id"), F.col("one").alias("other"))).distinct()
        return self._commit(self._unknown(_spelt(_spelt(pairs, alike, "id"), alike, "other")))

    def _alike(self, links: DataFrame) -> DataFrame:
        """(id, one): ends of links that reach one another, by known pairs or by the links, with the one that stands for them."""
        ends = written(links.select("id").unionByName(links.select(F.col("other").alias("id"))).distinct())
        known = self.reached_from(ends).join(shuffled(ends.select(F.col("id").alias("other"))), "other", "left_semi")
        old = written(_mutual(written(known.select("id", "other"))))
        new = written(_mutual(reach(_between(links, old))))
        every = _standing(_standing(ends.withColumn("one", F.col("id")), old, "one"), new, "one")
        many = every.groupBy("one").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one")
        return written(every.join(shuffled(many), "one", "left_semi").select("id", "one"))

    def _unknown(self, found: DataFrame) -> DataFrame:
        found = written(found)
        return written(found.join(shuffled(self.reached_from(found)), ["id", "other"], "left_anti"))

    def _commit(self, pairs: DataFrame) -> DataFrame:
        name, epochs = f"epoch-{uuid.uuid4().hex[:12]}", self.epochs
        for side in ("id", "other"):
            # few files a folder; a bucket that one id fills is split
            rows = pairs.select("id", "other", self._bucket(side).alias("_bucket")).hint("rebalance", "_bucket")
            with freeing(self.spark):
                rows.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{name}/{side}")
        state = {"kind": self.kind, "buckets": self.buckets, "epochs": [*epochs, name]}
        if not put_new(self.spark, f"{self.path}/manifest/{len(epochs):012d}.json", json.dumps(state)):
            raise Conflict(f"epoch {len(epochs)} is there already")
        self.state = state
        return self.spark.read.schema(f"id {self.kind}, other {self.kind}").parquet(f"{self.path}/{name}/id").select("id", "other")


def _mutual(pairs: DataFrame) -> DataFrame:
    """(id, one) of ids whose pairs (id, other) also run back: the least of all that do."""
    back = shuffled(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    found = pairs.join(back, ["id", "other"]).groupBy("id").agg(F.min("other").alias("least"))
    return found.select("id", F.least("id", "least").alias("one"))


def _standing(rows: DataFrame, alike: DataFrame, column: str) -> DataFrame:
    """rows with what stands for the values of a column in their place."""
    a = shuffled(alike.select(F.col("id").alias("_id"), F.col("one").alias("_one")))
    return rows.join(a, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_one", column)).drop("_id", "_one")


def _between(pairs: DataFrame, alike: DataFrame) -> DataFrame:
    """The steps (id, other) between those that stand, written, each once."""
    rows = _standing(_standing(pairs, alike, "id"), alike, "other")
    return written(rows.where("id <> other").select("id", "other").distinct())


def _spelt(pairs: DataFrame, alike: DataFrame, column: str) -> DataFrame:
    """pairs for all that the values of a column stand for."""
    a = shuffled(alike.select(F.col("one").alias("_one"), F.col("id").alias("_id")))
    return pairs.join(a, F.col(column) == F.col("_one"), "left").withColumn(column, F.coalesce("_id", column)).select("id", "other")
