"""The kinship graph: compile, validate, traverse.

Nodes: id, name, house, gender, aliases, node_ord. Edges: type, src, dst, source, status, edge_ord;
`parent` runs from parent to child, `spouse` has no direction. Results that a limit may cut carry
`path`, an array of edge ordinals: its order is the order of a guarded depth-first walk.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.functions.relations import LABELS, label
from loomlight.functions.text import normalize_name, sql_quote
from loomlight.storage import remove, scratch, shuffled, written


def edge_key() -> Column:
    """Identity of an edge; the ends of a spouse edge in either order."""
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    return F.when(F.col("type") == "parent", F.concat_ws("|", "type", a, b)).when(
        F.col("type") == "spouse", F.concat_ws("|", "type", F.least(a, b), F.greatest(a, b))
    ).otherwise(F.concat_ws("|", "type", F.to_json(F.struct("src", "dst"))))


@dataclass
class Graph:
    """A compiled graph: unique nodes and edges, and what was added from review."""

    nodes: DataFrame
    edges: DataFrame
    added: DataFrame | None = None

    @cached_property
    def links(self) -> DataFrame:
        """(kind, id, other, ord): kind `parent`, `child` or `spouse` of id is other. Self edges stay out; repeats keep the first place."""
        own = self.edges.where("src <> dst")
        parent, spouse = own.where("type = 'parent'"), own.where("type = 'spouse'")
        row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("id"), F.col(b).alias("other"), F.col("edge_ord").alias("ord"))
        every = row(parent, "parent", "dst", "src").unionByName(row(parent, "child", "src", "dst")).unionByName(
            row(spouse, "spouse", "src", "dst")
        ).unionByName(row(spouse, "spouse", "dst", "src"))
        return every.groupBy("kind", "id", "other").agg(F.min("ord").alias("ord"))

    def settled(self) -> Graph:
        """The same graph with its links written, in folders by kind, for plans that read them several times."""
        out = Graph(self.nodes, self.edges, self.added)
        out.__dict__["links"] = written(self.links, by="kind")
        return out

    def step(self, kind: str) -> DataFrame:
        return self.links.where(F.col("kind") == kind).select("id", "other", F.array("ord").alias("path"))


def compile_graph(nodes: DataFrame, seed: DataFrame, reviewed: DataFrame | None = None) -> Graph:
    """Of repeated node ids the last values win at the first place; of repeated edges the first wins.

    Reviewed edges only add: those whose status is absent or `approved`, whose ends are known, and
    whose key is new.
    """
    last = W.partitionBy("id").orderBy(F.desc("node_ord"))
    unique = nodes.withColumn("_n", F.row_number().over(last)).withColumn(
        "_first", F.min("node_ord").over(W.partitionBy("id"))
    ).where("_n = 1").withColumn("node_ord", F.col("_first")).drop("_n", "_first")
    keyed = seed.withColumn("key", edge_key()).withColumn("rank", F.lit(0))
    if reviewed is not None:
        good = approved(reviewed)
        known = unique.select(F.col("id").alias("_id"))
        good = good.join(known, good["src"] == known["_id"], "left_semi").join(known, F.col("dst") == F.col("_id"), "left_semi")
        keyed = keyed.unionByName(good.withColumn("key", edge_key()).withColumn("rank", F.lit(1)))
    first = W.partitionBy("key").orderBy("rank", "edge_ord")
    kept = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return Graph(unique, kept.drop("rank"), kept.where("rank = 1").drop("rank"))


def approved(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(F.coalesce(F.nullif("status", F.lit("")), F.lit("approved")) == "approved")


def counts(g: Graph) -> DataFrame:
    """nodes, parent_edges, spouse_edges, added_from_review."""
    e = g.edges.agg(F.count_if(F.col("type") == "parent").alias("parent_edges"), F.count_if(F.col("type") == "spouse").alias("spouse_edges"))
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    a = g.added.agg(F.count(F.lit(1)).alias("added_from_review")) if g.added is not None else n.select(F.lit(0).cast("long").alias("added_from_review"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(n).join(one(e), "_k").join(one(a), "_k").drop("_k")


def warnings(nodes: DataFrame, seed: DataFrame, reviewed: DataFrame | None = None, g: Graph | None = None) -> DataFrame:
    """(kind, key): repeated nodes and edges, reviewed edges to unknown nodes, self edges, unknown types, more than two parents, cycles."""
    g = g or compile_graph(nodes, seed, reviewed)
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    repeated = lambda df, key: df.groupBy(key.alias("k")).count().where("count > 1")
    out = row(repeated(nodes, F.col("id")), "duplicate-node", F.col("k")).unionByName(row(repeated(seed, edge_key()), "duplicate-edge", F.col("k")))
    if reviewed is not None:
        known = nodes.select(F.col("id").alias("_id")).distinct()
        loose = approved(reviewed)
        gone = loose.join(known, F.col("src") == F.col("_id"), "left_anti").unionByName(loose.join(known, F.col("dst") == F.col("_id"), "left_anti")).distinct()
        out = out.unionByName(row(gone, "unknown-node", edge_key()))
    out = out.unionByName(row(g.edges.where("src = dst"), "self-edge", edge_key())).unionByName(
        row(g.edges.where("type not in ('parent', 'spouse')"), "unknown-type", edge_key())
    )
    many = g.links.where("kind = 'parent'").groupBy("id").count().where("count > 2")
    out = out.unionByName(row(many, "more-than-two-parents", F.col("id")))
    rings = strongly_connected(g.links.where("kind = 'parent'").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    return out.unionByName(row(rings.where("size > 1"), "ancestor-cycle", F.col("id")))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(id, component, size) of every node of edges (src, dst) that lies on a cycle of two nodes or more: the least id of its component.

    Nodes without an edge in or out are trimmed again and again. In what is left every node takes the
    largest id that reaches it; a node that keeps its own is the root of a component, which is
    whatever of its colour reaches it. These leave and the rest goes on. No closure is built; each round is one
    written table. Self edges count for nothing.
    """
    spark = edges.sparkSession
    left = written(edges.where("src <> dst").select("src", "dst").distinct())
    kind, found = left.schema["src"].dataType.simpleString(), []
    while not (left := _trimmed(left)).isEmpty():
        ends = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
        colour = _spread(ends.select("id", F.col("id").alias("colour")), left)
        inner = left.join(_as(colour, "s"), F.col("src") == F.col("s_id")).join(_as(colour, "d"), F.col("dst") == F.col("d_id"))
        inner = written(inner.where("s_colour = d_colour").select("src", "dst"))
        mine = colour.where("id = colour")
        own = fresh = mine
        while not fresh.isEmpty():  # against the edges, within the colour
            back = inner.join(_as(fresh, "f"), F.col("dst") == F.col("f_id")).select(F.col("src").alias("id"), F.col("f_colour").alias("colour")).distinct()
            fresh = written(back.join(own.select("id"), "id", "left_anti"))
            own = own.unionByName(fresh)
        own = written(own)
        found.append(own)
        gone = own.select("id")
        left = written(left.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti"))
    every = spark.createDataFrame([], f"id {kind}, colour {kind}")
    for one in found:
        every = every.unionByName(one)
    sizes = every.groupBy("colour").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return every.join(sizes.where("size > 1"), "colour").select("id", "component", "size")


def _as(colour: DataFrame, name: str) -> DataFrame:
    return colour.select(F.col("id").alias(f"{name}_id"), F.col("colour").alias(f"{name}_colour"))


def _trimmed(left: DataFrame) -> DataFrame:
    """The edges on cycles or between them: those whose ends have edges both in and out, to the fixpoint."""
    n = left.count()
    while n:
        inward, outward = left.select(F.col("dst").alias("i")).distinct(), left.select(F.col("src").alias("o")).distinct()
        less = written(left.join(inward, F.col("src") == F.col("i"), "left_semi").join(outward, F.col("dst") == F.col("o"), "left_semi"))
        if (m := less.count()) == n:
            break
        left, n = less, m
    return left


def _spread(colour: DataFrame, left: DataFrame) -> DataFrame:
    """Along the edges the largest colour wins, to the fixpoint; only what has changed goes on."""
    now = fresh = written(colour)
    while not fresh.isEmpty():
        new = left.join(_as(fresh, "f"), F.col("src") == F.col("f_id")).groupBy("dst").agg(F.max("f_colour").alias("new"))
        now = written(now.join(new, F.col("id") == F.col("dst"), "left").select("id", F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("moved")))
        fresh, now = now.where("moved").select("id", "colour"), now.select("id", "colour")
    return now


def closure(g: Graph, kind: str) -> DataFrame:
    """All (id, other) that repeated steps reach, by a semi-naive loop to the fixpoint: each round joins only the new pairs. Cycles end it too."""
    return reach(written(g.links.where(F.col("kind") == kind).select("id", "other")))


def reach(step: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The same of written steps (id, other), each once; only from `starts` (id), if given."""
    seen = fresh = step if starts is None else written(_from(step, starts))
    ahead = step.select(F.col("id").alias("m"), F.col("other").alias("next"))
    while not fresh.isEmpty():
        found = fresh.join(shuffled(ahead), F.col("other") == F.col("m")).select("id", F.col("next").alias("other")).distinct()
        fresh = written(found.join(shuffled(seen), ["id", "other"], "left_anti"))
        seen = seen.unionByName(fresh)
    return seen


def ordered_closure(g: Graph, kind: str, starts: DataFrame | None = None) -> DataFrame:
    """(id, other, path) with each pair's least path, so that ordering by path gives the depth-first order.

    Only from `starts` (id), if given. Relaxes until nothing improves; each round is one written table.
    """
    step = g.step(kind).select("id", "other", F.element_at("path", 1).alias("ord"))
    step = written(step)
    first = _from(step, starts)
    ahead = step.select(F.col("id").alias("m"), F.col("other").alias("next"), "ord")
    path = scratch(step.sparkSession)
    now = written(first.select("id", "other", F.array("ord").alias("path"), F.array("other").alias("via"), F.lit(True).alias("fresh")), path)
    while not (fresh := now.where("fresh")).isEmpty():
        found = fresh.join(shuffled(ahead), F.col("other") == F.col("m")).where(~F.array_contains("via", F.col("next")))
        found = found.select(
            "id",
            F.col("next").alias("other"),
            F.array_append("path", F.col("ord")).alias("path"),
            F.array_append("via", F.col("next")).alias("via"),
            "fresh",
        )
        both = now.withColumn("fresh", F.lit(False)).unionByName(found)
        before, path = path, scratch(step.sparkSession)
        now = written(both.groupBy("id", "other").agg(F.min(F.struct("path", "via", "fresh")).alias("x")).select("id", "other", "x.*"), path)
        remove(step.sparkSession, before)
    return now.select("id", "other", "path")


def _from(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    return rows if starts is None else rows.join(shuffled(starts.select("id").distinct()), "id", "left_semi")


def two_steps(g: Graph, first: str, second: str, starts: DataFrame | None = None) -> DataFrame:
    """(id, other, path) over two steps, each pair at its first place; a way back to oneself is left out for siblings only."""
    a, b = _from(g.step(first), starts), g.step(second)
    b = b.select(F.col("id").alias("m"), F.col("other").alias("o"), F.col("path").alias("p"))
    return a.join(shuffled(b), F.col("other") == F.col("m")).groupBy("id", F.col("o").alias("other")).agg(F.min(F.concat("path", "p")).alias("path"))


def relatives(g: Graph, rel: str, starts: DataFrame | None = None) -> DataFrame:
    """(id, other, path) for one of the eight relations, of all nodes or of `starts` (id)."""
    if rel in ("parent", "child", "spouse"):
        return _from(g.step(rel), starts)
    if rel == "sibling":
        return two_steps(g, "parent", "child", starts).where("id <> other")
    if rel in ("grandparent", "grandchild"):
        return two_steps(g, *(["parent"] * 2 if rel == "grandparent" else ["child"] * 2), starts)
    return ordered_closure(g, "parent" if rel == "ancestor" else "child", starts)


def facts(g: Graph, relations: list[str] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """subject_id, subject, rel, gender (of the object), relation (label), object_id, object, path. Dangling ends keep their id as name.

    With `asked` (rel, id) only of these subjects: walks start from them.
    """
    every = None
    for rel in relations or list(LABELS):
        starts = None if asked is None else asked.where(F.col("rel") == rel).select("id")
        one = relatives(g, rel, starts).select(F.lit(rel).alias("rel"), "id", "other", "path")
        every = one if every is None else every.unionByName(one)
    return named(g, every)


def fact_objects(g: Graph) -> DataFrame:
    """(rel, relation, object_id, n): how many facts() have an object, without the facts' order.

    No paths are kept, what two relations say of the same pairs is worked out once, and objects are counted before
    they are named.
    """
    step = lambda kind: g.step(kind).select("id", "other")
    up = step("parent").select(F.col("id").alias("below"), F.col("other").alias("id"))
    two = lambda kind: up.join(shuffled(step(kind)), "id").select(F.col("below").alias("id"), "other").distinct()
    grand, above = written(two("parent")), written(closure(g, "parent"))
    spouse, sibling = step("spouse"), two("child").where("id <> other")
    pairs = [
        ("parent", step("parent"), "other"), ("child", step("parent"), "id"), ("spouse", spouse, "other"), ("sibling", sibling, "other"),
        ("grandparent", grand, "other"), ("grandchild", grand, "id"), ("ancestor", above, "other"), ("descendant", above, "id"),
    ]
    every = None
    for rel, rows, one in pairs:
        counted = rows.groupBy(F.col(one).alias("object_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rel).alias("rel"), "object_id", "n")
        every = counted if every is None else every.unionByName(counted)
    o = g.nodes.select(F.col("id").alias("oid"), F.nullif("gender", F.lit("")).alias("gender"))
    joined = every.join(shuffled(o), F.col("object_id") == F.col("oid"), "left")
    return joined.select("rel", label(F.col("rel"), F.col("gender")).alias("relation"), "object_id", "n")


def named(g: Graph, every: DataFrame) -> DataFrame:
    """facts() of (rel, id, other, path)."""
    n = g.nodes.select("id", "name", "gender")
    s = n.select(F.col("id").alias("sid"), F.col("name").alias("sname"))
    o = n.select(F.col("id").alias("oid"), F.col("name").alias("oname"), F.nullif("gender", F.lit("")).alias("gender"))
    joined = every.join(shuffled(s), F.col("id") == F.col("sid"), "left").join(shuffled(o), F.col("other") == F.col("oid"), "left")
    return joined.select(
        F.col("id").alias("subject_id"),
        F.coalesce("sname", F.col("id").cast("string")).alias("subject"),
        "rel",
        "gender",
        label(F.col("rel"), F.col("gender")).alias("relation"),
        F.col("other").alias("object_id"),
        F.coalesce("oname", F.col("other").cast("string")).alias("object"),
        "path",
    )


_PARENT, _CHILD = ("e.dst", "e.src"), ("e.src", "e.dst")

# Semi-naive: each turn joins the pairs of the turn before with one step, and keeps those not known yet. Cycles end it.
_REACH = """BEGIN
  DECLARE turn INT DEFAULT 0;
  DECLARE fresh BIGINT DEFAULT 0;
  CREATE TABLE {reach} (id {kind}, other {kind}, since INT) USING parquet PARTITIONED BY (since) LOCATION '{path}';
  INSERT INTO {reach} SELECT DISTINCT p.id, p.other, 0 FROM {step} p JOIN {starts} s ON s.id = p.id;
  SET fresh = (SELECT count(*) FROM {reach} r WHERE r.since = turn);
  WHILE fresh > 0 DO
    INSERT INTO {reach} SELECT DISTINCT r.id, p.other, turn + 1 FROM {reach} r JOIN {step} p ON p.id = r.other
      LEFT ANTI JOIN {reach} k ON k.id = r.id AND k.other = p.other WHERE r.since = turn;
    SET turn = turn + 1;
    SET fresh = (SELECT count(*) FROM {reach} r WHERE r.since = turn);
  END WHILE;
END"""


def sql_closure(step: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, other) that repeated steps (id, other) reach from starts (id), by a Spark SQL script over tables."""
    spark, path, name = step.sparkSession, scratch(step.sparkSession), uuid.uuid4().hex[:12]
    step, reach = written(step), f"reach_{name}"
    step.createOrReplaceTempView(f"step_{name}")
    starts.createOrReplaceTempView(f"starts_{name}")
    kind = step.schema["id"].dataType.simpleString()
    try:
        spark.sql(_REACH.format(reach=reach, step=f"step_{name}", starts=f"starts_{name}", kind=kind, path=path))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {reach}")  # its files stay
        spark.catalog.dropTempView(f"step_{name}")
        spark.catalog.dropTempView(f"starts_{name}")
    return spark.read.schema(f"id {kind}, other {kind}, since int").parquet(path).select("id", "other")


def sql_relatives(g: Graph, rel: str, starts: DataFrame) -> DataFrame:
    """(id, other) for one relation of `starts` (id), as Spark SQL over nodes and edges alone; ends without a node vanish."""
    spark, starts = g.nodes.sparkSession, written(starts.select("id").distinct())
    one = lambda here, there, kind: f"""SELECT {here} AS id, {there} AS other FROM {{edges}} e JOIN {{starts}} s ON s.id = {here}
        WHERE e.type = '{kind}'"""  # noqa: E731
    two = lambda a, b: f"""SELECT {a[0].replace('e.', 'x.')} AS id, {b[1].replace('e.', 'y.')} AS other FROM {{edges}} x
        JOIN {{starts}} s ON s.id = {a[0].replace('e.', 'x.')} JOIN {{edges}} y ON {b[0].replace('e.', 'y.')} = {a[1].replace('e.', 'x.')}
        WHERE x.type = 'parent' AND y.type = 'parent'"""  # noqa: E731
    if rel in ("ancestor", "descendant"):
        here, there = _PARENT if rel == "ancestor" else _CHILD
        step = spark.sql(f"SELECT DISTINCT {here} AS id, {there} AS other FROM {{edges}} e WHERE e.type = 'parent' AND e.src <> e.dst", edges=g.edges)
        rows = sql_closure(step, starts)
    else:
        body = {
            "parent": one(*_PARENT, "parent"),
            "child": one(*_CHILD, "parent"),
            "spouse": f"{one(*_PARENT, 'spouse')} UNION ALL {one(*_CHILD, 'spouse')}",
            "sibling": two(_PARENT, _CHILD) + " AND x.dst <> y.dst",
            "grandparent": two(_PARENT, _PARENT),
            "grandchild": two(_CHILD, _CHILD),
        }[rel]
        rows = spark.sql(body, edges=g.edges, starts=starts)
    return rows.join(g.nodes.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other").distinct()


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, id, n_aliases): normalised names and aliases, each once for a node; empty keys drop."""
    keys = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))))
    return nodes.select(
        "id", F.size(F.coalesce("aliases", F.expr("cast(array() as array<string>)"))).alias("n_aliases"), keys.alias("k")
    ).select(normalize_name(F.col("k")).alias("key"), "id", "n_aliases").where("key <> ''").distinct()


def load_script(g: Graph) -> DataFrame:
    """(part, ord, line): a SQL script that empties both tables and inserts every node and edge again."""
    text = lambda c: sql_quote(F.col(c).cast("string"))
    nodes = g.nodes.select(
        F.lit(1).alias("part"),
        F.col("node_ord").alias("ord"),
        F.concat(
            F.lit("INSERT INTO nodes (id, name, house, gender) VALUES ("),
            F.concat_ws(", ", text("id"), text("name"), text("house"), text("gender")),
            F.lit(");"),
        ).alias("line"),
    )
    edges = g.edges.select(
        F.lit(2).alias("part"),
        F.col("edge_ord").alias("ord"),
        F.concat(
            F.lit("INSERT INTO edges (type, src, dst, source) VALUES ("),
            F.concat_ws(", ", text("type"), text("src"), text("dst"), sql_quote(F.coalesce(F.nullif("source", F.lit("")), F.lit("seed")))),
            F.lit(");"),
        ).alias("line"),
    )
    spark = g.nodes.sparkSession
    head = spark.createDataFrame([(0, 0, "DELETE FROM edges;"), (0, 1, "DELETE FROM nodes;")], "part int, ord long, line string")
    return head.unionByName(nodes.withColumn("ord", F.col("ord").cast("long"))).unionByName(edges.withColumn("ord", F.col("ord").cast("long")))
