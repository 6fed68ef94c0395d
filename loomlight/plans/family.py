"""A kinship graph derived from the customer table, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.operators.graph import Graph
from loomlight.storage import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("house"),
        F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("gender"),
        F.expr("cast(array() as array<string>)").alias("aliases"),
        F.col("c_custkey").alias("node_ord"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parents for every customer from 3 on; parents of one child are spouses."""
    c = table(spark, sf_dir, "customer").where("c_custkey >= 3")
    base = F.expr("c_custkey div 3")
    row = lambda kind, src, dst, ord_: [F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), F.lit("seed").alias("source"), F.lit(None).cast("string").alias("status"), ord_.cast("long").alias("edge_ord")]
    key = F.col("c_custkey")
    parents = c.select(*row("parent", base - 1, key, key * 2)).unionByName(c.select(*row("parent", base, key, key * 2 + 1)))
    pair = c.select(base.alias("b")).distinct()
    return parents.unionByName(pair.select(*row("spouse", F.col("b") - 1, F.col("b"), F.lit(1 << 40) + F.col("b"))))


def family(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


NODES = """nodes AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS house,
    CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM customer)"""
PARENT = """par AS (SELECT c_custkey // 3 - 1 AS src, c_custkey AS dst, 2 * c_custkey AS ord FROM customer WHERE c_custkey >= 3
    UNION ALL SELECT c_custkey // 3, c_custkey, 2 * c_custkey + 1 FROM customer WHERE c_custkey >= 3)"""
SPOUSE = """pair AS (SELECT DISTINCT c_custkey // 3 AS b FROM customer WHERE c_custkey >= 3),
spo AS (SELECT b - 1 AS src, b AS dst, 1099511627776 + b AS ord FROM pair UNION ALL SELECT b, b - 1, 1099511627776 + b FROM pair)"""
BASE = f"{NODES}, {PARENT}, {SPOUSE}"


def walk(up: bool) -> str:
    """Every pair of an ancestor or descendant walk with its least path."""
    here, there = ("dst", "src") if up else ("src", "dst")
    return f"""walk(id, other, path) AS (SELECT {here}, {there}, [ord] FROM par
        UNION ALL SELECT w.id, p.{there}, list_append(w.path, p.ord) FROM walk w JOIN par p ON p.{here} = w.other)"""


RELS = f"""rels AS (
    SELECT 'parent' AS rel, dst AS id, src AS other, [ord] AS path FROM par
    UNION ALL SELECT 'child', src, dst, [ord] FROM par
    UNION ALL SELECT 'spouse', src, dst, [ord] FROM spo
    UNION ALL SELECT 'sibling', a.dst, b.dst, min([a.ord, b.ord]) FROM par a JOIN par b ON a.src = b.src AND a.dst <> b.dst
        GROUP BY a.dst, b.dst
    UNION ALL SELECT 'grandparent', a.dst, b.src, min([a.ord, b.ord]) FROM par a JOIN par b ON a.src = b.dst GROUP BY a.dst, b.src
    UNION ALL SELECT 'grandchild', a.src, b.dst, min([a.ord, b.ord]) FROM par a JOIN par b ON a.dst = b.src GROUP BY a.src, b.dst
    UNION ALL SELECT 'ancestor', id, other, min(path) FROM up GROUP BY id, other
    UNION ALL SELECT 'descendant', id, other, min(path) FROM down GROUP BY id, other),
lab(rel, m, f, a) AS (VALUES ('parent','father','mother','parent'), ('child','son','daughter','child'),
    ('spouse','husband','wife','spouse'),
    ('sibling','brother','sister','sibling'), ('grandparent','grandfather','grandmother','grandparent'),
        ('grandchild','grandson','granddaughter','grandchild'),
    ('ancestor','ancestor','ancestor','ancestor'), ('descendant','descendant','descendant','descendant')),
facts AS (SELECT r.rel, r.id AS subject_id, s.name AS subject, r.other AS object_id, o.name AS object, o.gender, r.path,
    CASE o.gender WHEN 'male' THEN l.m WHEN 'female' THEN l.f ELSE l.a END AS relation
    FROM rels r JOIN lab l ON l.rel = r.rel JOIN nodes s ON s.id = r.id JOIN nodes o ON o.id = r.other)"""
WALKS = walk(True).replace("walk(", "up(").replace("FROM walk w", "FROM up w") + ", " + walk(False).replace("walk(", "down(").replace("FROM walk w", "FROM down w")
FACTS = f"WITH RECURSIVE {BASE}, {WALKS}, {RELS}"

# The words that the eight kinds of questions use, one for each remainder of the customer key.
ASKED = ["father", "mother", "parents", "children", "spouse", "siblings", "grandparents", "ancestors"]
ASKED_REL = [
    ("parent", "male"),
    ("parent", "female"),
    ("parent", None),
    ("child", None),
    ("spouse", None),
    ("sibling", None),
    ("grandparent", None),
    ("ancestor", None),
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for every customer: qid, question, sources (none, a known one, one without a book, null)."""
    k = F.col("c_custkey") % 4
    sources = F.when(k == 0, F.expr("cast(array() as array<string>)")).when(k == 1, F.array(F.lit("fire-and-blood"))).when(k == 2, F.array(F.lit("wiki")))
    words = F.element_at(F.array(*(F.lit(w) for w in ASKED)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("qid"),
        F.concat(F.lit("Who were "), F.col("c_name"), F.lit("'s "), words, F.lit("?")).alias("question"),
        sources.alias("sources"),
    )


ASKED_SQL = ", ".join(f"({i}, '{r}', {repr(g) if g else 'NULL'})" for i, (r, g) in enumerate(ASKED_REL))
QUESTIONS = f"""ask(k, rel, wanted) AS (VALUES {ASKED_SQL}),
q AS (SELECT c.c_custkey AS qid, c.c_name AS name, a.rel, CAST(a.wanted AS VARCHAR) AS wanted, list_extract(['{"','".join(ASKED)}'],
    c.c_custkey % 8 + 1) AS word FROM customer c JOIN ask a ON a.k = c.c_custkey % 8),
hit AS (SELECT q.qid, f.*, row_number() OVER (PARTITION BY q.qid ORDER BY f.path, f.object_id) AS place FROM q
    JOIN facts f ON f.subject_id = q.qid AND f.rel = q.rel AND (q.wanted IS NULL OR f.gender = q.wanted)),
cut AS (SELECT * FROM hit WHERE place <= 12)"""
PLURAL = "CASE x WHEN 'child' THEN 'children' WHEN 'wife' THEN 'wives' WHEN 'grandchild' THEN 'grandchildren' ELSE x || 's' END"
ANSWERS = f"""{FACTS}, {QUESTIONS},
g AS (SELECT qid, any_value(subject) AS subject, any_value(rel) AS rel, count(*) AS n, count(DISTINCT relation) AS labels, arg_min(relation,
    place) AS one,
    list(object ORDER BY place) AS o, list(object || ' (' || relation || ')' ORDER BY place) AS m,
    string_agg(subject || ' → ' || relation || ' → ' || object, '; ' ORDER BY place) AS cites FROM cut GROUP BY qid),
t AS (SELECT *, CASE WHEN labels > 1 THEN m ELSE o END AS items,
    CASE WHEN labels > 1 THEN {PLURAL.replace('CASE x', 'CASE rel').replace('ELSE x', 'ELSE rel')}
        WHEN n > 1 THEN {PLURAL.replace('CASE x', 'CASE one').replace('ELSE x', 'ELSE one')} ELSE one END AS noun FROM g),
said AS (SELECT qid, n, cites, subject || '''s ' || noun || CASE WHEN n > 1 THEN ' were ' ELSE ' was ' END ||
    CASE WHEN n = 1 THEN items[1] WHEN n = 2 THEN items[1] || ' and ' || items[2]
        ELSE array_to_string(items[1 : n - 1], ', ') || ', and ' || items[n] END || '.' AS answer FROM t)"""
