"""From model output to reviewed edges: candidates, groups, classes, worklist, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.functions.text import parse_json_array
from loomlight.operators.entities import resolve_names
from loomlight.storage import written

RELATION = "struct<subject:string,relation:string,object:string,evidence:string>"
PROMPT_CHARS = 4000

#: Pieces of evidence that a worklist shows and a state keeps unless told otherwise, the first ones seen.
QUOTES = 2

# Titles and wording of a worklist.
TITLE = "# Edges to review"
SECTIONS = {"novel": "Novel (resolved, not in seed)", "needs-node": "Needs node (unresolved name)"}
ARROWS = {"parent": " —parent-of→ ", "spouse": " —spouse-of→ "}
SEEN = "- **%s**  _(seen %d× in %d chunk(s); status: %s)_"
QUOTE = "    - “%s”"


def prompt_text(text: Column) -> Column:
    """What of a passage a model is given."""
    return F.substring(text, 1, PROMPT_CHARS)


def regex_extractor() -> Column:
    """The local default extractor over column `text`: `X, son of Y` and the like, as a JSON array."""
    name = r"([A-Z][\w']*(?: [A-Z][\w']*)*)"
    found = lambda words, group: F.regexp_extract_all(prompt_text(F.col("text")), F.lit(f"{name},? {words} {name}"), F.lit(group))
    rows = lambda words, rel, a, b: F.zip_with(found(words, a), found(words, b), lambda x, y: F.struct(x.alias("subject"), F.lit(rel).alias("relation"), y.alias("object"), F.lit("").alias("evidence")))
    return F.to_json(
        F.concat(
            rows("(?:was |is )?(?:the )?(?:son|daughter|child) of", "parent-of", 2, 1),
            rows("(?:was )?(?:married to|wed|wedded)", "spouse-of", 1, 2),
        )
    )


def first_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """The first `most` chunks, in order of book and place: what a trial run of an extractor reads."""
    return chunks.orderBy("book_id", "chunk_index").limit(most)


def candidates(outputs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row per relation of model outputs (chunk_id, book_id, output) that is a known one.

    Columns: type, raw_subject, raw_object, relation, evidence (300 characters at most), chunk_id,
    book_id, status, seen, and with a name index src, dst and resolved. seen orders the candidates: by
    the outputs' `ordinal`, or chunk_id without it, then by place in the output.
    """
    ordinal = F.col("ordinal" if "ordinal" in outputs.columns else "chunk_id").alias("at")
    each = outputs.select("chunk_id", "book_id", ordinal, F.posexplode(parse_json_array(F.col("output"), RELATION)).alias("place", "r"))
    kind = F.when(F.col("r.relation") == "parent-of", "parent").when(F.col("r.relation") == "spouse-of", "spouse")
    rows = each.select(
        kind.alias("type"),
        F.col("r.subject").alias("raw_subject"),
        F.col("r.object").alias("raw_object"),
        F.col("r.relation").alias("relation"),
        F.substring(F.coalesce("r.evidence", F.lit("")), 1, 300).alias("evidence"),
        "chunk_id",
        "book_id",
        F.lit("pending").alias("status"),
        F.struct("at", "place").alias("seen"),
    ).where("type is not null")
    if index is None:
        return rows
    rows = written(rows)  # read for the names and again for the result
    names = rows.select(F.explode(F.array("raw_subject", "raw_object")).alias("raw")).where("raw is not null").distinct()
    found = written(resolve_names(written(names), index))
    a, b = found.select(F.col("raw").alias("ra"), F.col("id").alias("src")), found.select(F.col("raw").alias("rb"), F.col("id").alias("dst"))
    joined = rows.join(a, F.col("raw_subject") == F.col("ra"), "left").join(b, F.col("raw_object") == F.col("rb"), "left").drop("ra", "rb")
    return joined.withColumn("resolved", F.col("src").isNotNull() & F.col("dst").isNotNull())


def candidate_key() -> Column:
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    known = F.when(F.col("type") == "parent", F.concat_ws("|", "type", a, b)).otherwise(F.concat_ws("|", "type", F.least(a, b), F.greatest(a, b)))
    return F.when(F.col("resolved"), known).otherwise(
        F.concat_ws("|", F.lit("unresolved"), "type", F.coalesce("raw_subject", F.lit("")), F.coalesce("raw_object", F.lit("")))
    )


def _first_quotes(pieces: DataFrame, most: int | None) -> DataFrame:
    """(key, quotes) of pieces (key, evidence, seen): the first different ones, each with where it was first seen; without `most` all of them.

    A rank limit comes before they are put together, so no row holds more than `most` of them.
    """
    each = pieces.where("evidence <> ''").groupBy("key", "evidence").agg(F.min("seen").alias("seen"))
    if most is not None:
        each = each.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("seen", "evidence"))).where(F.col("_r") <= most)
    return each.groupBy(F.col("key").alias("_q")).agg(F.array_sort(F.collect_list(F.struct("seen", "evidence"))).alias("quotes"))


def states(rows: DataFrame, most: int | None = QUOTES) -> DataFrame:
    """Candidates by edge, in a form that merges: key, n, resolved, seen and edge of the first one, quotes, chunk_sketch (HyperLogLog).

    quotes: the first `most` pieces of evidence, or with None every different one.
    """
    keyed = rows.withColumn("key", candidate_key())
    one = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("resolved").alias("resolved"),
        F.min("seen").alias("seen"),
        F.min_by(F.struct("type", "src", "dst", "raw_subject", "raw_object"), "seen").alias("edge"),
        F.hll_sketch_agg(F.col("chunk_id").cast("string")).alias("chunk_sketch"),
    )
    return one.join(_first_quotes(keyed, most), F.col("key") == F.col("_q"), "left").drop("_q")


def merge(some: DataFrame, most: int | None = QUOTES) -> DataFrame:
    """The states of several epochs, united, as if their candidates had come at once. No candidate is read again."""
    one = some.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.bool_or("resolved").alias("resolved"),
        F.min("seen").alias("seen"),
        F.min_by("edge", "seen").alias("edge"),
        F.hll_union_agg("chunk_sketch").alias("chunk_sketch"),
    )
    pieces = some.select("key", F.explode("quotes").alias("q")).select("key", "q.evidence", "q.seen")
    return one.join(_first_quotes(pieces, most), F.col("key") == F.col("_q"), "left").drop("_q")


def grouped_states(some: DataFrame, seed_keys: DataFrame) -> DataFrame:
    """groups() of states; n_chunks is the sketch's estimate."""
    seeds = seed_keys.select(F.col("key").alias("seed")).distinct()
    cls = F.when(~F.col("resolved"), "needs-node").when(F.col("seed").isNotNull(), "confirms-seed").otherwise("novel")
    none = F.expr("cast(array() as array<string>)")
    return some.join(seeds, F.col("key") == F.col("seed"), "left").select(
        "key",
        "n",
        F.hll_sketch_estimate("chunk_sketch").alias("n_chunks"),
        F.coalesce(F.col("quotes.evidence"), none).alias("evidence"),
        "resolved",
        "seen",
        "edge",
        cls.alias("cls"),
    )


def groups(rows: DataFrame, seed_keys: DataFrame, most: int | None = QUOTES) -> DataFrame:
    """Candidates by edge: key, n, n_chunks, evidence (in the order first seen), resolved, seen, edge (the first), cls (confirms-seed, novel, needs-node).

    evidence: the first `most` pieces, enough for a worklist, or with None every different one.
    """
    rows = written(rows)
    exact = rows.select(candidate_key().alias("_k"), "chunk_id").groupBy("_k").agg(F.count_distinct("chunk_id").alias("_n"))
    some = grouped_states(states(rows, most), seed_keys)
    return some.join(exact, F.col("key") == F.col("_k")).withColumn("n_chunks", F.col("_n")).drop("_k", "_n")


def class_counts(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("cls").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("candidates"))


def undecided(grouped: DataFrame, decided: DataFrame) -> DataFrame:
    """Novel edges that no decision (key) names."""
    return grouped.where("cls = 'novel'").join(decided.select("key"), "key", "left_anti")


def decide(grouped: DataFrame, decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Reviewed edges from decisions (key, verdict `a` or `r`; others leave an edge open).

    Their evidence_chunks, in the order first seen, come from the candidates (rows) of decided edges only.
    """
    taken = grouped.join(decisions.where("verdict in ('a', 'r')"), "key")
    some = rows.withColumn("_k", candidate_key()).join(decisions.where("verdict = 'a'").select("key"), F.col("_k") == F.col("key"), "left_semi")
    each = some.groupBy("_k", F.col("chunk_id").cast("string").alias("chunk")).agg(F.min("seen").alias("seen"))
    chunks = each.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("seen", "chunk"))).alias("c"))
    return taken.join(chunks, F.col("key") == F.col("_k"), "left").select(
        "edge.type",
        "edge.src",
        "edge.dst",
        F.when(F.col("verdict") == "a", "extracted:reviewed").alias("source"),
        F.when(F.col("verdict") == "a", "approved").otherwise("rejected").alias("status"),
        F.col("c.chunk").alias("evidence_chunks"),
    )


def worklist(grouped: DataFrame, decided: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(section, place, seen, key, line): Markdown of what is to be reviewed, most frequent first, with the first evidence.

    decided: key, status. names: id, name of known nodes, which stand by their id without it.
    """
    rows = grouped.where("cls <> 'confirms-seed'")
    status = F.lit("pending")
    if decided is not None:
        rows = rows.join(decided.select(F.col("key").alias("_k"), F.col("status").alias("_s")), F.col("key") == F.col("_k"), "left")
        status = F.coalesce("_s", F.lit("pending"))
    for side in ("src", "dst"):
        rows = rows.withColumn(f"_{side}", F.col(f"edge.{side}").cast("string"))
        if names is not None:
            known = names.select(F.col("id").cast("string").alias("_id"), F.col("name").alias("_name"))
            rows = rows.join(known, F.col(f"_{side}") == F.col("_id"), "left").withColumn(f"_{side}", F.coalesce("_name", f"_{side}")).drop("_id", "_name")
    name = lambda side, raw: F.coalesce(F.when(F.col("resolved"), F.col(f"_{side}")), F.col(f"edge.{raw}"), F.lit(""))
    arrow = F.when(F.col("edge.type") == "parent", ARROWS["parent"]).otherwise(ARROWS["spouse"])
    edge = F.concat(name("src", "raw_subject"), arrow, name("dst", "raw_object"))
    head = F.format_string(SEEN, edge, F.col("n"), F.col("n_chunks"), status)
    quotes = F.transform(F.slice("evidence", 1, QUOTES), lambda e: F.format_string(QUOTE, e))
    return rows.select(
        F.col("cls").alias("section"),
        (-F.col("n")).alias("place"),
        "seen",
        "key",
        F.array_join(F.concat(F.array(head), quotes), "\n").alias("line"),
    ).orderBy("section", "place", "seen", "key")


def worklist_text(lines: DataFrame) -> DataFrame:
    """(line) of worklist(): the title, and each section under a heading with its number of edges, in order; sections without edges too."""
    spark, order = lines.sparkSession, list(SECTIONS)
    titles = spark.createDataFrame([(i, s, SECTIONS[s]) for i, s in enumerate(order)], "_o int, _s string, title string")
    some = lines.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    heads = titles.join(some, F.col("_s") == F.col("section"), "left").select(
        "_o", F.lit(None).cast("long").alias("place"), F.format_string("\n## %s — %d\n", "title", F.coalesce("n", F.lit(0))).alias("line")
    )
    top = spark.createDataFrame([(-1, None, f"{TITLE}\n")], "_o int, place long, line string")
    body = lines.join(titles, F.col("section") == F.col("_s")).select("_o", F.col("place").cast("long").alias("place"), "seen", "key", "line")
    every = top.unionByName(heads).unionByName(body, allowMissingColumns=True)
    return every.orderBy("_o", F.col("place").asc_nulls_first(), "seen", "key").select("line")
