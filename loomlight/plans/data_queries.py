"""Registered queries over texts, vectors, candidates and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import chunks as C
from loomlight.operators import evaluate as E
from loomlight.operators import review as R
from loomlight.operators import text_tables as TT
from loomlight.operators import vectors as V
from loomlight.operators.graph import edge_key, name_index
from loomlight.plans import ask as A
from loomlight.plans import family as K
from loomlight.sources import files
from loomlight.storage import scratch, table, written
from loomlight.streaming.ingest import pending

NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
DOCS = "documents"
#: Which book a vector belongs to, by its label.
BOOKS = ["agot", "acok", "asos", "affc", "fab", "kotsk", "show", "wiki", "blog", "misc"]


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, DOCS).select("doc_id", X.normalize_name(F.col("text")).alias("norm"))


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("bundle|src1[0-4]", "bundle-1-4"), ("src7", "fire-and-blood"), ("src9", "knight-seven-kingdoms")]
    name = F.concat_ws(" ", F.lit("The"), "source", "lang", F.lit("(Final)_Copy.pdf"))
    return table(spark, sf_dir, DOCS).select(name.alias("file")).distinct().select("file", X.source_id(F.col("file"), rules).alias("source_id"))


def sample_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, DOCS).where("text is not null")
    every = None
    for f in (0.0, 0.12, 0.5):
        one = rows.select("doc_id", F.lit(f).alias("fraction"), X.sample_at(F.col("text"), f).alias("sample"))
        every = one if every is None else every.unionByName(one)
    return every


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scans of one page for every 1,000 characters that they claim."""
    pages = F.expr("n_chars div 1000")
    rows = table(spark, sf_dir, DOCS).select("doc_id", X.chars_per_page(F.coalesce("text", F.lit("")), pages).alias("per_page"))
    return rows.select("doc_id", "per_page", X.scan_verdict(F.col("per_page")).alias("verdict"))


def page_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", X.chars_per_page(F.col("html"), F.lit(2)).alias("per_page"))
    return rows.select("page_id", "per_page", X.scan_verdict(F.col("per_page")).alias("verdict"))


def dehyphenate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, DOCS).select("doc_id", F.posexplode(X.paragraphs(F.col("text"), "\\n+")).alias("place", "paragraph"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "paragraph")


def book_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a bundle whose books start at fixed shares of its length."""
    rows = table(spark, sf_dir, DOCS).where("text is not null").select(
        F.col("doc_id").alias("raw_id"), "text", F.posexplode(F.array(*(F.lit(x) for x in (0.0, 0.3, 0.6)))).alias("book_id", "share")
    )
    starts = rows.select("raw_id", "book_id", F.floor(F.length("text") * F.col("share")).alias("start"), "text")
    return C.slices(starts).select("raw_id", F.col("book_id").cast("long").alias("book_id"), "start", F.md5("text").alias("digest"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("book_id"), F.col("source").alias("book"), "text")
    return C.chunk(books, "\\n+")


def _bundled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Eight documents a bundle behind a list of contents, and the catalogue: most begin with a title page, some with a marker, some name their title only."""
    k, i = F.expr("doc_id div 8"), F.col("doc_id").cast("string")
    title = F.concat(F.lit("Volume "), i, F.lit(" of the shelf"))
    head = F.when((F.col("ord") == 0) | (F.col("doc_id") % 3 == 0), F.concat(title, F.lit("\n\nBantam Books\n"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("Here begins volume "), i, F.lit(".\n"))
    ).otherwise(F.concat(F.lit("This is "), title, F.lit(" indeed.\n")))
    rows = table(spark, sf_dir, DOCS).select("doc_id", "text", k.alias("raw_id"), (F.row_number().over(W.partitionBy(k).orderBy("doc_id")) - 1).alias("ord"))
    rows = rows.select("raw_id", "ord", "doc_id", title.alias("title"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    each = rows.groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "text"))).alias("b"))
    contents = F.concat(F.lit("Contents\n"), F.array_join("b.title", "\n"), F.lit("\n"), F.repeat(F.lit("-"), 300), F.lit("\n"))
    catalog = rows.select("raw_id", "ord", F.col("doc_id").alias("book_id"), "title", F.concat(F.lit("here begins volume "), F.col("doc_id").cast("string"), F.lit("\\.")).alias("start_marker"))
    return each.select("raw_id", F.concat(contents, F.array_join("b.text", "")).alias("text")), catalog


def book_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document found again in its bundle, in stretches of 4,000 characters."""
    pieces = TT.split_books(*_bundled(spark, sf_dir), size=4000, context=1000)
    rows = F.array_sort(F.collect_list(F.struct("place", "text")))
    return pieces.groupBy("raw_id", "book_id", "start").agg(F.sha2(F.array_join(rows["text"], ""), 256).alias("digest"))


def chunk_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document by the table function, in stretches of 700 characters."""
    docs = table(spark, sf_dir, DOCS)
    text = TT.stretches(docs.select(F.col("doc_id").alias("raw_id"), "text"), size=700, context=1).select(F.col("raw_id").alias("book_id"), "place", "text")
    return TT.chunk(text.join(docs.select(F.col("doc_id").cast("string").alias("book_id"), F.col("source").alias("book")), "book_id"), "\n+")


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report(chunk_documents(spark, sf_dir))


def stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of fixed length and overlap, over whole texts."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(C.TARGET - C.OVERLAP))
    rows = table(spark, sf_dir, DOCS).where("text is not null").select("doc_id", "text", F.posexplode(starts).alias("i", "at"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.md5(F.substring("text", F.col("at") + 1, F.lit(C.TARGET))).alias("digest"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.element_at(F.array(*(F.lit(b) for b in BOOKS)), F.col("label") + 1)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), book.alias("book_id"))


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("e")).collect()[0]["e"]


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir)).select("id", "score")


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = V.source_filter(["fire-and-blood", "knight", "hotd"])
    return V.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), books=books).select("id", "score", "book_id")


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    rows = V.top_k_batch(own, own.where("id % 20 = 0").select(F.col("id").alias("qid"), "values"))
    return rows.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def _store(spark: SparkSession, sf_dir: str) -> V.TableStore:
    own = _vectors(spark, sf_dir)
    dim = own.agg(F.max(F.size("values")).alias("d")).collect()[0]["d"]
    store = V.TableStore(spark, scratch(spark), dim or 1)
    store.upsert(own)
    return store


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query; those of every third query in two books only."""
    some = F.when(F.col("id") % 3 == 0, F.array(F.lit("fab"), F.lit("agot")))
    return _vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), "values", some.alias("books"))


def vector_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors through the index, exact, with a book filter of each query's own."""
    return _store(spark, sf_dir).nearest(_asked(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def vector_store_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors in a store after upserts, a deletion, a compaction and rows that come back."""
    store, own = _store(spark, sf_dir), _vectors(spark, sf_dir)
    store.upsert(own.where("id % 7 = 0").select("id", F.reverse("values").alias("values"), F.lit("misc").alias("book_id")))
    store.delete(own.where("id % 11 = 0").select("id"))
    store.compact(0.2)
    more = own.where("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), F.transform("values", lambda x: -x).alias("values"), "book_id")
    store.upsert(more.unionByName(own.where("id % 33 = 0")))
    return store.nearest(_asked(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def snippet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = V.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir))
    docs = table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("d"), "text", F.col("source").alias("book"))
    rows = V.snippet(hits.join(docs, F.col("id") == F.col("d"), "left").withColumn("chunk_index", F.col("id")))
    return rows.select("id", "score", "work", "locator", "type", "book_id", "text")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels upserted into documents: their source becomes the label."""
    old = table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("id"), "source")
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("source"))
    return V.upsert(old, new)


def vector_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.parts(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")), "id")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(table(spark, sf_dir, DOCS), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as model output: wrapped in prose and an array, then parsed again."""
    said = F.concat(F.lit("Here: ["), F.col("props"), F.lit("] done"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(X.parse_json_array(said, "struct<k:bigint>")).alias("x"))
    return rows.select("event_id", F.col("x.k").alias("k"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output over line items: parts and suppliers as customers, three kinds of relation, torn for some."""
    kind = F.element_at(F.array(F.lit("parent-of"), F.lit("spouse-of"), F.lit("rival-of")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    name = lambda n: F.concat(F.lit("Customer#"), F.lpad((F.col(n) % 40 + F.when(F.col(n) % 5 == 0, 900_000_000).otherwise(0)).cast("string"), 9, "0"))
    body = F.concat(
        F.lit('Sure: [{"subject":"'),
        name("l_partkey"),
        F.lit('","relation":"'),
        kind,
        F.lit('","object":"'),
        name("l_suppkey"),
        F.lit('","evidence":"'),
        F.concat_ws(" ", F.lit("line"), F.col("l_linenumber").cast("string")),
        F.lit('"}'),
        F.when(F.col("l_orderkey") % 11 == 0, "").otherwise("]"),
    )
    ordinal = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("book_id"), ordinal, body.alias("output"))


_OUT = """l AS (SELECT l_orderkey AS chunk_id, l_orderkey * 8 + l_linenumber AS ord, l_returnflag AS book_id, list_extract(['parent-of', 'spouse-of', 'rival-of'],
    l_linenumber % 3 + 1) AS relation,
    'Customer#' || lpad(CAST(l_partkey % 40 + CASE WHEN l_partkey % 5 = 0 THEN 900000000 ELSE 0 END AS VARCHAR), 9, '0') AS a,
    'Customer#' || lpad(CAST(l_suppkey % 40 + CASE WHEN l_suppkey % 5 = 0 THEN 900000000
        ELSE 0 END AS VARCHAR), 9, '0') AS b, 'line ' || l_linenumber AS evidence
    FROM lineitem WHERE l_orderkey % 11 <> 0),
can AS (SELECT chunk_id, ord, book_id, CASE relation WHEN 'parent-of' THEN 'parent'
    ELSE 'spouse' END AS type, a, b, evidence, x.c_custkey AS src, y.c_custkey AS dst
    FROM l LEFT JOIN customer x ON x.c_name = l.a LEFT JOIN customer y ON y.c_name = l.b WHERE relation <> 'rival-of')"""
_GROUPS = f"""WITH {K.BASE}, {_OUT}, seed AS (SELECT 'parent|' || src || '|' || dst AS key FROM par UNION ALL
    SELECT 'spouse|' || least(CAST(src AS VARCHAR), CAST(dst AS VARCHAR)) || '|' || greatest(CAST(src AS VARCHAR), CAST(dst AS VARCHAR))
    FROM spo),
kd AS (SELECT *, src IS NOT NULL AND dst IS NOT NULL AS ok, CASE
    WHEN src IS NULL OR dst IS NULL THEN 'unresolved|' || type || '|' || a || '|' || b
    WHEN type = 'parent' THEN 'parent|' || src || '|' || dst ELSE 'spouse|' || least(CAST(src AS VARCHAR),
        CAST(dst AS VARCHAR)) || '|' || greatest(CAST(src AS VARCHAR), CAST(dst AS VARCHAR)) END AS key FROM can),
pieces AS (SELECT key AS k, evidence, min(ord) AS o FROM kd GROUP BY key, evidence),
quotes AS (SELECT k, list(evidence ORDER BY o)[1:2] AS ev FROM pieces GROUP BY k),
g AS (SELECT key, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks, any_value(ev) AS ev, CASE
    WHEN NOT bool_or(ok) THEN 'needs-node' WHEN key IN (SELECT key FROM seed) THEN 'confirms-seed' ELSE 'novel' END AS cls
    FROM kd JOIN quotes ON k = key GROUP BY key)"""
#: The same with every different piece of evidence of a group.
_WHOLE_GROUPS = _GROUPS.replace("list(evidence ORDER BY o)[1:2]", "list(evidence ORDER BY o)")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolve through the index of the customers; theirs are unique, and no name here contains another."""
    return R.candidates(_outputs(spark, sf_dir), name_index(K.nodes(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    return rows.groupBy("type", "book_id", "resolved").agg(F.count(F.lit(1)).alias("n"), F.min("raw_subject").alias("least"), F.max("evidence").alias("most"))


def _groups(spark: SparkSession, sf_dir: str, most: int | None = R.QUOTES) -> DataFrame:
    return R.groups(_candidates(spark, sf_dir), K.edges(spark, sf_dir).withColumn("key", edge_key()), most)


def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with all its different pieces of evidence, in the order first seen."""
    return _groups(spark, sf_dir, most=None).select("key", "n", "n_chunks", F.array_join("evidence", "; ").alias("evidence"), "cls")


def review_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_counts(_groups(spark, sf_dir))


def worklist_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent undecided novel edges, with two pieces of evidence."""
    g = _groups(spark, sf_dir)
    decided = g.where("n_chunks % 2 = 0").select("key")
    top = R.undecided(g, decided).orderBy(F.desc("n"), "key").limit(20)
    return top.select("key", "n", F.array_join("evidence", "; ").alias("evidence"))


def review_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups from the states of three epochs of candidates, merged; the estimate of chunks is left out."""
    rows = written(_candidates(spark, sf_dir))
    epochs = [written(R.states(rows.where(F.col("chunk_id") % 3 == i))) for i in range(3)]
    some = R.merge(epochs[0].unionByName(epochs[1]).unionByName(epochs[2]))
    grouped = R.grouped_states(some, K.edges(spark, sf_dir).withColumn("key", edge_key()))
    return grouped.select("key", "n", F.array_join("evidence", "; ").alias("evidence"), "cls")


def reviewed_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on novel edges, written as reviewed edges in two goes to one path and read back."""
    rows = _candidates(spark, sf_dir)
    novel = R.groups(rows, K.edges(spark, sf_dir).withColumn("key", edge_key())).where("cls = 'novel'")
    verdict = F.when(F.col("n") % 2 == 0, "a").when(F.col("n") % 3 == 0, "r").otherwise("s")
    decided = written(R.decide(novel, novel.select("key", verdict.alias("verdict")), rows))
    path = scratch(spark)
    for status in ("approved", "rejected"):
        files.add_reviewed(spark, decided.where(F.col("status") == status), path)
    back = files.read_reviewed(spark, path)
    return back.select(edge_key().alias("key"), "source", "status", F.coalesce(F.size("evidence_chunks"), F.lit(-1)).cast("long").alias("n_chunks"))


def parts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in numbered files of 5,000, written in order and read back."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text"))
    files.write_parts(rows, path, 5000, "k")
    back = files.read_parts(spark, path, "k long, text string")
    return back.groupBy(F.col("part").cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.sum(F.length("text")).alias("chars")
    )


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as cases, documents of the same number as answers."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split(F.lower(F.col("text")), " ")
    first, second = F.element_at(words, 1), F.element_at(words, 2)
    cases = b.select(
        F.col("item_id").alias("id"),
        F.array(first).alias("expected_facts"),
        (F.col("item_id") % 2 == 0).alias("required_citation"),
        (F.col("item_id") % 5 == 0).alias("must_refuse"),
        F.when(F.col("item_id") % 3 == 0, F.array(second)).alias("must_not_reveal"),
    )
    return cases, table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), (F.col("n_chars") % 3).alias("n_citations"))


_CHECKS = r"""c AS (SELECT b.item_id AS id, lower(string_split(b.text, ' ')[1]) AS w1, lower(string_split(b.text, ' ')[2]) AS w2,
    coalesce(d.text, '') AS t, coalesce(d.n_chars % 3, 0) AS n FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id),
k AS (SELECT id, 'citation-present' AS name, n > 0 AS pass FROM c WHERE id % 2 = 0
    UNION ALL SELECT id, 'expected-facts-present', contains(lower(t), w1) FROM c
    UNION ALL SELECT id, 'refuses-out-of-corpus', regexp_matches(t,
        '(?i)do not cover|cannot|no( relevant)? (information|answer)|not (found|covered)') FROM c WHERE id % 5 = 0
    UNION ALL SELECT id, 'spoiler-ceiling-respected', NOT contains(lower(t), w2) FROM c WHERE id % 3 = 0
    UNION ALL SELECT id, 'llm-judge-correctness', NULL FROM c)"""


def eval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.checks(*_cases(spark, sf_dir)).select("id", "name", "pass")


def eval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.totals(E.checks(*_cases(spark, sf_dir)))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks, with the documents of their numbers as texts."""
    docs = table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("d"), "text", F.col("source").alias("book"))
    return _vectors(spark, sf_dir).join(docs, F.col("id") == F.col("d"), "left").drop("d").withColumn("chunk_index", F.col("id"))


def _embedder(spark: SparkSession, sf_dir: str):
    dim = len(_first(spark, sf_dir))
    return lambda text: V.hashed_words(text, dim)


def retrieve_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best passages of every question among the books of its own sources, the default ones where it names none."""
    rows = A.retrieve(K.questions(spark, sf_dir), _passages(spark, sf_dir), _embedder(spark, sf_dir))
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), "id", "score")


def default_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books that each question is answered from; none where nothing is filtered."""
    books = F.coalesce(F.array_join(V.books_of(F.col("sources")), ","), F.lit(""))
    return K.questions(spark, sf_dir).select("qid", books.alias("books"))


def ask_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every customer, from its text to the cited answer: graph facts, and the best passage of its sources."""
    rows = A.ask(K.questions(spark, sf_dir), K.family(spark, sf_dir), vectors=_passages(spark, sf_dir), embed=_embedder(spark, sf_dir))
    last = F.try_element_at(F.col("citations"), F.lit(-1))["locator"]
    return rows.select(
        "qid",
        F.md5("answer").alias("answer_digest"),
        F.size("citations").cast("long").alias("n_citations"),
        F.when(last.startswith("chunk "), last).alias("passage"),
    )


_VEC = f"""vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_extract(['{"','".join(BOOKS)}'], label + 1) AS book_id FROM embeddings)"""
_BOOKS_ASKED = "CASE c_custkey % 4 WHEN 1 THEN ['fab'] WHEN 2 THEN NULL ELSE ['agot', 'acok', 'asos', 'affc'] END"
#: Questions as hashed words, and their scores with the vectors of their books.
_RETRIEVED = f"""{_VEC}, dims AS (SELECT any_value(len(v)) AS dim FROM vec),
asked AS (SELECT c_custkey AS qid, {_BOOKS_ASKED} AS books,
    'who were ' || lower(c_name) || '''s ' || list_extract(['{"','".join(K.ASKED)}'], c_custkey % 8 + 1) || '?' AS t FROM customer),
said_w AS (SELECT qid, unnest(string_split(t, ' ')) AS w FROM asked),
codes AS (SELECT qid, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM said_w WHERE w <> ''),
axes AS (SELECT qid, h % dim AS d, sum(CASE WHEN (h // dim) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM codes, dims GROUP BY ALL),
long AS (SELECT qid, sqrt(sum(x * x)) AS n FROM axes GROUP BY qid),
dots AS (SELECT axes.qid, vec.id, any_value(vec.book_id) AS book_id, sum(CAST(x AS DOUBLE) * v[CAST(d AS BIGINT) + 1]) AS dot,
    any_value(sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS m FROM axes, vec GROUP BY axes.qid, vec.id),
sc AS (SELECT dots.qid, dots.id, round(coalesce(dot / nullif(n * m, 0), 0), 6) AS score
    FROM dots JOIN long ON long.qid = dots.qid JOIN asked ON asked.qid = dots.qid WHERE books IS NULL OR list_contains(books, book_id))"""
_SCORED = f"""WITH {_VEC}, s AS (SELECT a.id, a.book_id, round(list_cosine_similarity(a.v, q.v), 6) AS score FROM vec a, vec q
    WHERE q.id = 0)"""
#: The eight nearest of `now` for every twentieth vector, every third of these in two books only.
_NEAREST = """s AS (SELECT q.id AS qid, a.id, round(list_cosine_similarity(a.v, q.v), 6) AS score FROM now a, vec q
    WHERE q.id % 20 = 0 AND (q.id % 3 <> 0 OR a.book_id IN ('fab', 'agot'))),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 8"""
#: Paragraphs joined by one blank, walked chunk by chunk: `walk` has a row for each chunk that is done.
_CHUNKS = r"""WITH RECURSIVE lines AS (SELECT doc_id, source, list_filter(list_transform(
        regexp_split_to_array(regexp_replace(regexp_replace(text, '\r', '', 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '\n+'),
        lambda p: regexp_replace(regexp_replace(p, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
joined AS (SELECT doc_id, array_to_string(ps, ' ') AS t,
        list_transform(range(1, len(ps) + 1), lambda i: CAST(list_sum(list_transform(ps[1 : i],
            lambda p: length(p) + 1)) AS BIGINT) - 1) AS ends
        FROM lines WHERE len(ps) > 0),
-- One step a chunk: k of them are done, the next one starts at a, and e of the paragraphs are used up.
walk AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS e, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi
    FROM joined
    UNION ALL
    SELECT doc_id, k + 1,
        CASE WHEN long THEN ends[e + 1] - length(regexp_replace(substr(t, stop - 150 + 1, ends[e + 1] - stop + 150), '^\s+', ''))
            ELSE greatest(a, stop - 150) END,
        CASE WHEN long THEN e ELSE whole END, a, stop
    FROM (SELECT *, CASE WHEN NOT long THEN ends[whole] WHEN blank > 600 THEN a + blank ELSE a + 1200 END AS stop
        FROM (SELECT w.*, t, ends, ends[e + 1] - a > 1920 AS long,
                greatest(e + 1, len(list_filter(ends, lambda x: x <= a + 1200))) AS whole,
                least(1201, length(t) - a) - strpos(reverse(substr(t, a + 1, 1201)), ' ') AS blank
            FROM walk w JOIN joined USING (doc_id) WHERE e < len(ends)) steps) cut),
chunks AS (SELECT doc_id, k, regexp_replace(substr(t, lo + 1, hi - lo), '^\s+|\s+$', '', 'g') AS text FROM walk JOIN joined USING (doc_id)
    WHERE k > 0),
numbered AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, source AS book, row_number() OVER (PARTITION BY doc_id
    ORDER BY k) - 1 AS i, chunks.text
    FROM chunks JOIN documents USING (doc_id) WHERE length(chunks.text) >= 50)"""
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    "normalize_text": (normalize_text, f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents"),
    "source_id": (source_ids, """WITH f AS (SELECT DISTINCT 'The ' || source || ' ' || lang || ' (Final)_Copy.pdf' AS file FROM documents)
        SELECT file, CASE WHEN regexp_matches(lower(file), 'bundle|src1[0-4]') THEN 'bundle-1-4'
        WHEN regexp_matches(lower(file), 'src7') THEN 'fire-and-blood' WHEN regexp_matches(lower(file), 'src9') THEN 'knight-seven-kingdoms'
        ELSE substr(lower(regexp_replace(regexp_replace(file, '\\.pdf$', ''), '[^A-Za-z0-9]+', '-', 'g')), 1, 40) END AS source_id FROM f"""),
    "sample_positions": (sample_positions, """SELECT doc_id, CAST(f AS DOUBLE) AS fraction, substr(text,
        CAST(floor(length(text) * CAST(f AS DOUBLE)) AS BIGINT) + 1, 900) AS sample FROM documents, (VALUES (0.0), (0.12), (0.5)) t(f)
        WHERE text IS NOT NULL"""),
    "quality_verdict": (quality_verdict, """WITH p AS (SELECT doc_id, CAST(floor(length(trim(regexp_replace(coalesce(text, ''), '\\s+',
        ' ', 'g'))) / CAST(coalesce(nullif(n_chars // 1000, 0), 1) AS DOUBLE) + 0.5) AS BIGINT) AS per_page FROM documents)
        SELECT doc_id, per_page, CASE WHEN per_page >= 800 THEN 'TEXT' WHEN per_page >= 100 THEN 'PARTIAL' ELSE 'SCANNED' END AS verdict
        FROM p"""),
    "page_chars": (page_chars, """WITH p AS (SELECT page_id, CAST(floor(length(trim(regexp_replace(html, '\\s+', ' ',
        'g'))) / 2.0 + 0.5) AS BIGINT) AS per_page FROM pages) SELECT page_id, per_page, CASE WHEN per_page >= 800 THEN 'TEXT'
        WHEN per_page >= 100 THEN 'PARTIAL' ELSE 'SCANNED' END AS verdict FROM p"""),
    "dehyphenate_paragraphs": (dehyphenate_paragraphs, f"""WITH d AS (SELECT doc_id,
        list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '\\r', '', 'g'), '([A-Za-z])-\\n([a-z])',
        '\\1\\2', 'g'), '\\n+'), lambda p: {_TRIM.format(chr(39).join(['regexp_replace(p, ', '[ \\t]{2,}', ', ', ' ', ', ', 'g', ')']))}),
        lambda p: p <> '') AS ps FROM documents), e AS (SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS i FROM d)
        SELECT doc_id, i - 1 AS place, paragraph FROM e"""),
    "book_slices": (book_slices, """WITH s AS (SELECT doc_id AS raw_id, CAST(i AS BIGINT) AS book_id,
        CAST(floor(length(text) * CAST(f AS DOUBLE)) AS BIGINT) AS start, text FROM documents, (VALUES (0, 0.0), (1, 0.3), (2, 0.6)) t(i, f)
        WHERE text IS NOT NULL), e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY raw_id ORDER BY start), length(text)) AS stop
        FROM s) SELECT raw_id, book_id, start, md5(substr(text, start + 1, stop - start)) AS digest FROM e"""),
    "chunk_documents": (
        chunk_documents,
        f"""{_CHUNKS} SELECT book_id || '#' || i AS id, book_id, book, CAST(i AS INTEGER) AS chunk_index,
            CAST(length(text) AS INTEGER) AS chars, text FROM numbered""",
    ),
    "chunk_stretches": (
        chunk_stretches,
        f"""{_CHUNKS} SELECT book_id || '#' || i AS id, book_id, book, CAST(i AS INTEGER) AS chunk_index,
            CAST(length(text) AS INTEGER) AS chars, text FROM numbered""",
    ),
    "book_splits": (book_splits, """WITH d AS (SELECT *, doc_id // 8 AS k, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS ord,
        'Volume ' || doc_id || ' of the shelf' AS title FROM documents),
        h AS (SELECT *, CASE WHEN ord = 1 OR doc_id % 3 = 0 THEN title || chr(10) || chr(10) || 'Bantam Books' || chr(10)
            WHEN doc_id % 3 = 1 THEN 'Here begins volume ' || doc_id || '.' || chr(10)
            ELSE 'This is ' || title || ' indeed.' || chr(10) END || coalesce(text, '') || chr(10) AS whole,
            CASE WHEN ord > 1 AND doc_id % 3 = 2 THEN 8 ELSE 0 END AS late FROM d),
        b AS (SELECT k, 'Contents' || chr(10) || string_agg(title, chr(10) ORDER BY ord) || chr(10) || repeat('-', 300) || chr(10) AS contents,
            string_agg(whole, '' ORDER BY ord) AS body FROM h GROUP BY k),
        s AS (SELECT h.k, doc_id, contents || body AS bundle, length(contents) + late + coalesce(sum(length(whole)) OVER (PARTITION BY h.k
            ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h JOIN b ON h.k = b.k),
        e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start), length(bundle)) AS stop FROM s)
        SELECT CAST(k AS VARCHAR) AS raw_id, CAST(doc_id AS VARCHAR) AS book_id, CAST(start AS BIGINT) AS start,
            sha256(substr(bundle, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT))) AS digest FROM e"""),
    "chunk_report": (
        chunk_report,
        f"""{_CHUNKS} SELECT book_id, book, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars,
            arg_min(text, i) AS first_text FROM numbered GROUP BY book_id, book""",
    ),
    "chunk_stride": (stride_chunks, """WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1050)) AS pos
        FROM documents WHERE text IS NOT NULL) SELECT doc_id, pos // 1050 AS chunk_index, md5(substr(text, pos + 1, 1200)) AS digest FROM d"""),
    "vector_topk": (vector_topk, f"{_SCORED} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 8"),
    "vector_topk_filtered": (vector_topk_filtered, f"""{_SCORED} SELECT id, score, book_id FROM s WHERE book_id IN ('fab', 'kotsk')
        ORDER BY score DESC, id LIMIT 8"""),
    "vector_topk_batch": (vector_topk_batch, f"""WITH {_VEC}, s AS (SELECT q.id AS qid, a.id, round(list_cosine_similarity(a.v, q.v),
        6) AS score FROM vec a, vec q WHERE q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid
        ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 8"""),
    "vector_topk_ivf": (vector_topk_ivf, f"WITH {_VEC}, now AS (SELECT * FROM vec), {_NEAREST}"),
    "vector_store_upserted": (vector_store_upserted, f"""WITH {_VEC}, now AS (
        SELECT id, CASE WHEN id % 7 = 0 AND id % 33 <> 0 THEN list_reverse(v) ELSE v END AS v,
            CASE WHEN id % 7 = 0 AND id % 33 <> 0 THEN 'misc' ELSE book_id END AS book_id FROM vec WHERE id % 11 <> 0 OR id % 33 = 0
        UNION ALL SELECT id + 1000000, list_transform(v, lambda x: -x), book_id FROM vec WHERE id % 5 = 0), {_NEAREST}"""),
    "snippet_projection": (snippet_projection, f"""{_SCORED} SELECT id, score, source AS work, 'chunk ' || id AS locator, 'novel' AS type,
        book_id, text FROM s LEFT JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 8"""),
    "vector_upsert": (vector_upsert, """SELECT doc_id AS id, 'label-' || quality AS source FROM labels UNION ALL SELECT doc_id, source
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "vector_parts": (vector_parts, """WITH n AS (SELECT l_orderkey * 8 + l_linenumber AS id, row_number()
        OVER (ORDER BY l_orderkey * 8 + l_linenumber) AS r FROM lineitem)
        SELECT (r - 1) // 5000 + 1 AS part, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM n GROUP BY 1"""),
    "resume_antijoin": (resume_antijoin, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "json_relations": (event_props, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "candidates": (candidates, f"""WITH {_OUT} SELECT type, book_id, src IS NOT NULL
        AND dst IS NOT NULL AS resolved, count(*) AS n, min(a) AS least, max(evidence) AS most FROM can GROUP BY 1, 2, 3"""),
    "review_groups": (review_groups, f"{_WHOLE_GROUPS} SELECT key, n, n_chunks, array_to_string(ev, '; ') AS evidence, cls FROM g"),
    "review_classes": (review_classes, f"""{_GROUPS} SELECT cls, count(*) AS edges, CAST(sum(n) AS BIGINT) AS candidates FROM g
        GROUP BY cls"""),
    "worklist_topk": (worklist_topk, f"""{_GROUPS} SELECT key, n, array_to_string(ev[1:2], '; ') AS evidence FROM g WHERE cls = 'novel'
        AND n_chunks % 2 <> 0 ORDER BY n DESC, key LIMIT 20"""),
    "review_epochs": (review_epochs, f"{_GROUPS} SELECT key, n, array_to_string(ev, '; ') AS evidence, cls FROM g"),
    "reviewed_extended": (reviewed_extended, f"""{_GROUPS} SELECT key, CASE WHEN n % 2 = 0 THEN 'extracted:reviewed' END AS source,
        CASE WHEN n % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN n % 2 = 0 THEN n_chunks ELSE -1 END AS n_chunks
        FROM g WHERE cls = 'novel' AND (n % 2 = 0 OR n % 3 = 0)"""),
    "parts_written": (parts_written, """WITH o AS (SELECT o_orderkey AS k, length(o_orderpriority) AS n, row_number() OVER (ORDER BY o_orderkey)
        AS r FROM orders) SELECT (r - 1) // 5000 + 1 AS part, count(*) AS rows, min(k) AS first_k, max(k) AS last_k,
        CAST(sum(n) AS BIGINT) AS chars FROM o GROUP BY 1"""),
    "eval_checks": (eval_checks, f"WITH {_CHECKS} SELECT id, name, pass FROM k"),
    "eval_totals": (eval_totals, f"""WITH {_CHECKS} SELECT count(*) FILTER (WHERE pass) AS passed,
        count(*) FILTER (WHERE NOT pass) AS failed, count(*) FILTER (WHERE pass IS NULL) AS skipped FROM k"""),
    "retrieve_top8": (
        retrieve_top8,
        f"""WITH {_RETRIEVED}, r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)
            SELECT * FROM r WHERE rank <= 8""",
    ),
    "default_source": (default_source, f"""SELECT c_custkey AS qid, coalesce(array_to_string({_BOOKS_ASKED}, ','), '') AS books
        FROM customer"""),
    "ask_flagship": (
        ask_flagship,
        f"{K.ANSWERS}, {_RETRIEVED}, top AS (SELECT qid, arg_min(id, (-score, id)) AS id FROM sc GROUP BY qid) "
        """SELECT c_custkey AS qid, md5(coalesce(said.answer, d.text, 'The sources provided do not cover that. (stub)')) AS answer_digest,
            coalesce(said.n, 0) + CASE WHEN top.id IS NULL THEN 0 ELSE 1 END AS n_citations, 'chunk ' || top.id AS passage FROM customer
            LEFT JOIN said ON said.qid = c_custkey LEFT JOIN top ON top.qid = c_custkey LEFT JOIN documents d ON d.doc_id = top.id""",
    ),
}
