"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    sharding,
    simhash,
    suffix_dedup,
    token_store,
    toxicity,
    vector_codes,
)
from loomlight.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents")).drop("kept", "removed")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), words=3, threshold=90)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"), words=4, most=4)


def with_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text); in those whose crc32 of doc_id ends in 0, the words from one on repeat a first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        times = F.ceil((n - a) / p).cast("int")
        period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.concat_ws(" ", F.concat(F.slice(w, F.lit(1), a.cast("int")), tail))).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # Inside transform() the words stand for one value, and are taken once.
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.longest(periodic_runs.detect(with_tails(table(spark, sf_dir, "documents"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.*",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(hashlib.sha256((books.text() if books else "").encode()).hexdigest()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_dedup,
        op2_toxicity,
        op3_secret_scan,
        op4_best_fit_packing,
        op5_sharding,
        op6_exact_dedup,
        op7_quality,
        op8_jaccard_join,
        op9_decontamination,
        op10_token_store,
        op11_simhash,
        op12_periodic_runs,
        op13_vector_codes,
    )
    return {f.__name__: f for f in every}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _vector_codes_sql() -> str:
    """Four rounds of the same two steps: the nearest entry of each part, and the floored means."""
    step = """
            near{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := CAST(list_sum(list_transform(range(1, len(v) + 1),
                lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS BIGINT), e := e)) AS best FROM cut JOIN book{i} USING (p) GROUP BY r, p),"""
    mean = """
            sums{i} AS (SELECT p, best.e AS e, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS j FROM near{i} JOIN cut USING (r, p)) GROUP BY ALL),
            moved{i} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY j) AS c FROM sums{i} GROUP BY p, e),
            book{k} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN moved{i} m ON b.p = m.p AND b.e = m.e),"""
    rounds = "".join(step.format(i=i) + mean.format(i=i, k=i + 1) for i in range(4)) + step.format(i=4)
    return f"""
            WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
                    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
                FROM embeddings WHERE embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            cut AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS v
                FROM (SELECT r, x, unnest(range(0, 4)) AS p FROM kept)),
            book0 AS (SELECT p, r AS e, v AS c FROM cut WHERE r < 256),{rounds}
            coded AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
                FROM near4 GROUP BY r),
            books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book4)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
            FROM kept JOIN coded USING (r), books"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_vector_codes": _vector_codes_sql(),
        "op1_suffix_dedup": """
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            blocks AS (SELECT doc_id, o, len(h) // 2 - 199 - o AS more, substr(h, 2 * o + 1, 2398) AS part
                FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 1000)) AS o FROM d) cuts),
            starts AS (SELECT doc_id, o, part, unnest(range(0, least(1000, more))) AS i FROM blocks),
            windows AS (SELECT doc_id, o + i AS i, md5(substr(part, 2 * i + 1, 400)) AS s FROM starts),
            twice AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
            steps AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w, 201) AS gap FROM twice WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
            runs AS (SELECT doc_id, i, sum(CASE WHEN gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
            spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
            between_ AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS done FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
            cut AS (SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop,
                           string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept
                    FROM between_ s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
            SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans,
                0) AS n_spans,
                   sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
            FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id""",
        "op6_exact_dedup": f"""
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op8_jaccard_join": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w
                FROM documents),
            sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                            ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM d),
            postings AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
            pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM postings x JOIN postings y ON x.g = y.g AND x.doc_id < y.doc_id
                WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
                GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
            links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
            reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach
                JOIN links ON links.a = reach.other),
            least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
            degree AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
            SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(n_links,
                0) AS n_links
            FROM sets s LEFT JOIN least USING (doc_id) LEFT JOIN degree USING (doc_id)""",
        "op9_decontamination": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                FROM documents),
            b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                FROM benchmark),
            win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
                    FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b
                        WHERE len(w) > 0)),
            ks AS (SELECT DISTINCT k FROM win),
            pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
            occ AS (SELECT p.doc_id, p.i, ks.k, array_to_string(p.w[p.i : p.i + ks.k - 1], ' ') AS s FROM pos p, ks
                WHERE p.i + ks.k - 1 <= len(p.w)),
            hit AS (SELECT o.doc_id, o.i, o.k, win.item_id FROM occ o JOIN win ON o.s = win.s AND o.k = win.k),
            n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
            it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
                   sha256(coalesce(it.x, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    }
