"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.sources.ordered import write_ordered

CHUNK = "id string, book_id string, book string, chunk_index int, chars int, text string"
VECTOR = "id string, values array<float>, metadata struct<book_id:string,book:string,chunk_index:int,text:string>"
EDGE = "type string, src string, dst string, source string, status string"
REVIEWED = "type string, `from` string, `to` string, a string, b string, src string, dst string, source string, status string, evidenceChunks array<string>"
CANDIDATE = "type string, src string, dst string, raw_subject string, raw_object string, relation string, evidence string, chunk_id string, book_id string, status string, resolved boolean, __processed string"
SEED = "meta struct<version:string>, nodes array<struct<id:string,name:string,house:string,gender:string,aliases:array<string>>>, edges array<struct<type:string,`from`:string,`to`:string,a:string,b:string,source:string,status:string>>"
CASE = "questions array<struct<id:string,question:string,type:string,sources:array<string>,expected_facts:array<string>,required_citation:boolean,must_refuse:boolean,must_not_reveal:array<string>,spoiler_ceiling:string,note:string>>"


def pdf_texts(spark: SparkSession, folder: str, extract: Callable, suffix: str = "*.[pP][dD][fF]") -> DataFrame:
    """(file, text, num_pages) of a folder's PDF files, in order of name. `extract` is a pandas UDF from content to struct<text,num_pages>; it gives null for a file it cannot read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), extract("content").alias("x")).select("file", "x.*").orderBy("file")


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_id, text) of files raw-<id>.txt, or of what write_raw wrote; files that vanish meanwhile are skipped."""
    rows = spark.read.option("ignoreMissingFiles", True).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    own = F.url_decode(F.url_decode(F.regexp_extract(path, r"/raw_id=([^/]+)/[^/]*$", 1)))  # once for the folder, once for the path
    named = F.regexp_extract(path, r"/raw-([^/]*)\.txt$", 1)
    # Spark ends each text that it writes with a line break.
    return rows.select(
        F.when(own != "", own).otherwise(named).alias("raw_id"),
        F.when(own != "", F.regexp_replace("value", r"\n\z", "")).otherwise(F.col("value")).alias("text"),
    ).where("raw_id <> ''")


def write_raw(rows: DataFrame, folder: str) -> None:
    """Texts (raw_id, text), a file each, in a subfolder each."""
    rows.select("raw_id", "text").write.partitionBy("raw_id").option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones too unless `strict`, where they fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of an output so far; a torn last line is passed over."""
    return read_jsonl(spark, path, "id string").where("id is not null").distinct()


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates without the marks of processed chunks."""
    return read_jsonl(spark, path, CANDIDATE).where("__processed is null and type is not null").drop("__processed")


def read_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a seed file, with their places in it as ordinals."""
    doc = spark.read.option("multiLine", True).schema(SEED).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("node_ord", "n")).select("n.*", F.col("node_ord").cast("long").alias("node_ord"))
    edges = doc.select(F.posexplode("edges").alias("edge_ord", "e"))
    ends = [F.coalesce(F.col("e.from"), F.col("e.a")).alias("src"), F.coalesce(F.col("e.to"), F.col("e.b")).alias("dst")]
    return nodes, edges.select("e.type", *ends, "e.source", "e.status", F.col("edge_ord").cast("long").alias("edge_ord"))


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed edges, whose ends stand as from and to, a and b, or src and dst, with ordinals; an absent or torn file has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark.createDataFrame([], REVIEWED)
    if fs.exists(at):  # a file is one JSON array; a folder, as write_reviewed leaves it, has a line an edge
        rows = spark.read.schema(REVIEWED).option("multiLine", fs.getFileStatus(at).isFile()).option("mode", "DROPMALFORMED").json(path)
    ends = [F.coalesce("src", "from", "a").alias("src"), F.coalesce("dst", "to", "b").alias("dst")]
    return rows.select(
        "type",
        *ends,
        "source",
        "status",
        F.col("evidenceChunks").alias("evidence_chunks"),
        F.monotonically_increasing_id().alias("edge_ord"),
    ).where("type is not null")


def write_reviewed(rows: DataFrame, path: str) -> None:
    """Reviewed edges (type, src, dst, source, status, optional evidence_chunks and edge_ord), rejected ones too, as JSON lines in order.

    What was at `path` is replaced once all rows are written, so they may be read from there.
    """
    parent = F.col("type") == "parent"
    ends = [
        F.when(parent, F.col("src")).alias("from"),
        F.when(parent, F.col("dst")).alias("to"),
        F.when(~parent, F.col("src")).alias("a"),
        F.when(~parent, F.col("dst")).alias("b"),
    ]
    chunks = [F.col("evidence_chunks").alias("evidenceChunks")] if "evidence_chunks" in rows.columns else []
    order = [F.col("edge_ord").alias("_ord")] if "edge_ord" in rows.columns else []
    kept = rows.select("type", *ends, "source", "status", *chunks, *order)
    if order:  # ordinals of several sources may be equal; a unique number in their order takes their place
        kept = kept.orderBy("_ord").drop("_ord")
    write_ordered(kept, path)


def add_reviewed(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Reviewed edges added at the end of those at `path`, which is replaced as a whole; read_reviewed reads both."""
    before = read_reviewed(spark, path).withColumn("_new", F.lit(0))
    after = rows.withColumn("_new", F.lit(1)) if "edge_ord" in rows.columns else rows.withColumns({"_new": F.lit(1), "edge_ord": F.monotonically_increasing_id()})
    both = before.unionByName(after, allowMissingColumns=True).orderBy("_new", "edge_ord").drop("_new", "edge_ord")
    write_reviewed(both, path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The questions of an evaluation file."""
    return spark.read.option("multiLine", True).schema(CASE).json(path).select(F.explode("questions").alias("q")).select("q.*")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=VALUE lines; comments and blank lines go, matching quotes too, the first of a key stays."""
    line = F.trim("value")
    pair = spark.read.text(path).where(~line.rlike("^(#|$)") & line.contains("=")).select(
        F.trim(F.regexp_extract(line, "^([^=]+)=", 1)).alias("key"),
        F.trim(F.regexp_extract(line, "^[^=]+=(.*)$", 1)).alias("v"),
        F.monotonically_increasing_id().alias("o"),
    )
    bare = F.when(F.col("v").rlike("^\".*\"$|^'.*'$"), F.substring("v", F.lit(2), F.length("v") - 2)).otherwise(F.col("v"))
    return pair.groupBy("key").agg(F.min_by(bare, "o").alias("value"))


def write_parts(rows: DataFrame, path: str, size: int = 5000, order: str | None = None) -> None:
    """JSON lines in files part-001.json, ... of at most `size` rows each, in the order of a unique integer column; what was there goes."""
    write_ordered(rows, path, order, size)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of write_parts with `part`, the number of their file."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("part", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"))


def settings(spark: SparkSession, path: str, given: dict[str, str]) -> dict[str, str]:
    """A settings file's values; those already given stay."""
    return {r["key"]: r["value"] for r in read_settings(spark, path).collect()} | given


def write_graph(graph, path: str, version: str | None = None) -> None:
    """The compiled graph as tables below `path`, with a row of counts, version and time; overwriting makes a reload repeatable."""
    from loomlight.operators.graph import counts

    about = counts(graph).withColumns({"version": F.lit(version).cast("string"), "built_at": F.current_timestamp()})
    about.write.mode("overwrite").parquet(f"{path}/meta")
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.links.write.mode("overwrite").parquet(f"{path}/links")


def write_script(lines: DataFrame, path: str) -> None:
    """A SQL script in order, as text."""
    lines.orderBy("part", "ord").select("line").write.mode("overwrite").text(path)
