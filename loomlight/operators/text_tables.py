"""Splitting and chunking as table functions, callable from SQL, on long texts that come in stretches.

A text is cut into stretches in the JVM; no Python worker holds more than one of them and what is carried
over. `book_places` looks at each stretch by itself, `book_starts` decides from the places in order,
`chunk_text` packs the stretches of a book in order:

    SELECT * FROM chunk_text(TABLE(pieces) PARTITION BY book_id ORDER BY place)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlight.operators.chunks import HARD, LEAST, OVERLAP, TARGET, _title_lines, _title_page, steps
from loomlight.ship import ship
from loomlight.storage import written

#: Characters of a stretch, and of its neighbours that are seen with it. A title line or marker is at most as long as the latter.
STRETCH, CONTEXT = 1 << 20, 4096

# White space as Unicode has it.
WHITE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BROKEN = re.compile(r"([A-Za-z])-\n([a-z])")
MAY_BREAK = re.compile(r"[A-Za-z](-\n?)?\Z")
PAGE, MARKER, MENTION, NOWHERE, WHOLE = 0, 1, 2, 3, -1


class Paragraphs:
    """The paragraphs of a text that comes in stretches, as `functions.text.paragraphs` has them; holds one that has not ended."""

    def __init__(self, breaks: str):
        self.breaks, self.raw, self.open = re.compile(breaks), "", ""

    def add(self, stretch: str, last: bool = False) -> Iterator[str]:
        self.raw += stretch.replace("\r", "")
        at = max((m.end() for m in BROKEN.finditer(self.raw)), default=0)
        held = MAY_BREAK.search(self.raw, at)  # the next stretch may go on with the other half of a word
        stop = held.start() if held and not last else len(self.raw)
        self.open += BROKEN.sub(r"\1\2", self.raw[:stop])
        self.raw = self.raw[stop:]
        begin = 0
        for m in self.breaks.finditer(self.open):
            if m.end() == len(self.open) and not last:
                break  # it may go on
            yield from self._folded(self.open[begin : m.start()])
            begin = m.end()
        self.open = self.open[begin:]
        if last:
            yield from self._folded(self.open)

    @staticmethod
    def _folded(text: str) -> Iterator[str]:
        if out := re.sub(r"[ \t]{2,}", " ", text.replace("\n", " ")).strip(WHITE):
            yield out


class Packer:
    """The chunks of paragraphs that come one by one, as `chunks.pack` has them; holds what the next chunk may take."""

    def __init__(self, target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD, least: int = LEAST):
        self.bounds, self.least = (target, overlap, hard), least
        self.text, self.start, self.ends, self.begun = "", 0, [], False

    def add(self, paragraph: str) -> Iterator[str]:
        self.text += (" " if self.begun else "") + paragraph
        self.begun = True
        self.ends.append(len(self.text))
        if self.ends[-1] - self.start > self.bounds[0]:
            yield from self._chunks(False)

    def close(self) -> Iterator[str]:
        yield from self._chunks(True)

    def _chunks(self, last: bool) -> Iterator[str]:
        first, start = 0, self.start
        for a, b, then, at in steps(self.text, self.ends, *self.bounds, start=self.start):
            if at == len(self.ends) and not last:
                break  # the next paragraph may still fit
            first, start = at, then
            if len(out := self.text[a:b].strip()) >= self.least:
                yield out
        gone = min(start, len(self.text))
        self.text, self.start, self.ends = self.text[gone:], start - gone, [e - gone for e in self.ends[first:]]


class ChunkText:
    """Rows (book_id, book, place, text) of one book in order of place; null texts count as empty."""

    def __init__(self):
        self.book = None

    def eval(self, row, breaks: str = r"\n{2,}", target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD):
        if self.book is None:
            self.book, self.n = (row["book_id"], row["book"]), 0
            self.paragraphs, self.packer = Paragraphs(breaks), Packer(target, overlap, hard)
        for paragraph in self.paragraphs.add(row["text"] or ""):
            yield from self._rows(self.packer.add(paragraph))

    def terminate(self):
        if self.book is not None:
            for paragraph in self.paragraphs.add("", last=True):
                yield from self._rows(self.packer.add(paragraph))
            yield from self._rows(self.packer.close())

    def _rows(self, chunks: Iterator[str]):
        for text in chunks:
            yield f"{self.book[0]}#{self.n}", *self.book, self.n, len(text), text
            self.n += 1


class BookPlaces:
    """Of a row (raw_id, place, before, text, after, books) every place where a book may begin, with its rank."""

    def eval(self, row):
        text, books = row["before"] + row["text"] + row["after"], row["books"]
        if len(books) == 1:
            return
        shift, own = row["place"] - len(row["before"]), range(len(row["before"]), len(row["before"]) + len(row["text"]))
        low, prefixes = text.lower(), [b["title"].lower()[:8] for b in books]
        for b in books:
            title, n = b["title"], len(b["title"])
            found = [(PAGE, p) for p in _title_lines(text, title) if p in own and _title_page(text[p + n : p + n + 200], prefixes)]
            if b["start_marker"]:
                found += [(MARKER, p) for p in _marks(text, b["start_marker"]) if p in own]
            found += [(MENTION, p) for p in _marks(low, re.escape(title.lower())) if p in own]
            for rank, p in found:
                yield row["raw_id"], b["ord"], rank, shift + p


def _marks(text: str, pattern: str) -> Iterator[int]:
    """Where a pattern is found from any place on, overlaps included."""
    mark = re.compile(pattern, re.IGNORECASE)
    found = mark.search(text)
    while found:
        yield found.start()
        found = mark.search(text, found.start() + 1)


class BookStarts:
    """Of rows (raw_id, ord, rank, at) of one text, by ord, rank and at, where each book begins: at the first place behind the book before."""

    def __init__(self):
        self.least, self.done = 0, None

    def eval(self, row):
        if row["ord"] != self.done and (row["rank"] == NOWHERE or row["at"] >= self.least):
            start = self.least if row["rank"] == NOWHERE else row["at"]
            self.least, self.done = start + 1, row["ord"]
            yield row["raw_id"], row["ord"], start


_FUNCTIONS = {
    "chunk_text": (ChunkText, "id string, book_id string, book string, chunk_index int, chars int, text string"),
    "book_places": (BookPlaces, "raw_id string, ord int, rank int, at long"),
    "book_starts": (BookStarts, "raw_id string, ord int, start long"),
}


def register(spark: SparkSession) -> None:
    """Makes the three functions known to the session's SQL."""
    ship(spark)
    for name, (cls, ddl) in _FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=ddl))


def stretches(raw: DataFrame, size: int = STRETCH, context: int = CONTEXT) -> DataFrame:
    """(raw_id, place, before, text, after) of (raw_id, text): stretches, where each begins, and what stands around it. Null and empty texts have none."""
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    near = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    one = lambda part, i: F.struct(
        (i.cast("long") * size).alias("place"),
        F.when(i > 0, F.substring(F.get("parts", i - 1), -context, context)).otherwise("").alias("before"),
        part.alias("text"),
        F.substring(near(i + 1), 1, context).alias("after"),
    )
    rows = raw.select(F.col("raw_id").cast("string").alias("raw_id"), parts.alias("parts"))
    return rows.select("raw_id", F.explode(F.transform("parts", one)).alias("s")).select("raw_id", "s.*")


def split_books(raw: DataFrame, catalog: DataFrame, size: int = STRETCH, context: int = CONTEXT) -> DataFrame:
    """(raw_id, book_id, book, start, place, text): the stretches of every book of raw texts (raw_id, text), each with its place in the raw text.

    `catalog` (raw_id, ord, book_id, title, start_marker) names the books of each raw text in their order, by the rules of
    `chunks.book_starts`; texts that it does not name drop, and so do books of texts that are null or absent. A book without text has one row without it.
    raw_id is unique in `raw`, (raw_id, ord) in `catalog`; markers have no anchors.
    """
    spark = raw.sparkSession
    register(spark)
    text = written(stretches(raw, size, context))
    c = catalog.select(F.col("raw_id").cast("string").alias("raw_id"), F.col("ord").cast("int").alias("ord"), "book_id", "title", "start_marker")
    books = c.groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("ord", "book_id", "title", "start_marker"))).alias("books"))
    found = spark.sql("SELECT * FROM book_places(TABLE(SELECT * FROM {t}))", t=text.join(books, "raw_id"))
    alone = F.size("books") == 1
    rest = books.select("raw_id", F.explode("books.ord").alias("ord"), F.when(alone, WHOLE).otherwise(NOWHERE).alias("rank"), F.lit(0).cast("long").alias("at"))
    rest = rest.join(raw.where("text is not null").select(F.col("raw_id").cast("string").alias("raw_id")), "raw_id", "left_semi")
    starts = spark.sql("SELECT * FROM book_starts(TABLE(SELECT * FROM {t}) PARTITION BY raw_id ORDER BY (ord, rank, at))", t=found.unionByName(rest))
    end = F.lead("start").over(W.partitionBy("raw_id").orderBy("start", "ord"))
    starts = written(starts.withColumn("end", end).join(c, ["raw_id", "ord"]))
    s, t = starts.alias("s"), text.select("raw_id", "place", "text").alias("t")
    stop = F.coalesce(F.col("s.end"), F.lit(1 << 62))
    meet = (F.col("s.raw_id") == F.col("t.raw_id")) & (F.col("t.place") < stop) & (F.col("t.place") + F.length("t.text") > F.col("s.start"))
    begin = F.greatest(F.col("s.start") - F.col("t.place"), F.lit(0))
    wide = F.least(stop - F.col("t.place"), F.lit(size)) - begin
    return s.join(t, meet, "left").select(
        F.col("s.raw_id"),
        F.col("s.book_id").cast("string").alias("book_id"),
        F.col("s.title").alias("book"),
        F.col("s.start"),
        (F.col("t.place") + begin).alias("place"),
        F.substring(F.col("t.text"), (begin + 1).cast("int"), wide.cast("int")).alias("text"),
    )


def chunk(books: DataFrame, breaks: str = r"\n{2,}", target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD) -> DataFrame:
    """chunks.chunk of books in stretches (book_id, book, place, text); book_id tells books apart."""
    spark = books.sparkSession
    register(spark)
    rows = books.select(F.col("book_id").cast("string").alias("book_id"), F.col("book").cast("string").alias("book"), "place", "text")
    return spark.sql(
        "SELECT * FROM chunk_text(TABLE(SELECT * FROM {t}) PARTITION BY book_id ORDER BY (place), :breaks, :target, :overlap, :hard)",
        args={"breaks": breaks, "target": target, "overlap": overlap, "hard": hard},
        t=rows,
    )
