"""Secret scans with DataFrame functions only.

Three fixed patterns give base spans. Beyond them, the pieces of every run of token characters are
compared under two first-order character Markov models, one of random strings and one of ordinary
identifiers, by log-likelihood ratio; ratios add up over pieces in a row. Both models are counted from
labelled strings: generated random ones; generated identifiers and the words of all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # runs are maximal, so the least length can stand in the pattern
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Characters that the models know. Separators break a run into pieces and count for neither class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+="
SEPARATORS = "[/_-]"
LEAST = 12
#: Signs of equality end a run and do not join two.
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: Generated strings of each form.
SAMPLE_STRINGS = 2000
#: Nats by which a stretch must favour the random model in all: odds of about 400. So the mean that a transition needs falls with the length.
THRESHOLD = 6.0
#: A stretch ends where its sum was greatest, once it has fallen to 0 or by this much from there.
DROP = 20.0
#: Counts that the single-character shares weigh.
BACK_OFF = 10.0
#: What makes up an ordinary model: words of the documents, generated identifiers, both by classes of characters alone; the rest is shared evenly.
ORDINARY = (0.55, 0.25, 0.18)
#: Words of the documents that are learnt from have this many characters at most.
LONGEST_WORD = 40
#: Words of generated identifiers.
PARTS = "user order invoice customer item report page index value name path file version date time count data test server client request response config default error message session status update window".split()

def running(steps: Column) -> Column:
    """For each number of an array the sum of those before it.

    Arrays grow by copying, so sums run within blocks of about the root of the length: n numbers cost
    about n times their root, and little for each.
    """
    n = F.size(steps)
    wide = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
    block = lambda i: F.slice(steps, i + 1, wide)
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), wide)
    totals = F.transform(at, lambda i: F.aggregate(block(i), F.lit(0), lambda s, x: s + x))
    bases = F.slice(F.aggregate(totals, F.array(F.lit(0)), add), F.lit(1), F.size(at))
    sums = F.zip_with(at, bases, lambda i, b: F.aggregate(block(i), F.array(b), add))
    return F.flatten(F.transform(sums, lambda x: F.slice(x, F.lit(1), F.size(x) - 1)))


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPAN = "struct<start:int,kind:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """STRUCT of all leftmost non-overlapping matches: `s`, the pieces between them, and `found`, (start, kind, end, value, good) in code points.

    With `least`, a match is good if its group 2 is that long. The pieces between the matches give the offsets.
    """
    p = F.lit(pattern)
    group = F.regexp_extract_all(text, p, F.lit(2 if least else 0))
    parts = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), group.alias("g"), F.split(text, pattern, -1).alias("s"))

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["s"], F.lit(1), F.size(x["m"])), x["m"], lambda s, m: F.length(s) + F.length(m))
        ends = F.zip_with(running(steps), steps, lambda before, step: before + step)
        rows = F.arrays_zip(ends.alias("end"), x["m"].alias("m"), x["g"].alias("g"))
        one = lambda r: F.struct((r["end"] - F.length(r["m"])).alias("start"), F.lit(kind).alias("kind"), r["end"].alias("end"), r["m"].alias("value"), (F.length(r["g"]) >= least).alias("good"))
        return F.struct(x["s"].alias("s"), F.transform(rows, one).alias("found"))

    return bound(parts, placed)


def spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the good matches."""
    good = F.filter(matches(text, pattern, kind, least)["found"], lambda x: x["good"])
    rows = F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def masked(text: Column, pattern: str, least: int) -> Column:
    """The text with its good matches blanked, at the same length."""

    def whole(x: Column) -> Column:
        blank = lambda s, m: F.concat(F.coalesce(s, F.lit("")), F.when(m["good"], F.repeat(F.lit("\x01"), F.length(m["value"]))).otherwise(F.coalesce(m["value"], F.lit(""))))
        return F.array_join(F.zip_with(x["s"], x["found"], blank), "")

    return F.when(text.rlike(pattern), bound(matches(text, pattern, 0, least), whole)).otherwise(text)


def identifiers(i: Column) -> Column:
    """Ordinary identifiers with numbers and joined words, for a number: times, counters, versions, names in several cases."""
    words = F.array(*(F.lit(w) for w in PARTS))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(i), F.lit(10_000_000_000))
    few = F.pmod(number, F.lit(1000)).cast("string")
    at = F.timestamp_seconds(number)
    return F.array(
        F.date_format(at, "yyyyMMddHHmmss"),
        F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"),
        F.lpad(number.cast("string"), 12, "0"),
        F.concat(word(1), few),
        F.concat(F.upper(word(2)), few),
        F.concat(F.lit("v"), few),
        F.concat(word(1), F.initcap(word(2)), F.initcap(word(3))),
        F.concat(F.initcap(word(3)), F.initcap(word(4)), few),
        F.concat(few, word(5)),
    )


def random_strings(i: Column) -> Column:
    """Random strings for a number: of mixed case, of capitals and of small letters, each with digits."""
    digest = lambda k: F.sha2(F.concat_ws(":", i.cast("string"), F.lit(k)), 256)
    one_case = lambda k: F.concat(*(F.conv(F.substring(digest(k), at, F.lit(15)), 16, 36) for at in (2, 18)))
    return F.array(F.base64(F.unhex(digest("mixed"))), one_case("capitals"), F.lower(one_case("small")))


#: Labels: words of documents, generated identifiers, then the forms of random strings in their order above.
WORD, IDENTIFIER, FORMS = 0, 1, (2, 3, 4)


def labelled(docs: DataFrame, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(label, word, n): the words that documents have twice or more with their number, generated identifiers and random strings."""
    ids = docs.sparkSession.range(strings)
    words = docs.select(F.explode(F.regexp_extract_all("open", F.lit("[A-Za-z0-9+]{2,}"), F.lit(0))).alias("word"))
    # A secret is seen once as a rule, so words seen once teach nothing.
    words = words.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    names = ids.select(F.lit(IDENTIFIER).alias("label"), F.explode(identifiers(F.col("id"))).alias("word"))
    made = ids.select(F.posexplode(random_strings(F.col("id"))).alias("label", "word")).withColumn("label", F.col("label") + FORMS[0])
    return names.unionByName(made).withColumn("n", F.lit(1).cast("long")).unionByName(words.withColumn("label", F.lit(WORD)))


def train(docs: DataFrame, strings: int = SAMPLE_STRINGS) -> list[list[float]]:
    """Logarithms of the shares of transitions, row by row over ALPHABET: one model for each form of random strings, then
    the ordinary model and the same in capitals. `docs` holds texts `open`, without their base spans.

    Rare transitions lean on the source's share of the second character. The ordinary models mix their sources by ORDINARY.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    each = labelled(docs, strings).select("label", F.explode(pairs).alias("pair"), "n")
    rows = each.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # at most 5 x 64 x 64
    known = [(r["label"], *r["pair"], r["n"]) for r in rows if set(r["pair"]) <= set(ALPHABET)]
    same, capitals = (lambda c: c), str.upper
    models = [_shares(known, f, same) for f in FORMS]
    models += [_mixed(_shares(known, WORD, case), _shares(known, IDENTIFIER, case)) for case in (same, capitals)]
    return [[math.log(x) for row in m for x in row] for m in models]


def _shares(known: list[tuple], label: int, case) -> list[list[float]]:
    at, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    table = [[0.0] * n for _ in range(n)]
    for own, a, b, many in known:
        if own == label:
            table[at[case(a)]][at[case(b)]] += many
    share = [sum(row[j] for row in table) + 0.5 for j in range(n)]
    share = [x / sum(share) for x in share]
    return [[(row[j] + BACK_OFF * share[j]) / (sum(row) + BACK_OFF) for j in range(n)] for row in table]


def _mixed(words: list[list[float]], names: list[list[float]]) -> list[list[float]]:
    n, of = len(ALPHABET), [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in ALPHABET]
    size = [of.count(k) for k in range(4)]
    both = [[(w + m) / 2 for w, m in zip(a, b, strict=True)] for a, b in zip(words, names, strict=True)]
    by_class = [[sum(both[i][j] for i in range(n) if of[i] == k for j in range(n) if of[j] == m) / size[k] / size[m] for m in range(4)] for k in range(4)]
    w, m, c = ORDINARY
    return [[w * words[i][j] + m * names[i][j] + c * by_class[of[i]][of[j]] + (1 - w - m - c) / n for j in range(n)] for i in range(n)]


def _added(steps: Column, table: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.element_at(table, k))


def ratio(piece: Column, models: list[list[float]]) -> Column:
    """Log-likelihood ratio of a string over ALPHABET, of the likeliest random form to the likelier ordinary model; 0 for fewer than two characters."""
    n = len(ALPHABET)
    places = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def sums(steps: Column) -> list[Column]:
        tables = [F.expr(f"cast(split('{','.join(f'{x:.5f}' for x in m)}', ',') as array<double>)") for m in models]  # folded to literals
        return [_added(steps, t) for t in tables]

    def moves(p: Column) -> Column:
        many = F.size(p) - 1
        return F.zip_with(F.slice(p, F.lit(1), many), F.slice(p, F.lit(2), many), lambda a, b: (a - 1) * n + b)

    def compared(steps: Column) -> Column:
        every = sums(steps)
        return F.greatest(*every[: len(FORMS)]) - F.greatest(*every[len(FORMS) :])

    return F.when(F.length(piece) > 1, bound(bound(places, moves), compared)).otherwise(F.lit(0.0))


def stretches(run: Column, models: list[list[float]], threshold: float) -> Column:
    """Array of (start, end) in a run: pieces in a row whose ratios add up to `threshold` at least, of LEAST characters or more.

    A sum starts at a piece that raises it over 0. A stretch ends where its sum was greatest, once the
    sum has fallen to 0 or by DROP from there; the next starts after the piece that ended it.
    """
    pieces = F.transform(F.split(run, SEPARATORS, -1), lambda p: F.struct(ratio(p, models).alias("x"), F.length(p).alias("n")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), none.alias("out"))

    def closed(s: Column) -> Column:
        good = (s["best"] >= threshold) & (s["end"] - s["start"] >= LEAST)
        return F.when(good, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        total, end = s["sum"] + p["x"], s["at"] + p["n"]
        over = total <= F.greatest(F.lit(0.0), s["best"] - DROP)
        best = total > s["best"]
        return F.struct(
            (end + 1).alias("at"),
            F.when(over, F.lit(0.0)).otherwise(total).alias("sum"),
            F.when(over, end + 1).otherwise(s["start"]).alias("start"),
            F.when(over, F.lit(0.0)).when(best, total).otherwise(s["best"]).alias("best"),
            F.when(over, end + 1).when(best, end).otherwise(s["end"]).alias("end"),
            F.when(over, closed(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(pieces, start, step, closed)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, base and all spans as arrays of (start, kind, end), kind an index of KINDS.

    Null text equals empty text and has no spans. Repeated rows give repeated answers; an empty
    table trains on generated strings alone and gives no rows; further columns are ignored. Base spans
    stay; what they cover is blanked, and the runs of what is left are searched for random stretches.
    """
    t = F.col("t")
    base = F.concat(spans(t, ASSIGN, 0, ASSIGN_LEAST), spans(t, ACCESS, 1), spans(t, HEX, 2))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).withColumn("open", masked(t, ASSIGN, ASSIGN_LEAST))
    for pattern in (ACCESS, HEX):
        found = found.withColumn("open", masked(F.col("open"), pattern, 0))
    models = train(found.select("open"))
    found = found.select("doc_id", base.alias("base"), spans(F.col("open"), CANDIDATE, 3).alias("runs"))
    own = lambda r: F.transform(stretches(r["value"], models, threshold), lambda x: F.struct((r["start"] + x["start"]).alias("start"), F.lit(3).alias("kind"), (r["start"] + x["end"]).alias("end")))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", F.array_sort(bare).alias("base"), F.array_sort(F.concat(bare, F.flatten(F.transform("runs", own)))).alias("all"))


def written_out(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            array, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
        ),
        ",",
    )


def digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of base spans per kind, the base spans' digest and all spans as text."""
    found = scan(docs, threshold)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(written_out(F.col("base")), 256).alias("base_sha256"),
        written_out(F.col("all")).alias("spans"),
    )
