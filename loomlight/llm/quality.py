"""A co-trained quality classifier.

One view is a page's text: words, word shapes and repetition. The other is its metadata: language,
source, declared length, stored size and number of lines. Each round both are fitted, and each labels
every unlabelled document that it is confident of for the other. Those documents are added up in
Spark: by feature and label, which chooses features, and by label and the receiving view's own logit
into mean rows, which the next fit weighs by their numbers. The views are calibrated on labelled
documents that neither was fitted on, and combined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, slices, written
from loomlight.llm.linear import Model, Rows, chi_square, code, counted, fit, indexed, packed, platt, presence, sigmoid, unpacked, weight, words_in
from loomlight.ship import map_arrow

#: Labelled rows that the fit uses at most, in expectation; features kept; rounds. Unlabelled rows all take part.
SAMPLE, FEATURES, ROUNDS = 6000, 3000, 3
#: Confidence that a label is passed on with; weight of all labels passed on of a class, at most, as a share of the labelled rows.
CONFIDENT, SHARE = 0.95, 0.1
#: Mean rows stand for documents of one label and one logit of the receiving view, rounded within this bound; parts of 1 in sums, which are exact.
LOGITS, PARTS = 8, 1 << 20
#: Most that each view's calibrated logit may say; metadata alone must not outweigh a clear text.
TEXT_MOST, META_MOST = 8.0, 2.0

DENSE_TEXT, DENSE_META = 3, 4


def shapes(words: pa.Array) -> pa.Array:
    """Words with two capitals in a row as C, other letters as a, digits as 0, with the marks between them; 12 characters at most."""
    for pattern, to in ((r"\p{L}*\p{Lu}\p{Lu}\p{L}*", "\x01"), (r"[\p{L}\p{M}]+", "a"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, to)
    return pc.utf8_slice_codeunits(pc.replace_substring(words, "\x01", "C"), 0, 12)


def text_view(texts: pa.Array) -> Rows:
    """Words and shapes by share of the text; dense: distinct share, repeats of the word before, capitals' share."""
    own, index, row = words_in(texts)
    n = len(texts)
    if not len(row):
        none = np.zeros(0, np.int64)
        return Rows(none, none, np.zeros(0), np.zeros((n, DENSE_TEXT)))
    total = np.bincount(row, minlength=n)
    shape = shapes(own).dictionary_encode()
    word_code = np.array([code("w" + w) for w in pc.utf8_lower(own).to_pylist()], np.int64)
    shape_code = np.array([code("s" + s) for s in shape.dictionary.to_pylist()], np.int64)
    shape_of = shape.indices.to_numpy(zero_copy_only=False)[index]
    r1, c1, k1 = counted(row, word_code[index], 1 << 32)
    r2, c2, k2 = counted(row, shape_code[shape_of], 1 << 32)
    loud = pc.match_substring(shape.dictionary, "C").to_numpy(zero_copy_only=False)
    again = np.concatenate([[False], (index[1:] == index[:-1]) & (row[1:] == row[:-1])])
    some = np.maximum(1, total)
    dense = np.stack([np.bincount(r1, minlength=n) / some, np.bincount(row, again, n) / some, np.bincount(row, loud[shape_of], n) / some], 1)
    share = 4 * np.sqrt(k2 / some[r2])
    return Rows(np.concatenate([r1, r2]), np.concatenate([c1, c2]), np.concatenate([0.25 * weight(k1), share]), dense)


def meta_view(batch: pa.RecordBatch) -> Rows:
    """Language and source; dense: log of declared length, of stored size, of lines, and whether the declared length is the real one. No words."""
    n = batch.num_rows
    col = np.array(
        [
            [code(f"lang={a}"), code(f"source={b}")] for a, b in zip(
                batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True
            )
        ],
        np.int64,
    ).reshape(n, 2)
    text = pc.fill_null(batch.column("text").cast(pa.string()), "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(float)
    lines = pc.count_substring(text, "\n").to_numpy(zero_copy_only=False) + 1.0
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(float)
    said = pc.fill_null(batch.column("n_chars").cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    dense = np.stack([np.log1p(np.maximum(0, said)) / 5, np.log1p(size) / 5, np.log1p(lines) / 5, (said != chars).astype(float)], 1)
    return Rows(np.repeat(np.arange(n), 2), col.ravel(), np.full(2 * n, 0.3), dense)


@dataclass
class CoModel:
    """Both views, their calibration (slope, offset) and their weights in the combined logit."""

    text: Model
    meta: Model
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    mix: tuple[float, float, float]
    #: For each exchange, the documents labelled 1 and 0 for the text view, then for the metadata view.
    acted: list[list[tuple[int, int]]] = field(default_factory=list)

    def logits(self, text: Rows, meta: Rows, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_fit[0] * self.text.logits(text, n) + self.text_fit[1]
        b = self.meta_fit[0] * self.meta.logits(meta, n) + self.meta_fit[1]
        a, b = np.clip(a, -TEXT_MOST, TEXT_MOST), np.clip(b, -META_MOST, META_MOST)
        return a, b, self.mix[0] * a + self.mix[1] * b + self.mix[2]


def _only(rows: Rows, codes: np.ndarray) -> Rows:
    """The entries whose code is among sorted `codes`."""
    near = indexed(rows, codes)
    return Rows(near.row, codes[near.col] if len(codes) else near.col, near.value, near.dense)


def _columns(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and metadata, and `more`; metadata columns that are absent count as null."""
    have = set(docs.columns)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*((F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()), *more)


def _sampled(rows: DataFrame, key: str, most: int, salt: int) -> DataFrame:
    part = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < int(math.ceil(part * 1_000_000)))


def _stored(rows: DataFrame) -> DataFrame:
    """Both views of `rows`, packed and written: doc_id, label, and entries and dense columns of each view."""

    def run(batches):
        claim("quality")
        for batch in slices(batches, 4 << 20):
            out = [batch.column("doc_id"), batch.column("label")]
            for view in (text_view(batch.column("text")), meta_view(batch)):
                out += [pa.array(packed(view, batch.num_rows), pa.binary()), pa.array([x.tobytes() for x in view.dense], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "label", "text", "text_dense", "meta", "meta_dense"])

    return written(map_arrow(rows, run, STORED))


STORED = "doc_id long, label double, text binary, text_dense binary, meta binary, meta_dense binary"


def _views(table) -> list[Rows]:
    return [
        unpacked(
            table.column(c).to_pylist(), np.frombuffer(b"".join(table.column(f"{c}_dense").to_pylist()), float).reshape(-1, k)
        ) for c, k in (("text", DENSE_TEXT), ("meta", DENSE_META))
    ]


def _fold(table) -> np.ndarray:
    """The labelled rows kept for calibration: a fifth, by a hash of doc_id."""
    ids = table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(5) == 0


@dataclass
class Giver:
    """A view as it labels documents for the other one: its model, its calibration, and whether it may give label 0 and 1."""

    model: Model
    fit: tuple[float, float]
    may: tuple[bool, bool]

    def labels(self, z: np.ndarray) -> np.ndarray:
        """1, 0, or NaN where it is not confident."""
        p = sigmoid(self.fit[0] * z + self.fit[1])
        return np.where((p >= CONFIDENT) & self.may[1], 1.0, np.where((1 - p >= CONFIDENT) & self.may[0], 0.0, np.nan))


def _giver(model: Model, z: np.ndarray, label: np.ndarray, least: int = 20) -> Giver:
    """Calibrated on rows that the model was not fitted on. A label is given only if it holds for enough of those that would get it."""
    out = Giver(model, platt(z, label), (True, True))
    given = out.labels(z)
    held = [(given == c).sum() >= least and (label[given == c] == c).mean() >= CONFIDENT for c in (0, 1)]
    return Giver(model, out.fit, (bool(held[0]), bool(held[1])))


def _given(table, views: list[Rows], givers: list[Giver] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each view its labels (NaN: none) and its own logits. Without givers: those of labelled rows; with them: what the other view is confident of."""
    n = table.num_rows
    if givers is None:
        label = np.where(_fold(table), np.nan, table.column("label").to_numpy(zero_copy_only=False))
        return [label, label], [np.zeros(n), np.zeros(n)]
    z = [g.model.logits(indexed(v, g.model.codes), n) for g, v in zip(givers, views, strict=True)]
    return [g.labels(x) for g, x in zip(givers[::-1], z[::-1], strict=True)], z


def _counts(rows: DataFrame, givers: list[Giver] | None) -> DataFrame:
    """view, code, and the documents of label 1 and 0 that have it; code -1 is had by all."""

    def run(batches):
        claim("quality")
        for batch in slices(batches, 4 << 20):
            views = _views(batch)
            labels, _ = _given(batch, views, givers)
            for i, (view, label) in enumerate(zip(views, labels, strict=True)):
                on = ~np.isnan(label)
                codes, a, b = presence(view.take(on), label[on])
                a, b = np.append(a, (label == 1).sum()), np.append(b, (label == 0).sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), i, np.int32)),
                        pa.array(np.append(codes, -1).astype(np.int64)),
                        pa.array(a.astype(np.int64)),
                        pa.array(b.astype(np.int64)),
                    ],
                    names=["view", "code", "a", "b"],
                )

    return map_arrow(rows, run, "view int, code long, a long, b long").groupBy("view", "code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _totals(counts: DataFrame) -> list[tuple[int, int]]:
    got = {r["view"]: (r["a"], r["b"]) for r in counts.where("code = -1").collect()}
    return [got.get(i, (0, 0)) for i in range(2)]


def _chosen(
    known: DataFrame, free: DataFrame | None, scale: list[tuple[float, float]], n: list[tuple[float, float]], most: int, least: int = 5
) -> list[np.ndarray]:
    """For each view, the codes that tell the classes apart best, by counts of labelled documents and weighted ones of the others."""
    both = known.select("view", "code", F.col("a").cast("double"), F.col("b").cast("double"), (F.col("a") + F.col("b")).alias("k"))
    out = []
    for i in range(2):
        one = both.where(F.col("view") == i)
        if free is not None:
            one = one.unionByName(
                free.where(F.col("view") == i).select(
                    "view",
                    "code",
                    (F.col("a") * scale[i][0]).alias("a"),
                    (F.col("b") * scale[i][1]).alias("b"),
                    (F.col("a") + F.col("b")).alias("k"),
                )
            )
        sums = one.where("code >= 0").groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("k").alias("k")).where(F.col("k") >= least)
        chi = F.round(chi_square(F.col("a"), F.col("b"), max(1.0, n[i][0]), max(1.0, n[i][1])), 9)
        best = sums.select("code", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "code").limit(most).select("code").toArrow()
        out.append(np.sort(best.column("code").to_numpy()).astype(np.int64))
    return out


def _means(free: DataFrame, givers: list[Giver], codes: list[np.ndarray], scale: list[tuple[float, float]]) -> list[tuple[Rows, np.ndarray, np.ndarray]]:
    """For each view, mean rows of all documents that got a label: over indices of `codes`, with labels and weights."""
    steps = 2 * LOGITS + 1
    wide = [len(c) + k + 1 for c, k in zip(codes, (DENSE_TEXT, DENSE_META), strict=True)]  # features, dense columns, number

    def run(batches):
        claim("quality")
        sums = [np.zeros(2 * steps * w) for w in wide]  # whole numbers, so their order does not matter
        for batch in slices(batches, 4 << 20):
            views = _views(batch)
            for i, (view, label, z) in enumerate(zip(views, *_given(batch, views, givers), strict=True)):
                on = ~np.isnan(label)
                part = indexed(view.take(on), codes[i])
                at = (label[on] * steps + np.rint(np.clip(z[on], -LOGITS, LOGITS)) + LOGITS).astype(np.int64) * wide[i]
                sums[i] += np.bincount(at[part.row] + part.col, np.rint(part.value * PARTS), len(sums[i]))
                for j, column in enumerate((*part.dense.T, np.full(len(at), 1 / PARTS))):
                    sums[i] += np.bincount(at + len(codes[i]) + j, np.rint(column * PARTS), len(sums[i]))
        for i, own in enumerate(sums):
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), i, np.int32)), pa.array(there), pa.array(own[there].astype(np.int64))],
                names=["view", "at", "n"],
            )

    got = map_arrow(free, run, "view int, at long, n long").groupBy("view", "at").agg(F.sum("n").alias("n")).toArrow()
    view, at, n = (got.column(c).to_numpy() for c in ("view", "at", "n"))
    out = []
    for i, w in enumerate(wide):
        table = np.zeros(2 * steps * w)
        table[at[view == i]] = n[view == i]
        table = table.reshape(2 * steps, w)
        some = np.flatnonzero(table[:, -1])
        number = table[some, -1]
        mean = table[some, :-1] / PARTS / number[:, None]
        row, col = np.nonzero(mean[:, : len(codes[i])])
        label = (some >= steps).astype(float)
        out.append((Rows(row, col, mean[row, col], mean[:, len(codes[i]) :]), label, number * np.where(label == 1, *scale[i])))
    return out


def _beside(x: Rows, y: Rows) -> Rows:
    return Rows(
        np.concatenate([x.row, y.row + len(x.dense)]),
        np.concatenate([x.col, y.col]),
        np.concatenate([x.value, y.value]),
        np.concatenate([x.dense, y.dense]),
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, most: int = FEATURES) -> CoModel:
    """Co-trains on about `sample` labelled rows at most, chosen by a hash of doc_id, and on all other rows without labels."""
    return _trained(docs, labels, sample, rounds, most)[0]


def _trained(docs: DataFrame, labels: DataFrame, sample: int, rounds: int, most: int) -> tuple[CoModel, DataFrame, DataFrame | None]:
    """The model, the documents it was fitted on (lid), and both views of all others; None if labels are of one class."""
    every = _columns(docs)
    use = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("lid"), F.col("quality").cast("double").alias("label"))
    use = written(_sampled(use, "lid", sample, 1))
    known = _stored(every.join(F.broadcast(use), F.col("doc_id") == F.col("lid")).drop("lid"))
    known_counts = written(_counts(known, None))
    n = _totals(known_counts)
    if min(n[0]) == 0:
        none = np.zeros(0, np.int64)
        flat = [Model(none, np.zeros(0), np.zeros(k), 2.0) for k in (DENSE_TEXT, DENSE_META)]
        return CoModel(flat[0], flat[1], (1.0, 0.0), (1.0, 0.0), (0.5, 0.5, 0.0)), use, None
    # Read in each round, so the views are taken once.
    free = _stored(every.join(F.broadcast(use), F.col("doc_id") == F.col("lid"), "left_anti").withColumn("label", F.lit(None).cast("double")))
    givers: list[Giver] = []
    acted = []
    for turn in range(rounds):
        scale, more, free_counts = [(0.0, 0.0)] * 2, None, None
        if turn:
            free_counts = written(_counts(free, givers))
            acted.append(_totals(free_counts))
            scale = [tuple(min(1.0, SHARE * sum(n[i]) / max(1, k)) for k in acted[-1][i]) for i in range(2)]
        total = [tuple(n[i][c] + scale[i][c] * (acted[-1][i][c] if turn else 0) for c in range(2)) for i in range(2)]
        codes = _chosen(known_counts, free_counts, scale, total, most)
        if turn:
            more = _means(free, givers, codes, scale)

        def only(batches, codes=codes):
            claim("quality")
            for batch in slices(batches, 4 << 20):
                a, b = (packed(_only(v, c), batch.num_rows) for v, c in zip(_views(batch), codes, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("label"),
                        pa.array(a, pa.binary()),
                        batch.column("text_dense"),
                        pa.array(b, pa.binary()),
                        batch.column("meta_dense"),
                    ],
                    names=["doc_id", "label", "text", "text_dense", "meta", "meta_dense"],
                )

        got = map_arrow(known, only, STORED).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "label", "text", "meta")])
        label, fold, views = got.column("label").to_numpy(), _fold(got), _views(got)
        models = []
        for i, view in enumerate(views):
            rows, own = indexed(view.take(~fold), codes[i]), label[~fold]
            weights = np.ones(len(own))
            if more is not None:
                rows, own, weights = _beside(rows, more[i][0]), np.concatenate([own, more[i][1]]), np.concatenate([weights, more[i][2]])
            models.append(fit(rows, own, codes[i], ready=True, weights=weights))
        # A few labelled rows, or such of one class, cannot be split: then all of them calibrate.
        held = fold if fold.sum() >= 20 and len(np.unique(label[fold])) == 2 else np.ones(len(label), bool)
        scores = [m.logits(indexed(v, m.codes), len(label))[held] for m, v in zip(models, views, strict=True)]
        givers = [_giver(m, z, label[held]) for m, z in zip(models, scores, strict=True)]
    both = np.stack([np.clip(g.fit[0] * z + g.fit[1], -x, x) for g, z, x in zip(givers, scores, (TEXT_MOST, META_MOST), strict=True)], 1)
    none = np.zeros(0, np.int64)
    m = fit(Rows(none, none, np.zeros(0), both / 4), label[held], none, l2=1.0)
    mix = (float(m.v[0]) / 4, float(m.v[1]) / 4, m.bias)
    models, fits = [g.model for g in givers], [g.fit for g in givers]
    return CoModel(models[0], models[1], fits[0], fits[1], mix, acted), use, free


SCORES = "doc_id long, score double, text_score double, meta_score double"


def _scored(rows: DataFrame, model: CoModel, views_of) -> DataFrame:
    share = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("quality")
        m = share.value
        for batch in slices(batches, 4 << 20):
            a, b = (indexed(v, own.codes) for v, own in zip(views_of(batch), (m.text, m.meta), strict=True))
            x, y, z = m.logits(a, b, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(sigmoid(v)) for v in (z, x, y))], names=["doc_id", "score", "text_score", "meta_score"]
            )

    return map_arrow(rows, run, SCORES)


def score(docs: DataFrame, model: CoModel) -> DataFrame:
    """doc_id, score, text_score and meta_score of every document, 0 to 1."""
    return _scored(_columns(docs), model, lambda batch: (text_view(batch.column("text")), meta_view(batch)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, score, text_score, meta_score, accepted (score >= threshold).

    Null text counts as empty, null or absent metadata as values of their own. Without two classes
    of labels everything is accepted. Repeated rows give repeated answers; an empty table gives none.
    """
    model, use, free = _trained(docs, labels, SAMPLE, ROUNDS, FEATURES)
    if free is None:
        rows = score(docs, model)
    else:  # the views of all but the fitted documents are there already
        fitted = docs.join(F.broadcast(use.select("lid").distinct()), F.col("doc_id").cast("long") == F.col("lid"), "left_semi")
        rows = _scored(free, model, _views).unionByName(score(fitted, model))
    return rows.withColumn("accepted", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are accepted, each by its own text and metadata, with their columns."""
    share = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        claim("quality")
        m = share.value
        for batch in slices(batches, 4 << 20):
            a, b = indexed(text_view(batch.column("text")), m.text.codes), indexed(meta_view(batch), m.meta.codes)
            good = sigmoid(m.logits(a, b, batch.num_rows)[0]) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("_row").filter(pa.array(good))], names=["_row"])

    rows = _columns(docs, F.struct(*docs.columns).alias("_row"))
    return map_arrow(rows, run, rows.select("_row").schema).select("_row.*")
