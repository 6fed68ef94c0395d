"""Sparse logistic models fitted on the driver from a bounded sample, and applied batch by batch."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct white-space words of a batch, each occurrence's index among them, and its row."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    own = coded.dictionary
    index, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
    if (none := pc.index(own, "").as_py()) >= 0:
        real = index != none
        index, row = index[real], row[real]
    return own, index, row


def stems(word: str) -> list[str]:
    """The letter runs of a word in lower case, whole and by their first 4 to 7 letters."""
    out = []
    for w in _LETTERS.findall(word.lower()):
        out.append("=" + w)
        out += [w[:k] for k in range(4, min(8, len(w) + 1))]
    return out


def code(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature)


def counted(row: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their counts."""
    keys, n = np.unique(row * np.int64(size) + feature, return_counts=True)
    return keys // size, keys % size, n


def weight(n: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + np.minimum(n, 15))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """A sparse matrix by entries, and dense columns beside it."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    dense: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        """The rows where `keep` is true, renumbered."""
        number = np.cumsum(keep) - 1
        own = keep[self.row]
        return Rows(number[self.row[own]], self.col[own], self.value[own], self.dense[keep])


def presence(rows: Rows, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch with the numbers of its rows of label 1 and 0 that have them."""
    codes, col = np.unique(rows.col, return_inverse=True)
    return codes, np.bincount(col, label[rows.row] == 1, len(codes)), np.bincount(col, label[rows.row] == 0, len(codes))


def chi_square(a, b, n1: float, n0: float):
    """How well presence in a of n1 and b of n0 rows tells the classes apart; for numbers, arrays or columns."""
    p = (a + b) / (n1 + n0)
    return (a / n1 - b / n0) * (a / n1 - b / n0) / (p * (1 - p) + 1e-9) * (n1 * n0 / (n1 + n0))


def choose(rows: Rows, label: np.ndarray, most: int, least: int = 3) -> np.ndarray:
    """The features, by code, that tell the classes apart best by chi-square of presence."""
    codes, a, b = presence(rows, label)
    chi = chi_square(a, b, max(1, (label == 1).sum()), max(1, (label == 0).sum()))
    chi[a + b < least] = -1
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(codes[best[chi[best] > 0]])


def choose_from(docs, rows_of, most: int, least: int = 3) -> np.ndarray:
    """choose() over labelled `docs` (a column `label`) without bringing their entries together: counts meet in Spark, and at most `most` codes reach the driver. `rows_of` gives the Rows of a batch."""
    from pyspark.sql import functions as F

    from loomlight.llm.common import slices
    from loomlight.ship import map_arrow

    def run(batches):
        for batch in slices(batches, 2 << 20):
            label = batch.column("label").to_numpy(zero_copy_only=False)
            codes, a, b = presence(rows_of(batch), label)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.astype(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["code", "a", "b"]
            )

    n = docs.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).collect()[0]
    n1, n0 = float(max(1, n["n1"])), float(max(1, n["n0"]))
    counts = map_arrow(docs, run, "code long, a long, b long").groupBy("code").agg(
        F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")
    ).where(F.col("a") + F.col("b") >= least)
    chi = chi_square(F.col("a"), F.col("b"), n1, n0)
    best = counts.select("code", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "code").limit(most).select("code").toArrow()
    return np.sort(best.column("code").to_numpy())


@dataclass
class Model:
    codes: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def logits(self, rows: Rows, n: int) -> np.ndarray:
        """Over rows whose `col` is an index into `codes`."""
        return np.bincount(rows.row, self.w[rows.col] * rows.value, n) + rows.dense @ self.v + self.bias


def indexed(rows: Rows, codes: np.ndarray) -> Rows:
    """`col` as indices into sorted `codes`; other entries go."""
    if not len(codes):
        none = np.zeros(0, np.int64)
        return Rows(none, none, np.zeros(0), rows.dense)
    at = np.minimum(np.searchsorted(codes, rows.col), len(codes) - 1)
    own = codes[at] == rows.col
    return Rows(rows.row[own], at[own], rows.value[own], rows.dense)


def fit(
    rows: Rows,
    label: np.ndarray,
    codes: np.ndarray,
    twins: tuple[np.ndarray, Rows] | None = None,
    l2: float = 0.02,
    twin_weight: float = 1.0,
    steps: int = 300,
    rate: float = 0.1,
    ready: bool = False,
    weights: np.ndarray | None = None,
) -> Model:
    """Logistic regression by Adam. `twins`: row numbers and their counterfactual rows; squared differences of logits are penalised. `ready`: columns are indices into `codes` already. `weights`: of the rows, 1 unless given."""
    x, n = rows if ready else indexed(rows, codes), len(label)
    own = np.ones(n) if weights is None else weights
    total, ones = max(1.0, float(own.sum())), float((own * label).sum())
    m = Model(codes, np.zeros(len(codes)), np.zeros(rows.dense.shape[1]), float(np.log((ones + 1) / (float(own.sum()) - ones + 1))))
    t = (twins[1] if ready else indexed(twins[1], codes)) if twins is not None and len(twins[0]) else None
    moments = [[np.zeros_like(z), np.zeros_like(z)] for z in (m.w, m.v, np.zeros(1))]
    for step in range(1, steps + 1):
        z = m.logits(x, n)
        g = own * (sigmoid(z) - label) / total
        grads = [np.bincount(x.col, g[x.row] * x.value, len(codes)).astype(float), x.dense.T @ g, np.array([g.sum()])]
        if t is not None:
            k = len(twins[0])
            d = 2 * twin_weight * (z[twins[0]] - m.logits(t, k)) / k
            back = np.zeros(n)
            np.add.at(back, twins[0], d)
            grads[0] += np.bincount(x.col, back[x.row] * x.value, len(codes)) - np.bincount(t.col, d[t.row] * t.value, len(codes))
            grads[1] += x.dense.T @ back - t.dense.T @ d
        grads[0] += l2 / total * m.w
        grads[1] += l2 / total * m.v
        deltas = []
        for grad, (a, b) in zip(grads, moments, strict=True):
            a[:] = 0.9 * a + 0.1 * grad
            b[:] = 0.999 * b + 0.001 * grad * grad
            deltas.append(rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        m.w -= deltas[0]
        m.v -= deltas[1]
        m.bias -= float(deltas[2][0])
    return m


def platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate logits on held-out labels."""
    none = np.zeros(0, np.int64)
    if len(label) < 20 or len(np.unique(label)) < 2:
        return 1.0, 0.0
    scale = max(1e-6, float(np.abs(logit).mean()))
    m = fit(Rows(none, none, np.zeros(0), (logit / scale)[:, None]), label, none, l2=0.3, steps=1000)
    return float(m.v[0]) / scale, m.bias


def packed(rows: Rows, n: int) -> list[bytes]:
    """Each row's entries as bytes, for the way to the driver."""
    order = np.argsort(rows.row, kind="stable")
    cut = np.searchsorted(rows.row[order], np.arange(n + 1))
    col, value = rows.col[order].astype("<u4"), rows.value[order].astype("<f4")
    return [col[a:b].tobytes() + value[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def unpacked(blobs: list[bytes], dense: np.ndarray) -> Rows:
    k = np.array([len(b) // 8 for b in blobs], np.int64)
    col = [np.frombuffer(b, "<u4", n) for b, n in zip(blobs, k.tolist(), strict=True)]
    value = [np.frombuffer(b, "<f4", n, 4 * n) for b, n in zip(blobs, k.tolist(), strict=True)]
    none = [np.zeros(0)]
    return Rows(np.repeat(np.arange(len(k)), k), np.concatenate(col or none).astype(np.int64), np.concatenate(value or none).astype(float), dense)
