"""A counterfactually regularised toxicity classifier.

Features are the words of a text and their first letters, so that inflected and compounded slurs
share weights. In labelled texts that name a group, identity terms are swapped for others of their
list in the text's language; a penalty on the change of the score keeps neutral mentions from carrying weight.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.common import claim, slices, written
from loomlight.llm.linear import Model, Rows, choose_from, code, counted, fit, packed, sigmoid, stems, unpacked, weight, words_in
from loomlight.ship import map_arrow

# Identity terms, by language and form; a term is swapped for others of its line.
IDENTITIES = {
    "en": [
        "women men muslims christians jews hindus buddhists atheists immigrants refugees gays lesbians blacks whites asians africans arabs latinos europeans americans elderly teenagers disabled blind deaf catholics protestants",
        "woman man muslim christian jew hindu buddhist atheist immigrant refugee lesbian teenager catholic protestant",
        "female male jewish islamic gay straight transgender black white asian african arab latino european american",
    ],
    "fr": [
        "femmes hommes musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés homosexuels lesbiennes noirs blancs asiatiques africains arabes européens américains vieillards handicapés aveugles sourds catholiques protestants",
        "femme homme musulman chrétien juif hindou bouddhiste athée immigré réfugié homosexuel lesbienne noir blanc asiatique africain arabe européen américain vieillard handicapé aveugle sourd catholique protestant",
    ],
    "de": [
        "frauen männer muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge schwule lesben schwarze weiße asiaten afrikaner araber europäer amerikaner senioren behinderte blinde gehörlose katholiken protestanten",
        "frau mann muslim christ jude buddhist atheist flüchtling lesbe asiat katholik protestant",
        "muslimisch christlich jüdisch buddhistisch schwul lesbisch asiatisch afrikanisch arabisch europäisch amerikanisch katholisch protestantisch",
    ],
    "es": [
        "mujeres hombres musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados gais lesbianas negros blancos asiáticos africanos árabes europeos americanos ancianos discapacitados ciegos sordos católicos protestantes",
        "mujer hombre musulmán cristiano judío hindú budista ateo inmigrante refugiado gay lesbiana negro blanco asiático africano árabe europeo americano anciano discapacitado ciego sordo católico protestante",
    ],
}

#: Labelled rows that the fit uses at most, in expectation; and features kept.
SAMPLE, FEATURES = 8000, 6000

#: Frequent words that tell the languages apart.
FREQUENT = {
    "en": "the and of is are was were that this with for not they have has it in to",
    "fr": "le la les et des du une est sont dans pour pas ils elles avec qui que ce",
    "de": "der die das und ist sind nicht mit für ein eine den dem auf zu sie wir war",
    "es": "el los las y del una es son en para no ellos con que por lo se su",
}
#: Steps along a line from a term to those that stand in for it: a text has one twin for each.
STEPS = (1, 2, 5, 11)

_WORD = re.compile(r"\w+")
#: By language, a term's line and place; a term of several lines has the first.
_PLACES = {lang: {t: (line.split(), i) for line in reversed(lines) for i, t in enumerate(line.split())} for lang, lines in IDENTITIES.items()}
_FREQUENT = {lang: set(words.split()) for lang, words in FREQUENT.items()}


def language_of(words: list[str]) -> str | None:
    """The language most of whose terms and frequent words are among lower-case `words`, of those that have a term there; ties to the first listed."""
    has = [lang for lang, places in _PLACES.items() if any(w in places for w in words)]
    return max(has, key=lambda lang: sum(w in _PLACES[lang] or w in _FREQUENT[lang] for w in words), default=None)


def swapped(text: str, step: int = 1) -> str | None:
    """The text with every identity term of its language replaced by the one `step` further in its line, or None if it has none.

    Steps go round and never end at the term itself.
    """
    lang = language_of([w.lower() for w in _WORD.findall(text)])
    if lang is None:
        return None

    def other(m: re.Match) -> str:
        line, i = _PLACES[lang].get(m[0].lower(), ((), 0))
        return line[(i + 1 + (step - 1) % (len(line) - 1)) % len(line)] if line else m[0]

    return _WORD.sub(other, text)


def features(texts: pa.Array, known: dict[int, int] | None = None) -> Rows:
    """Rows over feature codes, or over indices of `known` codes; the dense column is the log of the length."""
    words, index, row = words_in(texts)
    own = words.to_pylist()
    if known is None:
        lists = [[code(f) for f in stems(w)] for w in own]
    else:
        lists = [[known[c] for f in stems(w) if (c := code(f)) in known] for w in own]
    k = np.array([len(x) for x in lists], np.int64)
    flat = np.array([c for x in lists for c in x], np.int64)
    start, many = (np.cumsum(k) - k)[index], k[index]
    total = int(many.sum())
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(total)
    r, c, n = counted(np.repeat(row, many), flat[at], 1 << 32)
    length = np.log1p(np.bincount(row, minlength=len(texts)))[:, None] / 5
    return Rows(r, c, weight(n), length)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, twin_weight: float = 1.0) -> Model:
    """Fits on at most about `sample` labelled rows, chosen by a hash of doc_id. Null labels and doc_ids are left out."""
    use = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("lid"), F.col("toxic").cast("double").alias("label"))
    n = use.count()
    part = min(1.0, sample / max(1, n))
    use = use.where(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(part * 1_000_000))

    # The sample is bounded, so it is the side to send round.
    chosen = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text"
        ).join(F.broadcast(use), F.col("doc_id") == F.col("lid")).select("text", "label")
    )
    codes = choose_from(chosen, lambda batch: features(batch.column("text")), most)
    known = {int(c): i for i, c in enumerate(codes)}

    def run(batches):
        claim("toxicity")
        for batch in slices(batches, 2 << 20):
            plain = features(batch.column("text"), known)
            blobs = packed(plain, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    pa.array(blobs, pa.binary()),
                    pa.array([None] * batch.num_rows, pa.binary()),
                    pa.array(plain.dense[:, 0]),
                ],
                names=["label", "entries", "twin", "length"],
            )
            texts = batch.column("text").to_pylist()
            for step in STEPS:
                other = [swapped(x or "", step) for x in texts]
                has = [i for i, x in enumerate(other) if x is not None]
                if not has:
                    break
                twins = packed(features(pa.array([other[i] for i in has]), known), len(has))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").take(pa.array(has)),
                        pa.array([blobs[i] for i in has], pa.binary()),
                        pa.array(twins, pa.binary()),
                        pa.array(plain.dense[has, 0]),
                    ],
                    names=["label", "entries", "twin", "length"],
                )

    got = map_arrow(chosen, run, "label double, entries binary, twin binary, length double").toArrow()
    label, length = got.column("label").to_numpy(), got.column("length").to_numpy()[:, None]
    if not len(label):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(1), -3.0)
    twins = got.column("twin").to_pylist()
    at = np.array([i for i, x in enumerate(twins) if x is not None], np.int64)
    rows = unpacked(got.column("entries").to_pylist(), length)
    return fit(rows, label, codes, (at, unpacked([twins[i] for i in at], length[at])), twin_weight=twin_weight, ready=True)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, of every whole text. Null and empty texts get the score of no words."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("toxicity")
        m = share.value
        known = {int(c): i for i, c in enumerate(m.codes)}
        for batch in slices(batches, 2 << 20):
            rows = features(batch.column("text"), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(m.logits(rows, batch.num_rows)))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def held_out(doc_id):
    """Rows never learnt from: crc32 of doc_id as text, modulo 5, is 0. A row without doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learns only from rows that are not held out.

    Without usable labels every score is that of a rare class. Repeated rows give repeated answers;
    an empty table gives no rows; further columns are ignored.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), sample)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
