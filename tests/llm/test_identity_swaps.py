"""Twins of labelled texts stay within one language, and the penalty spares neutral mentions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomlight.llm import linear, toxicity


@pytest.mark.parametrize(
    "lang, text, changed",
    [
        ("en", "The gay Muslim and the atheist protestant were here.", 4),
        ("fr", "Les femmes et les protestants sont dans la ville.", 2),
        ("de", "Die Frauen und der Muslim sind nicht hier, ein Christ ist da.", 3),
        ("es", "El protestante y las mujeres son de la ciudad.", 2),
    ],
)
def test_twins_do_not_mix_languages(lang, text, changed):
    own = {t for line in toxicity.IDENTITIES[lang] for t in line.split()}
    before = text.rstrip(".").replace(",", "").split()
    seen = set()
    for step in toxicity.STEPS:
        after = toxicity.swapped(text, step).rstrip(".").replace(",", "").split()
        new = [b for a, b in zip(before, after, strict=True) if a != b]
        assert len(new) == changed and set(new) <= own
        seen.update(new)
    assert len(seen) > changed


def test_words_of_two_languages_follow_the_text():
    assert toxicity.swapped("the hindus and the buddhists") == "the buddhists and the atheists"
    assert toxicity.swapped("die hindus und die buddhisten") == "die buddhisten und die atheisten"
    assert toxicity.swapped("") is None and toxicity.swapped("nothing of the kind") is None


@pytest.mark.parametrize("line", [line.split() for lines in toxicity.IDENTITIES.values() for line in lines])
def test_no_step_ends_at_the_term_itself(line):
    lang = next(k for k, lines in toxicity.IDENTITIES.items() if " ".join(line) in lines)
    text = " ".join([line[0], *toxicity.FREQUENT[lang].split()])
    for step in range(1, 2 * len(line)):
        assert toxicity.swapped(text, step).split()[0] != line[0]


def test_the_penalty_lowers_false_alarms_on_neutral_mentions():
    r = random.Random(8)
    said = [f"word{i}" for i in range(40)]
    line = lambda: " ".join(r.choice(said) for _ in range(8))
    # Toxic texts name one group much more often than calm ones do, and hold a slur in six of ten.
    texts = [f"the women are {'vermin' if r.random() < 0.6 else 'here'} and {line()}" for _ in range(200)]
    groups = toxicity.IDENTITIES["en"][0].split()
    texts += [f"the {r.choice(groups)} are here and {line()}" for _ in range(300)]
    label = np.array([1.0] * 200 + [0.0] * 300)
    rows = toxicity.features(pa.array(texts))
    codes = linear.choose(rows, label, 200)
    twins = [(i, s) for step in toxicity.STEPS for i, t in enumerate(texts) if (s := toxicity.swapped(t, step)) is not None]
    at, other = np.array([i for i, _ in twins]), toxicity.features(pa.array([s for _, s in twins]))
    neutral = toxicity.features(pa.array([f"the women are here and {line()}" for _ in range(200)]))
    slurs = toxicity.features(pa.array([f"the men are vermin and {line()}" for _ in range(200)]))

    def alarms(model, of):
        return float((model.logits(linear.indexed(of, codes), 200) >= 0).mean())

    free = linear.fit(rows, label, codes)
    held = linear.fit(rows, label, codes, (at, other), twin_weight=5.0)
    assert alarms(held, neutral) < alarms(free, neutral) / 2 and alarms(held, slurs) > 0.9
