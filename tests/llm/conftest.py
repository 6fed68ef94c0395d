import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, recipe string, unit string, shard string, key string"


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, blanks, a very long text, odd characters and repeated rows."""
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "re") for b in ("nor", "vel", "sun", "kip") for c in ("a", "en", "os")]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    out, passage = [], line(60)
    for i in range(30):
        out.append((i, line(r.choice([1, 2, 5, 20, 80, 200])).capitalize() + "."))
    for i in range(30, 40):
        out.append((i, f"{line(30)} {passage} {line(20)}"))
    base = line(120).split()
    for i in range(40, 52):
        own = list(base)
        own[r.randrange(len(own))] = f"x{i}"
        out.append((i, " ".join(own)))
    out += [
        (52, out[3][1]),
        (53, out[3][1].upper()),
        (54, None),
        (55, ""),
        (56, " \n\t"),
        (57, line(9000)),
        (58, "Ünïcödé ß İ 𝒳 'S don't \x00 tab\tend"),
        (59, out[57][1] if len(out) > 57 else ""),
        (60, out[35][1]),
        (60, out[35][1]),
    ]
    out.append((None, line(40)))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "r", "u", "s", "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
