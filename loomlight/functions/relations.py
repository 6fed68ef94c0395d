"""Kinship words: the relation a question asks for, and the labels of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation patterns in order, the first that matches wins (pattern, relation, gender).
PATTERNS = [
    (r"\bgrand ?father\b", "grandparent", "male"),
    (r"\bgrand ?mother\b", "grandparent", "female"),
    (r"\bgrand ?parents?\b", "grandparent", None),
    (r"\bgrand ?sons?\b", "grandchild", "male"),
    (r"\bgrand ?daughters?\b", "grandchild", "female"),
    (r"\bgrand ?child(ren)?\b", "grandchild", None),
    (r"\bancestors?|ancestry|forebears?|descended from\b", "ancestor", None),
    (r"\bdescend(ants?|ed)\b", "descendant", None),
    (r"\bfather\b|\bsire\b", "parent", "male"),
    (r"\bmother\b", "parent", "female"),
    (r"\bparents?|parentage|born to\b", "parent", None),
    (r"\bsons?\b", "child", "male"),
    (r"\bdaughters?\b", "child", "female"),
    (r"\bchild(ren)?|issue|offspring\b", "child", None),
    (r"\bwi(fe|ves)\b", "spouse", "female"),
    (r"\bhusbands?\b", "spouse", "male"),
    (r"\bspouses?|married to|wed(ded)?|consort\b", "spouse", None),
    (r"\bbrothers?\b", "sibling", "male"),
    (r"\bsisters?\b", "sibling", "female"),
    (r"\bsiblings?\b", "sibling", None),
]

# Fixed values: (male, female, any) for each relation; group plurals.
LABELS = {
    "parent": ("father", "mother", "parent"),
    "child": ("son", "daughter", "child"),
    "spouse": ("husband", "wife", "spouse"),
    "sibling": ("brother", "sister", "sibling"),
    "grandparent": ("grandfather", "grandmother", "grandparent"),
    "grandchild": ("grandson", "granddaughter", "grandchild"),
    "ancestor": ("ancestor", "ancestor", "ancestor"),
    "descendant": ("descendant", "descendant", "descendant"),
}
PLURALS = {"child": "children", "wife": "wives", "grandchild": "grandchildren"}


def detect(normalized: Column) -> Column:
    """STRUCT<rel, gender> of a normalised question, or null."""
    padded, out = F.concat(F.lit(" "), normalized, F.lit(" ")), None
    for pattern, rel, gender in PATTERNS:
        value = F.struct(F.lit(rel).alias("rel"), F.lit(gender).cast("string").alias("gender"))
        out = F.when(padded.rlike(pattern), value) if out is None else out.when(padded.rlike(pattern), value)
    return out


def label(rel: Column, gender: Column) -> Column:
    """The label by the object's gender; an unknown gender takes the general one, an unknown relation itself."""
    out = None
    for name, (male, female, any_) in LABELS.items():
        own = F.when(gender == "male", male).when(gender == "female", female).otherwise(any_)
        out = F.when(rel == name, own) if out is None else out.when(rel == name, own)
    return out.otherwise(rel)


def plural(word: Column) -> Column:
    out = None
    for one, many in PLURALS.items():
        out = F.when(word == one, many) if out is None else out.when(word == one, many)
    return out.otherwise(F.concat(word, F.lit("s")))
