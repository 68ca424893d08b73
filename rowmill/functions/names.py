"""Identifier rules for tables and columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OTHER = re.compile(r"[^a-z0-9]+")
# Between a small letter or digit and a capital, and before the last capital of a run that a small letter follows.
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def snake(name: str, fallback: str = "column") -> str:
    """Lower-case name with every other run of characters as one underscore; ``OrderID`` is ``order_id``."""
    return _OTHER.sub("_", _HUMP.sub("_", name).lower()).strip("_") or fallback


def plural(name: str) -> str:
    """English plural for table names; already plural names stay."""
    if name.endswith("s") and not name.endswith("ss"):
        return name
    if name.endswith("y") and name[-2:-1] not in "aeiou":
        return name[:-1] + "ies"
    if name.endswith(("ss", "x", "z", "ch", "sh")):
        return name + "es"
    return name + "s"


# Plurals that do not follow the endings, and words whose singular ends in a silent e or in s.
_IRREGULAR = {
    "people": "person", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "feet": "foot",
    "teeth": "tooth", "geese": "goose", "indices": "index", "vertices": "vertex", "matrices": "matrix",
    "analyses": "analysis", "crises": "crisis", "criteria": "criterion",
}
_UNCHANGED = ("series", "species", "news", "sheep")
_ENDS_IN_IE = ("movie", "cookie", "calorie", "zombie", "selfie", "rookie", "brownie", "smoothie", "tie", "pie", "lie")
_ENDS_IN_CHE = ("cache", "niche", "ache", "avalanche", "cliche")
_ENDS_IN_USE = ("house", "cause", "clause", "pause", "excuse", "spouse", "use", "fuse", "muse")


def _last_word(name: str, words: Iterable[str], ending: str = "") -> str | None:
    """The word of the list that, with the ending, is the last word of a name."""
    last = name.rsplit("_", 1)[-1]
    # Compounds are written together too (warehouse); a short word must be the whole last word.
    return next((w for w in words if last == w + ending or (len(w) > 4 and last.endswith(w + ending))), None)


def singular(name: str) -> str:
    """Inverse of :func:`plural`, also for irregular words; compound names change in their last word."""
    head, sep, last = name.rpartition("_")
    if last in _IRREGULAR:
        return head + sep + _IRREGULAR[last]
    if last in _UNCHANGED:
        return name
    if _last_word(name, (*_ENDS_IN_IE, *_ENDS_IN_CHE, *_ENDS_IN_USE), "s"):
        return name[:-1]
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith(("sses", "xes", "zzes", "ches", "shes", "uses")):
        return name[:-2]
    return name[:-1] if name.endswith("s") and not name.endswith(("ss", "us", "is")) else name


def slug(c: Column, fallback: str = "project", max_len: int = 32) -> Column:
    """Column form of the name rule, cut to ``max_len``."""
    text = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.substring(F.when(text == "", F.lit(fallback)).otherwise(text), 1, max_len)


def normalized(df: DataFrame) -> DataFrame:
    """Frame with snake-case column names; clashes get a numeric suffix."""
    names: list[str] = []
    for raw in df.columns:
        base = name = snake(raw)
        copy = 1
        while name in names:
            copy += 1
            name = f"{base}_{copy}"
        names.append(name)
    return df.toDF(*names)
