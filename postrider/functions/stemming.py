"""English stems by the published Porter2 rules, over distinct words only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the rules: letters, endings by step, and words that are exceptions.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STARTS = ("gener", "commun", "arsen")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_AFTER = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where the parts begin that endings must lie in."""

    def after(start: int) -> int:
        m = _AFTER.search(word, start)
        return m.end() if m else len(word)

    first = next((len(s) for s in STARTS if word.startswith(s)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return bool(re.fullmatch(r"[aeiouy][^aeiouy]", word))
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than English ones go by the same rules."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w in WHOLE:
        return WHOLE[w]
    one, two = _regions(w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w

    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= one:
            w = w[: len(w) - len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= one and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"

    end = _longest(w, SECOND)
    if end and len(w) - len(end) >= one:
        rest = w[: -len(end)]
        if (end != "ogi" or rest.endswith("l")) and (end != "li" or rest[-1:] in tuple(BEFORE_LI)):
            w = rest + SECOND[end]
    end = _longest(w, THIRD)
    if end and len(w) - len(end) >= (two if end == "ative" else one):
        w = w[: -len(end)] + THIRD[end]
    end = _longest(w, FOURTH)
    if end and len(w) - len(end) >= two and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= two or (len(w) - 1 >= one and not _ends_short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) of the distinct words of a column; null has none."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(stem=[stem(w) for w in f["word"]])

    distinct = words.selectExpr(f"`{column}` AS word").filter("word IS NOT NULL").distinct()
    return distinct.mapInPandas(of, "word string, stem string")
