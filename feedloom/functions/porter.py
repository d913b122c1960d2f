"""The suffix-stripping stemmer of Porter (1980), applied to distinct terms only."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The suffix rules of the published algorithm, by step; longest match first within a step.
_STEP2 = """ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous,
 ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble,
 logi log"""
_STEP3 = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    rules = [tuple(r.split()) for r in text.split(",")]
    return sorted(((a, "" if b == "-" else b) for a, b in rules), key=lambda r: -len(r[0]))


_RULES2, _RULES3 = _pairs(_STEP2), _pairs(_STEP3)
_ENDINGS4 = sorted(_STEP4.split(), key=lambda s: -len(s))


def _shape(stem: str) -> str:
    """Consonants as c, vowels as v; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for old, new in rules:
        if word.endswith(old):
            stem = word[:-len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words under three or over 64 bytes stay whole."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        ending = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
        if ending and "v" in _shape(word[:-len(ending)]):
            word = word[:-len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _shape(word)[-2:] == "cc" and word[-1:] == word[-2:-1] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _RULES2), _RULES3)
    for ending in _ENDINGS4 + ["ion"]:
        if word.endswith(ending) and (ending != "ion" or word[:-3].endswith(("s", "t"))):
            if _measure(word[:-len(ending)]) > 1:
                word = word[:-len(ending)]
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@pandas_udf(StringType())
def porter_stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(stem, na_action="ignore").astype(object)
