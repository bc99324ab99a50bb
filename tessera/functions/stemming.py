"""Index terms: Unicode word tokens, folded, and stemmed by Porter's algorithm of 1980."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Bytes of the shortest and the longest token that is stemmed.
SHORTEST, LONGEST = 3, 64


def _is_token(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LN" or kind == "Co" or (kind[0] == "M")


def fold(token: str) -> str:
    """Lower case without diacritics."""
    plain = unicodedata.normalize("NFD", token.lower())
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


def word_spans(text: str) -> list[tuple[int, int]]:
    spans, start = [], -1
    for i, c in enumerate(text):
        if c.isalnum() if c.isascii() else _is_token(c):
            if start < 0:
                start = i
        elif start >= 0:
            spans.append((start, i))
            start = -1
    if start >= 0:
        spans.append((start, len(text)))
    return spans


def index_terms(text: str | None) -> list[str]:
    return [term(text[a:b]) for a, b in word_spans(text or "")]


@lru_cache(1 << 16)
def term(token: str) -> str:
    folded = fold(token)
    # the algorithm sees bytes: those of other letters than a to z are consonants
    raw = folded.encode()
    return stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore") if SHORTEST <= len(raw) <= LONGEST else folded


# Suffixes of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem_: str) -> int:
    return len(re.findall("v+c+", _shape(stem_)))


def _has_vowel(stem_: str) -> bool:
    return "v" in _shape(stem_)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(s) < len(word)), key=len, default=None)


def stem(word: str) -> str:
    w = word
    # plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # -ed and -ing
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
