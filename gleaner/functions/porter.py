"""The Porter stemmer for lower-case words: the extended form that is in common use, and that of 1980.

The extended form adds to the published rules (M. F. Porter, 1980, and the author's later
departures): irregular words, short words in -ies and -ied, y only after a consonant that isn't the
first letter, a vowel with a consonant after it as a whole stem that takes an e, and the endings
-bli, -fulli and -logi, with -alli taken in two steps.
"""

from __future__ import annotations

import re
from functools import lru_cache


#: Irregular words and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str, extended: bool = False) -> bool:
    shape = _shape(word)
    return (len(word) > 2 and shape[-3:] == "cvc" and word[-1] not in "wxy") or (extended and shape == "vc")


def _replace(word: str, rules, least: int) -> str:
    """The first ending that fits decides, whether its stem is long enough or not."""
    for ending, new in rules:
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + new if _measure(stem) > least else word
    return word


# longer endings come before those they end with
_STEP2 = [r.split(":") for r in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()]
_STEP3 = [r.split(":") for r in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _step2(word: str, extended: bool) -> str:
    if not extended:
        return _replace(word, _STEP2, 0)
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step2(word[:-2], extended)
    if word.endswith("logi"):  # the l counts for the stem
        return word[:-1] if _measure(word[:-3]) > 0 else word
    rules = [("ble", "bli") if old == "abli" else (new, old) for old, new in _STEP2]
    return _replace(word, [(old, new) for new, old in rules] + [("fulli", "ful")], 0)


@lru_cache(maxsize=100_000)
def stem(word: str, extended: bool = True) -> str:
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if extended and word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if extended and word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending):
                if _has_vowel(base := word[: -len(ending)]):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word):
                        word = word if word[-1] in "lsz" else word[:-1]
                    elif _measure(word) == 1 and _cvc(word, extended):
                        word += "e"
                break
    if word.endswith("y") and ((len(word) > 2 and _shape(word[:-1])[-1] == "c") if extended else _has_vowel(word[:-1])):
        word = word[:-1] + "i"
    word = _step2(word, extended)
    word = _replace(word, _STEP3, 0)
    for ending in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if _measure(base) > 1 and (ending != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base, extended)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
