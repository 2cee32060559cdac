"""The extended stemmer as SQL, for the queries' oracles: one step after the other over rows of words."""

from __future__ import annotations

from gleaner.functions.porter import IRREGULAR

_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou"


def _ends(*endings: str) -> str:
    return "(" + " OR ".join(f"ends_with(w, '{e}')" for e in endings) + ")"


def _left(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _shape(word: str) -> str:
    """y after a consonant as Y: then aeiouY are the vowels."""
    return f"regexp_replace({word}, '([^aeiouy])y', '\\1Y', 'g')"


def _more(word: str, n: int) -> str:
    """More than ``n`` runs of vowels with a consonant after them."""
    return f"regexp_matches({_shape(word)}, '{'[aeiouY]+[^aeiouY]+' * n}[aeiouY]+[^aeiouY]')"


def _short(word: str) -> str:
    return f"(regexp_matches({_shape(word)}, '[^aeiouY][aeiouY][^aeiouYwxy]$') OR regexp_matches({_shape(word)}, '^[aeiouY][^aeiouY]$'))"


def _one(word: str) -> str:
    return f"({_more(word, 0)} AND NOT {_more(word, 1)})"


def _whole(base: str) -> str:
    """What is left of a word without -ed or -ing."""
    twice = f"right({base}, 1) = substring({base}, length({base}) - 1, 1) AND length({base}) > 1 AND NOT regexp_matches({_shape(base)}, '[aeiouY]$')"
    return (
        f"CASE WHEN ends_with({base}, 'at') OR ends_with({base}, 'bl') OR ends_with({base}, 'iz') THEN {base} || 'e' WHEN {twice} THEN CASE WHEN right({base}, 1) IN ('l', 's', 'z') THEN {base}"
        f" ELSE left({base}, length({base}) - 1) END WHEN {_one(base)} AND {_short(base)} THEN {base} || 'e' ELSE {base} END"
    )


def _rules(rules: str, least: int) -> str:
    whens = []
    for old, _, new in (r.partition(":") for r in rules.split()):
        extra = f" AND right({_left(3)}, 1) IN ('s', 't')" if old == "ion" else ""
        whens.append(f"WHEN {_ends(old)} THEN CASE WHEN {_more(_left(len(old)), least)}{extra} THEN {_left(len(old))} || '{new}' ELSE w END")
    return f"CASE {' '.join(whens)} ELSE w END"


_STEPS = (
    f"CASE WHEN {_ends('ies')} AND length(w) = 4 THEN {_left(1)} WHEN {_ends('sses', 'ies')} THEN {_left(2)} WHEN {_ends('s')} AND NOT {_ends('ss')} THEN {_left(1)} ELSE w END",
    f"CASE WHEN {_ends('ied')} THEN CASE WHEN length(w) = 4 THEN {_left(1)} ELSE {_left(2)} END WHEN {_ends('eed')} THEN CASE WHEN {_more(_left(3), 0)} THEN {_left(1)} ELSE w END"
    + "".join(f" WHEN {_ends(e)} THEN CASE WHEN regexp_matches({_shape(_left(len(e)))}, '[aeiouY]') THEN {_whole(_left(len(e)))} ELSE w END" for e in ("ed", "ing")) + " ELSE w END",
    f"CASE WHEN {_ends('y')} AND length(w) > 2 AND regexp_matches({_shape(_left(1))}, '[^aeiouY]$') THEN {_left(1)} || 'i' ELSE w END",
    f"CASE WHEN {_ends('alli')} AND {_more(_left(4), 0)} THEN {_left(2)} ELSE w END",
    f"CASE WHEN {_ends('logi')} THEN CASE WHEN {_more(_left(3), 0)} THEN {_left(1)} ELSE w END ELSE {_rules(_STEP2, 0)} END",
    _rules(_STEP3, 0),
    _rules(_STEP4, 1),
    f"CASE WHEN {_ends('e')} AND ({_more(_left(1), 1)} OR ({_one(_left(1))} AND NOT {_short(_left(1))})) THEN {_left(1)} ELSE w END",
    f"CASE WHEN {_ends('ll')} AND {_more(_left(1), 1)} THEN {_left(1)} ELSE w END",
)


def stems(name: str, source: str) -> str:
    """Common tables that end in ``name`` (word, stem) for the distinct words of ``source`` (word)."""
    parts, before = [f"{name}0 AS (SELECT DISTINCT word, word AS w FROM {source})"], f"{name}0"
    for i, step in enumerate(_STEPS, 1):
        parts.append(f"{name}{i} AS (SELECT word, {step} AS w FROM {before})")
        before = f"{name}{i}"
    known = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    parts.append(f"{name} AS (SELECT word, CASE word {known} ELSE CASE WHEN length(word) <= 2 THEN word ELSE w END END AS stem FROM {before})")
    return ", ".join(parts)
