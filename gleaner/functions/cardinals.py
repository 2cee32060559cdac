"""English cardinal number words."""

from __future__ import annotations

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SMALL_SCALES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion".split()
_UNIT = ["", "un", "duo", "tre", "quattuor", "quin", "sex", "septen", "octo", "novem"]
_TEN = ["", "dec", "vigint", "trigint", "quadragint", "quinquagint", "sexagint", "septuagint", "octogint", "nonagint"]


def _scale(power: int) -> str:
    """The name of 1000 to the power ``power``, from 1."""
    if power <= len(_SMALL_SCALES):
        return _SMALL_SCALES[power - 1]
    tens, units = divmod(power - 1, 10)
    return "centillion" if power == 101 else f"{_UNIT[units]}{_TEN[tens]}illion"


def _below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    words = [f"{_ONES[hundreds]} hundred"] if hundreds else []
    if rest or not hundreds:
        tens, ones = divmod(rest, 10)
        small = _ONES[rest] if rest < 20 else _TENS[tens - 2] + (f"-{_ONES[ones]}" if ones else "")
        words += ["and", small] if hundreds else [small]
    return " ".join(words)


def cardinal(n: int) -> str:
    """``n`` from 0 to below 10 ** 306 in words: 1,234 is "one thousand, two hundred and thirty-four"."""
    if n < 1000:
        return _below_thousand(n)
    groups, power = [], 0
    while n:
        n, low = divmod(n, 1000)
        if low:
            groups.append((power, low))
        power += 1
    words = [_below_thousand(low) + (f" {_scale(p)}" if p else "") for p, low in reversed(groups)]
    last = groups[0]
    if last[0] == 0 and last[1] < 100:  # a small rest is joined by "and"
        return ", ".join(words[:-1]) + " and " + words[-1]
    return ", ".join(words)
