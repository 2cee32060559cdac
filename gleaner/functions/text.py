"""Text functions of the analyzer as column expressions, and the full analyzer.

The simple profile (lower case, punctuation, white space, stop words) is built-in functions only.
The full profile adds special numbers, superscripts and subscripts, number words, a lemma
dictionary and stemming; the number words and stems are a vectorised Python function.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.cardinals import cardinal
from gleaner.functions.porter import stem
from gleaner.functions.stopwords import ENGLISH

#: ASCII punctuation that becomes a space, and that which goes.
SPACED = "!\"#$%&()*+-./:;<=>?@[\\]^_`{|}~"
DROPPED = ",'"
WHITE = " \t\n\r\f\x0b"
#: Quotation marks that are words of their own, and words that are two words.
QUOTES = "«“‘„»”’"
TWO_WORDS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
#: Families of enclosed numbers, as first code point, first value, last value.
ENCLOSED = (
    (0x2460, 1, 20), (0x3251, 21, 35), (0x32B1, 36, 50), (0x24EA, 0, 0), (0x24F5, 1, 10), (0x2780, 1, 10),
    (0x2776, 1, 10), (0x24EB, 11, 20), (0x24FF, 0, 0), (0x278A, 1, 10), (0x2474, 1, 20),
)
#: Fixed value: from so many digits on, a number is spelled in blocks of one digit less.
LONGEST_NUMBER = 307
#: Texts whose words the full analyzer holds as Python objects at a time.
FULL_ROWS = 128
NEW_TAI_LUE = range(0x19D0, 0x19DA)


def enclosed_numbers() -> dict[int, list[str]]:
    """Value to its characters."""
    out: dict[int, list[str]] = {}
    for first, low, high in ENCLOSED:
        for i in range(high - low + 1):
            out.setdefault(low + i, []).append(chr(first + i))
    return out


def special_numbers(text: Column) -> Column:
    """Enclosed numbers to (n)."""
    out = text
    for value, chars in sorted(enclosed_numbers().items()):
        out = F.regexp_replace(out, f"[{''.join(chars)}]", f"({value})")
    # most texts have none: then nothing is tried
    every = "".join("".join(chars) for chars in enclosed_numbers().values())
    return F.when(text.rlike(f"[{every}]"), out).otherwise(text)


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, SPACED + DROPPED, " " * len(SPACED))


def _raised(text: Column, digits: str) -> Column:
    return F.translate(F.regexp_replace(text, f"([{digits}]+)", "^$1 "), digits, "0123456789")


def replace_superscripts(text: Column) -> Column:
    return _raised(text, SUPERSCRIPTS)


def replace_subscripts(text: Column) -> Column:
    return _raised(text, SUBSCRIPTS)


def _pieces(plain: Column, between: str) -> Column:
    """What stands between runs of the characters ``between``, empty pieces included; some words are two.
    Each step over a text is bound to a variable: higher-order functions are evaluated without
    common subexpressions, so that what is written twice there is done twice."""
    apart = "".join(c if c.isspace() or not c.isascii() else f"\\{c}" for c in between)
    halves = "|".join(f"{a}(?={b}(?![^{apart}]))" for a, b in (two.split() for two in TWO_WORDS.values()))

    def cut(text: Column) -> Column:
        some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in TWO_WORDS])  # most texts have none
        return F.split(F.when(some, F.regexp_replace(text, f"(?<![^{apart}])({halves})", "$1 ")).otherwise(text), f"[{apart}]+")

    return F.transform(F.array(plain), cut)[0]


def tokens(text: Column) -> Column:
    """Words between white space and quotation marks; some words are two. Null and empty texts have none.
    (Quotation marks would be words of one character, which no profile keeps.)"""
    return F.filter(_pieces(F.coalesce(text, F.lit("")), WHITE + QUOTES), lambda w: w != "")


def remove_stopwords(words: Column, stop: Iterable[str] = ENGLISH) -> Column:
    """Without stop words and words of one character."""
    listed = list(stop)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(listed))  # a hash set


def simple_words(text: Column) -> Column:
    """The simple profile: an array of words, the same as of the text without punctuation."""
    plain = F.coalesce(F.lower(text), F.lit(""))
    for c in DROPPED:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    return remove_stopwords(_pieces(plain, WHITE + QUOTES + SPACED))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Parts of a text without empty ones and lone line breaks."""
    return F.filter(F.split(text, re.escape(separator)), lambda p: (p != "") & (p != "\n"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def passage(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end``, counted from 0."""
    return F.substring(text, start + 1, end - start)


def shard_number(path: Column) -> Column:
    found = F.regexp_extract(path, r"inverted_index_(\d+)", 1)
    return F.when(found == "", -1).otherwise(F.try_to_number(found, F.lit("9" * 9))).cast("int")


def file_and_hash(path: Column) -> Column:
    """The file part and the hash part of a path cut at ``.xml``."""
    return F.struct(F.regexp_extract(path, r"([^/]*\.xml)", 1).alias("file"), F.regexp_extract(path, r"\.xml[/_:]?(.*)$", 1).alias("hash"))


def redirect_hash(page: Column) -> Column:
    """The sha1 of a page that is a redirect, else null."""
    return F.when(page.rlike("<redirect"), F.nullif(F.regexp_extract(page, r"(?s)<sha1>\s*(.*?)\s*</sha1>", 1), F.lit("")))


def number_words(words: list[str]) -> list[str]:
    """Tokens of digits to cardinals. Tokens with New Tai Lue digits go; digits that have no integer value stay."""
    out: list[str] = []
    for word in words:
        if not word.isdigit():
            out.append(word)
        elif not any(ord(c) in NEW_TAI_LUE for c in word):
            try:
                size = LONGEST_NUMBER - 1
                blocks = [word] if len(word) < LONGEST_NUMBER else [word[i : i + size] for i in range(0, len(word), size)]
                out.append(" ".join(cardinal(int(b)) for b in blocks))
            except ValueError:
                out.append(word)
    return out


def word_list(text: str) -> list[str]:
    """The same words as :func:`tokens`."""
    words = text.translate(_QUOTES).split()
    return " ".join(TWO_WORDS.get(w, w) for w in words).split() if any(w in TWO_WORDS for w in words) else words


def load_lemmas(table: DataFrame, most: int = 1_000_000) -> dict[str, str]:
    """A lemma dictionary from rows (word, lemma); of several lemmas of a word the least. More than ``most`` words are an error: the dictionary goes to every worker."""
    rows = table.filter("word IS NOT NULL AND lemma IS NOT NULL").groupBy("word").agg(F.min("lemma").alias("lemma")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lemmas")
    return {r.word: r.lemma for r in rows}


_QUOTES = str.maketrans({c: " " for c in QUOTES})
_SPELL = str.maketrans({**{c: " " for c in SPACED}, **{c: None for c in DROPPED}})


def full_words_of(text: str | None, lemmas: dict[str, str] | None = None, stop: Iterable[str] = ENGLISH) -> list[str]:
    """The full profile of one text."""
    stop, lemmas = frozenset(stop), lemmas or {}

    def kept(words: list[str]) -> list[str]:
        return [w for w in words if len(w) > 1 and w not in stop]

    text = (text or "").lower()
    for value, chars in enclosed_numbers().items():
        for c in chars:
            if c in text:
                text = text.replace(c, f"({value})")
    words = kept(word_list(text.translate(_SPELL)))
    text = " ".join(words)
    for digits in (SUPERSCRIPTS, SUBSCRIPTS):
        text = re.sub(f"[{digits}]+", lambda m: "^" + m[0].translate({ord(c): str(i) for i, c in enumerate(digits)}) + " ", text)  # noqa: B023
    words = " ".join(number_words(word_list(text))).split()
    words = [stem(lemmas.get(w, w)) for w in words]
    words = " ".join(words).translate(_SPELL).split()
    words = " ".join(number_words(words)).split()
    words = [stem(w) for w in words]
    return kept(word_list(" ".join(words).translate(_SPELL)))


def full_words(lemmas: dict[str, str] | None = None, stop: Iterable[str] = ENGLISH):
    """A function of a text column that gives the full profile's words."""
    listed = tuple(stop)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def analyze(text: pa.Array) -> pa.Array:
        # words as Python objects take many times their text: of FULL_ROWS texts at once, no whole batch
        kind = pa.list_(pa.string())
        parts = [pa.array([full_words_of(t, lemmas, listed) for t in text.slice(i, FULL_ROWS).to_pylist()], kind) for i in range(0, len(text), FULL_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return analyze


@F.pandas_udf(T.StringType())
def stemmed(word: pd.Series) -> pd.Series:
    return word.map(stem, na_action="ignore")


@F.pandas_udf(T.StringType())
def spelled(text: pd.Series) -> pd.Series:
    """Numbers among a text's words to cardinals."""
    return text.map(lambda t: " ".join(number_words(t.split())), na_action="ignore")
