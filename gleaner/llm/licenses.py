"""Operator 10: license scans.

Known phrases are counted where their words stand consecutively. Beyond them, short notices are
searched with up to a few edits: a notice allowing e edits is split into e + 1 pieces, of which
one must stand exactly (pigeonhole); an automaton finds the pieces, and around each the ``regex``
library matches the whole notice with bounded errors and reports its span. A place where more of the
notice's letters are missing than edits are allowed is passed over without that search.

Cases. Null and empty texts have no words: counts 0, no labels, null first and last word, score 0.
Null ids and repeated rows get a row each. Texts of any length are searched whole, in time that
grows with their length and the places of pieces. Ties: of overlapping matches of one notice the
one in the first place found counts; of different notices those with the fewest edits, all of them
if equal. Extra columns, also clashing ones, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import collections
import itertools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Rows, bounded_batches, documents, tidy

#: Phrases of the base, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices of the method (words as they are normalised), and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("under the terms of the gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
PIECE = 8
MOST_ERRORS = 6

#: Bytes to words: A-Z lower-cased, other ASCII that is no digit or letter to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class LicenseScanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(f" {phrase} ".encode(), label) for phrase, label in phrases]
        self.notices, self.seeds = [], ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, label) in enumerate(notices):
            errors = max(0, min(MOST_ERRORS, len(notice) // PIECE - 1))
            self.notices.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={errors}}}"), label, len(notice), errors, collections.Counter(notice)))
            cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((k, a))
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def spans(self, flat: str) -> list[tuple[str, int, int, int, str]]:
        """(label, first word, word after the last, edits, matched text), in order of label and
        place, of words joined by single spaces with a space at both ends. Overlapping matches of one notice count once."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, places) in self.seeds.iter(flat):
            for k, offset in places:
                _, _, length, errors, _ = self.notices[k]
                start = end - size + 1 - offset
                windows.setdefault(k, set()).add((max(0, start - errors), start + length + errors))
        out = []
        spaces = [i for i, c in enumerate(flat) if c == " "] if windows else []
        for k, found in windows.items():
            pattern, label, _, errors, letters = self.notices[k]
            done = 0
            for a, b in sorted(found):
                # all but ``errors`` letters of the notice are in a match
                if b <= done or sum(n - have for c, n in letters.items() if (have := flat.count(c, a, b)) < n) > errors:
                    continue
                if m := pattern.search(flat, max(a, done), b):
                    done = m.end()
                    first = bisect.bisect_left(spaces, m.start() + (flat[m.start()] == " ")) - 1
                    out.append((label, first, bisect.bisect_left(spaces, m.end() - flat.endswith(" ", m.start(), m.end())), sum(m.fuzzy_counts), m[0]))
        # where notices differ by a word or two, the one with the fewest edits has the place
        kept: list[tuple[str, int, int, int, str]] = []
        for _, level in itertools.groupby(sorted(out, key=lambda s: s[3]), key=lambda s: s[3]):
            # all spans kept with fewer edits, by first word, and how far those up to each reach
            fewer = sorted((k[1], k[2]) for k in kept)
            reach = list(itertools.accumulate((b for _, b in fewer), max))
            for span in level:
                n = bisect.bisect_left(fewer, (span[2],))
                if not n or reach[n - 1] <= span[1]:
                    kept.append(span)
        return sorted(kept)

    def scan(self, text: str | None) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
        flat = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            at, before, word = flat.find(phrase), 0, 0
            while at >= 0:
                word, before = word + flat.count(b" ", before, at), at
                starts.append(word)
                base.add(label)
                at = flat.find(phrase, at + 1)
        spans = self.spans(flat.decode("utf-8", "replace")) if words else []
        best = max((1 - e / (len(t) + e) for _, _, _, e, t in spans), default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": 1.0 if base else best,
            "spans": [dict(zip(("label", "start_word", "end_word", "edits", "matched"), s)) for s in spans],
        }


_SPAN = "array<struct<label:string,start_word:bigint,end_word:bigint,edits:bigint,matched:string>>"


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, labels, score, and ``spans`` of the notices found."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    span = pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("matched", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(phrases, notices)
        for batch in batches:
            schema = pa.schema([(id_col, batch.schema.field(0).type), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
            rows = Rows(schema)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = scanner.scan(text.as_py())
                rows.add((key, *got.values()), 200 + 150 * len(got["spans"]))
                if rows.full():
                    yield from rows.take()
            yield from rows.take()

    shape = f"`{id_col}` {id_type.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {_SPAN}"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(tidy(run), shape)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


QUERIES = {"op10_license_scan": op10_license_scan}
SQL: dict[str, str] = {}
