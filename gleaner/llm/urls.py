"""Operator 3: URL filters.

Ordered rules on host and path decide what they fit; the rest is decided by a logistic regression
on hashed character n-grams of host and path, trained here from a small labelled URL table.

Cases. A null url, or one without ``://``, has empty host and path; the model then judges by its
bias alone. Repeated rows and null ids get a row each. Urls of any length are judged whole. Ties:
of rules that fit, the longest string counts, host and path together, and the first named of equal
ones; a probability equal to the threshold blocks. Extra columns, also clashing ones, are ignored.
An empty table gives an empty result. The model is fitted on at most ``MOST_TRAINING`` labelled
rows; every url is judged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Rows, table, tidy

#: (host, path, verdict), applied longest first.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
#: A documented bound on the labelled rows that the regression is fitted on.
MOST_TRAINING = 20_000

_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: The labelled table of the query is spelled out from these: hosts to block and to allow.
BLOCK_WORDS = "casino bets poker jackpot slots lottery pills viagra pharmacy loans payday adult xxx escort warez torrent crack keygen spam clicks ads track tracker popup adserver banner replica miracle diet crypto doubler freebies winprize".split()
BLOCK_LEADS = "free cheap best-online win buy fast my-hot get".split()
ALLOW_WORDS = "news daily library museum university school science weather history garden kitchen travel city council music theatre research institute journal review archive wiki docs forum hospital sport football chess radio story nature river mountain then tion ther rest ening house market".split()
ALLOW_LEADS = "the our local open first national north green".split()
#: Names without a meaning are to be allowed: these are put together from common syllables.
SYLLABLES = "th er an in re on at es en st nd ti or".split()
_PATHS = ("/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}?page=2&ref=x", "/{n}#top", "/en/{n}?utm_source=feed", "/post/{n}", "/")
_TAILS = ("example.com", "example.org", "example.net")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table: (url, 1 to block). About 2,000 rows, always the same."""
    rows, n = [], 0
    plain = [a + b + (SYLLABLES * 2)[i + k + 1] * (k % 2) for i, a in enumerate(SYLLABLES) for k, b in enumerate(SYLLABLES)]
    for words, leads, label in ((BLOCK_WORDS, BLOCK_LEADS, 1), (ALLOW_WORDS, ALLOW_LEADS, 0), (plain, (), 0)):
        for i, word in enumerate(words):
            for j, lead in enumerate((*leads, "", "www", "blog", "m")):
                n += 1
                name = {"": word, "www": f"www.{word}", "blog": f"blog.{word}", "m": f"m.{word}"}.get(lead, f"{lead}-{word}" if (i + j) % 2 else f"{word}-{lead}")
                # paths and endings fall alike on both labels, so that the names decide
                rows.append((f"https://{name}.{_TAILS[(i + j) % 3]}{_PATHS[(3 * i + j) % len(_PATHS)].format(n=(n * 7919) % 9973)}", label))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest rule that fits, as (rule string, verdict)."""
    best = None
    for on, start, verdict in rules:
        if path.startswith(start) and (host == on or host.endswith(f".{on}")) and (best is None or len(on + start) > len(best[0])):
            best = (on + start, verdict)
    return best


def _grams(part: str, text: str) -> list[int]:
    if not text:
        return []
    raw = f"{part}^{text}$".encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw[i : i + n], ord(part)) % BUCKETS for n in SIZES for i in range(1, len(raw) - n + 1)]


class UrlModel:
    """Logistic regression; host and path each add the mean weight of their n-grams."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._hosts: dict[str, float] = {}

    def _part(self, part: str, text: str) -> float:
        grams = _grams(part, text)
        return float(self.weights[grams].sum()) / len(grams) ** 0.5 if grams else 0.0

    def probability(self, host: str, path: str) -> float:
        if (h := self._hosts.get(host)) is None:
            if len(self._hosts) > 100_000:
                self._hosts.clear()
            h = self._hosts[host] = self._part("h", host)
        return float(1 / (1 + np.exp(-np.clip(self.bias + h + self._part("p", path), -30, 30))))


def train(rows: Iterable[tuple[str | None, int]], l2: float = 3e-4, rounds: int = 400) -> UrlModel:
    """Both labels get the same total weight. Full-batch gradient descent with momentum from zero: the same rows give the same model."""
    rows = [r for _, r in zip(range(MOST_TRAINING), rows)]
    index, value, start = [], [], [0]
    for url, _ in rows:
        for part, text in zip("hp", split_url(url)):
            grams = _grams(part, text)
            index += grams
            value += [len(grams) ** -0.5] * len(grams)
        start.append(len(index))
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return UrlModel(weights, bias)
    index, value, target = np.array(index, dtype=np.int64), np.array(value), np.array([y for _, y in rows], dtype=float)
    owner = np.repeat(np.arange(len(rows)), np.diff(start))
    share = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    step_w, step_b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + np.bincount(owner, value * weights[index], len(rows)))))
        miss = (p - target) * share
        step_w = 0.9 * step_w - 2.0 * (np.bincount(index, value * miss[owner], BUCKETS) + l2 * weights)
        step_b = 0.9 * step_b - 0.5 * float(miss.sum())
        weights, bias = weights + step_w, bias + step_b
    return UrlModel(weights, bias)


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and the model's block probability for every row."""
    id_type = pages.schema[id_col].dataType
    weights = pages.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or UrlModel(*weights.value)
            schema = pa.schema([(id_col, batch.schema.field(0).type), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("block_probability", pa.float64())])
            rows = Rows(schema)
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, path = split_url(url)
                p = own.probability(host, path)
                rule, verdict = rule_for(host, path, rules) or (None, "block" if p >= threshold else "allow")
                rows.add((key, host, path, rule, verdict, p), 128 + len(url or ""))
                if rows.full():
                    yield from rows.take()
            yield from rows.take()

    shape = f"`{id_col}` {id_type.simpleString()}, host string, path string, rule string, verdict string, block_probability double"
    return pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url")).mapInArrow(tidy(run), shape)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train(labelled_urls()))


QUERIES = {"op3_url_filter": op3_url_filter}
SQL: dict[str, str] = {}
