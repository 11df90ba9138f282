"""URL filter by the ratio of two character language models.

One variable-order Markov model is trained on accepted and one on rejected URLs, both
smoothed by Witten-Bell interpolation down to the uniform distribution. A URL's score is
the log-likelihood difference per character, calibrated by logistic regression on URLs that
the models did not see. Counts and calibration take in every distinct URL that a rule decides,
as grouped sums; the model grows with the distinct strings of ORDER + 1 characters. Rules come first: the longest one that fits decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

ORDER = 4
#: Of a verdict's URLs one in HELD, by a hash, calibrates and is left out of the counts; of fewer than FEW all do both.
HELD, FEW = 4, 64
#: Digits to which differences are counted for the calibration.
DIGITS = 4
_END = "\0"
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    found = _PARTS.search(url or "")
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest rule that fits the host or a parent domain and begins the path."""
    fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def grams(urls: Iterable[str], order: int = ORDER) -> Counter:
    """Counts of the strings of order + 1 characters of padded URLs: a context and the character after it."""
    found: Counter = Counter()
    for url in urls:
        text = " " * order + url + _END
        found.update(text[i - order : i + 1] for i in range(order, len(text)))
    return found


class Markov:
    """A variable-order character model: counts of contexts up to ORDER, Witten-Bell smoothed."""

    def __init__(self, urls: Iterable[str] = (), order: int = ORDER, counts: dict[str, int] | None = None) -> None:
        self.order = order
        self.next: dict[str, Counter] = defaultdict(Counter)
        for gram, n in (grams(urls, order) if counts is None else counts).items():
            for k in range(order + 1):
                self.next[gram[order - k : order]][gram[order]] += n
        self.next = dict(self.next)
        self.total = {c: sum(n.values()) for c, n in self.next.items()}
        self.memo: dict[tuple[str, str], float] = {}

    def p(self, context: str, char: str) -> float:
        found = self.memo.get((context, char))
        if found is None:
            lower = self.p(context[1:], char) if context else 1 / 0x110000
            n = self.next.get(context)
            found = lower if n is None else (n[char] + len(n) * lower) / (self.total[context] + len(n))
            if len(self.memo) < 500_000:
                self.memo[context, char] = found
        return found

    def log_likelihood(self, url: str) -> float:
        text = " " * self.order + url + _END
        return sum(math.log(self.p(text[i - self.order : i], text[i])) for i in range(self.order, len(text)))


class UrlModel:
    """Accepted and rejected models with a calibration; without both classes everything is accepted."""

    def __init__(self, accepted: list[str], rejected: list[str]) -> None:
        self.known = bool(accepted and rejected)
        if not self.known:
            return
        fit = [[u for i, u in enumerate(sorted(x)) if i % 4 or len(x) < 4] for x in (accepted, rejected)]
        seen = [[u for i, u in enumerate(sorted(x)) if i % 4 == 0 or len(x) < 4] for x in (accepted, rejected)]
        self.accept, self.reject = Markov(fit[0]), Markov(fit[1])
        self.calibrate([(self.difference(u), y, 1) for y, urls in enumerate(seen) for u in urls])

    @classmethod
    def of_counts(cls, accepted: dict[str, int], rejected: dict[str, int]) -> UrlModel:
        """A model from the grams of both classes, to be calibrated."""
        model = cls([], [])
        model.known = bool(accepted and rejected)
        if model.known:
            model.accept, model.reject, model.a, model.b = Markov(counts=accepted), Markov(counts=rejected), 1.0, 0.0
        return model

    def calibrate(self, points: list[tuple[float, int, int]]) -> None:
        """Fits a and b to (difference, class, how many) with both classes of equal weight."""
        x, y, n = (np.array(c, float) for c in zip(*points, strict=True))
        n = n * np.where(y == 1, n.sum() / 2 / max(1.0, n[y == 1].sum()), n.sum() / 2 / max(1.0, n[y == 0].sum())) / n.sum()
        self.a, self.b = 1.0, 0.0
        for _ in range(300):
            g = (1 / (1 + np.exp(-np.clip(self.a * x + self.b, -50.0, 50.0))) - y) * n
            self.a, self.b = self.a - 2.0 * float(g @ x), self.b - 2.0 * float(g.sum())

    def difference(self, url: str) -> float:
        """Log-likelihood of the rejected less that of the accepted model, per character."""
        return (self.reject.log_likelihood(url) - self.accept.log_likelihood(url)) / (len(url) + 1)

    def blocked(self, url: str) -> float:
        """Calibrated probability that the URL is one to reject."""
        if not self.known:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.a * self.difference(url) + self.b))))


def train(pages: DataFrame, url_col: str = "url", rules=RULES) -> UrlModel:
    """Fits on all distinct URLs that a rule decides: grams counted by Spark, then differences of the held ones, counted to DIGITS digits."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [u or "" for u in batch.column(0).to_pylist()]
            found = [rule_of(*split_url(u), rules) for u in urls]
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array([f and f[1] for f in found], pa.string())], names=["url", "verdict"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for verdict in ("allow", "block"):
                found = grams(u for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v == verdict)
                columns = [pa.array([verdict] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["verdict", "gram", "n"])

    judged = pages.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(judge, "url string, verdict string").filter("verdict is not null").distinct()
    sizes = {r[0]: r[1] for r in judged.groupBy("verdict").count().collect()}
    small = F.col("verdict").isin([v for v, n in sizes.items() if n < FEW])
    held = F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0
    counts: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    for verdict, gram, n in judged.filter(small | ~held).mapInArrow(count, "verdict string, gram string, n long").groupBy("verdict", "gram").agg(F.sum("n")).collect():  # the model
        counts[verdict][gram] = n
    model = UrlModel.of_counts(counts["allow"], counts["block"])
    if model.known:
        shared = pages.sparkSession.sparkContext.broadcast(model)

        def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [round(shared.value.difference(u), DIGITS) for u in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.float64())], names=["verdict", "x"])

        points = judged.filter(small | held).mapInArrow(differ, "verdict string, x double").groupBy("verdict", "x").count().orderBy("verdict", "x").collect()  # values of so many digits
        model.calibrate([(r.x, int(r.verdict == "block"), r["count"]) for r in points])
    return model


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    The verdict is the longest fitting rule's, else the models': block from a calibrated
    probability (score) of 0.5. A null url counts as empty: no host, no path, no rule.
    Equal URLs get equal verdicts; repeated rows give repeated rows; a null id stays null;
    other columns are not read; an empty table gives an empty result.
    """
    model = model or train(pages, url_col, rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # as large as its distinct grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = rule_of(host, path, rules) or (None, None)
                score = round(shared.value.blocked(url or ""), 6)
                rows.append((host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), score))
            types = [pa.string()] * 4 + [pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["page_id", "host", "path", "rule", "verdict", "score"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return source.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


#: Host, path and rule.
ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, p) AS (VALUES %s)
SELECT page_id, host, path,
       (SELECT first(h || p ORDER BY length(h || p) DESC, h || p DESC) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
FROM u
""" % ", ".join(f"('{h}', '{p}')" for _, h, p in RULES)
