"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased text, hashed to `DIMS` columns:
the share of the text's n-grams in a column, times its inverse document frequency. Document
frequencies are counted over all training rows. The model is fitted by
follow-the-regularised-leader with elastic-net penalties (many weights stay exactly 0, and
only the others are kept) on a bounded sample of the training rows, and a softmax temperature
is then calibrated on sample rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_steps

DIMS = 1 << 15
ORDERS = (1, 2, 3)
#: Bounds of the labelled sample: about so many rows of each language, and about so many n-gram
#: columns (6 bytes each) in all; a language's share of both is drawn by a hash of id and text.
SAMPLE = 1000
COLUMNS = 1 << 25
#: Rows of all languages together beyond which each has an equal part of them, but at least one.
ROWS = 16_000
UNDEFINED = "und"
#: Languages whose weights a task spreads out at a time (128 KB each).
SHARD = 64

_U = np.uint64


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # the weights that are not 0, idf included, by column
    classes: np.ndarray  # the language of each
    starts: np.ndarray  # where each column's weights begin (DIMS + 1)
    bias: np.ndarray
    temperature: float

    @classmethod
    def of(cls, languages: list[str], dense: np.ndarray, bias: np.ndarray, temperature: float, columns: np.ndarray | None = None) -> Model:
        """From a matrix of weights, columns x languages; columns are their numbers if they are not all."""
        at, classes = np.nonzero(dense)
        places = at if columns is None else columns[at]
        return cls(languages, dense[at, classes].astype(np.float32), classes.astype(np.int32), np.searchsorted(places, np.arange(DIMS + 1)), bias, temperature)

    def block(self, first: int, last: int) -> np.ndarray:
        """The weights of the languages from first to last - 1, languages x DIMS."""
        out = np.zeros((last - first, DIMS), np.float32)
        inside = (self.classes >= first) & (self.classes < last)
        column = np.repeat(np.arange(DIMS), np.diff(self.starts))
        out[self.classes[inside] - first, column[inside]] = self.weights[inside]
        return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram columns of all texts, and where each text's begin (n + 1)."""
    lower = [t.lower() for t in texts]
    ends = np.cumsum([0, *(len(t) for t in lower)])
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    parts, rows = [], []
    for n in ORDERS:
        m = max(0, len(codes) - n + 1)
        h = np.full(m, _U(n), _U)
        for j in range(n):
            h = (h + codes[j : j + m]) * _U(0x9E3779B97F4A7C15)
        ok = np.ones(m, bool)
        for j in range(1, n):
            cut = ends[1:-1] - j
            ok[cut[(cut >= 0) & (cut < m)]] = False
        parts.append((h >> _U(64 - 15)).astype(np.int32)[ok])
        rows.append(np.concatenate([[0], np.cumsum(ok)])[np.minimum(ends, m)])
    # Interleave: all orders of one text are together.
    starts = np.sum(rows, axis=0)
    out = np.empty(starts[-1], np.int32)
    for i in range(len(texts)):
        at = starts[i]
        for p, r in zip(parts, rows, strict=True):
            k = r[i + 1] - r[i]
            out[at : at + k] = p[r[i] : r[i + 1]]
            at += k
    return out, starts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per used column: in how many of the task's texts it occurs; column -1 counts the texts."""
    df, n = np.zeros(DIMS, np.int64), 0
    mark = np.full(DIMS, -1, np.int64)
    for batch in batches:
        for _, texts in text_steps(batch.column(0)):
            cols, starts = grams(texts)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                mark[cols[a:b]] = n
                n += 1
                if b - a < DIMS // 4:
                    df[np.unique(cols[a:b])] += 1
                else:
                    df += mark == n - 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["col", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct columns and their shares, at most DIMS of each, for sample rows; packed, as the driver holds all of them."""
    for batch in batches:
        rows = []
        for at, texts in text_steps(batch.column(2)):
            cols, starts = grams(texts)
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                u, c = np.unique(cols[a:b], return_counts=True)
                rows.append((batch.column(0)[at + i].as_py(), batch.column(1)[at + i].as_py(), u.astype(np.uint16).tobytes(), (c / max(1, b - a)).astype(np.float32).tobytes()))
        types = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["r", "lang", "cols", "shares"])


def fit_ftrl(rows: list[tuple], k: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, passes: int = 4, dims: int = DIMS):
    """Weights and bias by FTRL-proximal; rows: (class, columns, values) with columns below dims."""
    z, n, w = np.zeros((dims, k), np.float32), np.zeros((dims, k), np.float32), np.zeros((dims, k), np.float32)
    zb, nb, bias = np.zeros(k), np.zeros(k), np.zeros(k)

    def leader(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for p in range(passes):
        for i in np.random.default_rng(p).permutation(len(rows)):
            y, cols, x = rows[i]
            logits = x @ w[cols] + bias
            prob = np.exp(logits - logits.max())
            prob /= prob.sum()
            prob[y] -= 1.0
            g = x[:, None] * prob[None, :]
            sigma = (np.sqrt(n[cols] + g * g) - np.sqrt(n[cols])) / alpha
            z[cols] += g - sigma * w[cols]
            n[cols] += g * g
            w[cols] = leader(z[cols], n[cols])
            sb = (np.sqrt(nb + prob * prob) - np.sqrt(nb)) / alpha
            zb += prob - sb * bias
            nb += prob * prob
            bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    return w, bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature of least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _digest(id_code: Column, text: Column) -> Column:
    """A draw in [0, 1) by id and text, so that rows that repeat an id are drawn on their own."""
    return F.pmod(F.xxhash64(id_code, text), F.lit(1 << 31)) / float(1 << 31)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rows_in_all: int = ROWS, columns_in_all: int = COLUMNS) -> Model | None:
    """Fits on the rows with a language whose id is not held out; None if there are none.

    Every language that such a row has is learned. sample, rows_in_all, columns_in_all: the
    bounds of the labelled rows that are used to fit, of each language's and of all; each
    language keeps its row of the least draw, so that none is without any. The document
    frequencies are of all training rows. The driver holds the sample, and weights for the
    sample's columns and all languages.
    """
    code = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.filter(code % 5 != 0).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(code.alias("r"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("draw", _digest(F.col("r"), F.col("text")))
    width = F.least(F.lit(DIMS), F.length("text") * len(ORDERS))  # at most so many columns
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(width).alias("columns"), F.min("draw").alias("least")).collect()  # a row a class
    if not sizes:
        return None
    languages = sorted(r.lang for r in sizes)
    dfs = rows.select("text").mapInArrow(_frequencies, "col long, df long").groupBy("col").agg(F.sum("df")).collect()  # at most DIMS + 1 rows
    df = np.zeros(DIMS)
    total = 1
    for col, x in dfs:
        if col >= 0:
            df[col] = x
        else:
            total = x
    idf = np.log((1 + total) / (1 + df)) + 1.0
    quota, room = min(sample, rows_in_all / len(sizes)), columns_in_all / len(sizes)
    bounds = [(r.lang, min(1.0, quota / r.rows, room / max(1, r.columns)), r.least) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, share double, least double")
    drawn = (F.col("draw") < F.col("share")) | (F.col("draw") == F.col("least"))
    chosen = rows.join(F.broadcast(bounds), "lang").filter(drawn).select("r", "lang", "text").mapInArrow(_features, "r long, lang string, cols binary, shares binary")
    number = {lang: i for i, lang in enumerate(languages)}
    found = sorted(chosen.collect(), key=lambda r: (r[0], r[1], len(r[2]), r[2], r[3]))  # bounded by the sample's rows and columns
    used = np.zeros(DIMS, bool)
    for row in found:
        used[np.frombuffer(row[2], np.uint16)] = True
    columns = np.flatnonzero(used)
    place = np.cumsum(used) - 1
    data = []
    for _, lang, cols, shares in found:
        cols = np.frombuffer(cols, np.uint16).astype(np.int32)
        data.append((number[lang], place[cols], (np.frombuffer(shares, np.float32) * idf[cols] * 10.0).astype(np.float32)))
    # A row in five is left for the temperature, but no language's only one.
    first = {y: i for i, (y, _, _) in reversed(list(enumerate(data)))}
    kept = [d for i, d in enumerate(data) if i % 5 or first[d[0]] == i]
    seen = [d for i, d in enumerate(data) if not i % 5 and first[d[0]] != i] or data
    w, bias = fit_ftrl(kept, len(languages), dims=len(columns))
    logits = np.array([x @ w[cols] + bias for _, cols, x in seen])
    temperature = calibrate(logits, np.array([d[0] for d in seen]))
    return Model.of(languages, w * idf[columns][:, None] * 10.0, bias, temperature, columns)


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}  # the first block of weights stays; with more languages the others are made again for each step
    for batch in batches:
        langs, scores = [], []
        for _, texts in text_steps(batch.column(2)):
            letters = [any(map(str.isalpha, t)) for t in texts]
            if model is None:
                langs += [None if ok else UNDEFINED for ok in letters]
                scores += [0.0] * len(texts)
                continue
            cols, starts = grams(texts)
            at, n = starts[:-1], np.diff(starts)
            logits = np.zeros((len(texts), len(model.languages)))
            full = np.flatnonzero(n)
            if len(full):
                for first in range(0, len(model.languages), SHARD):
                    last = min(first + SHARD, len(model.languages))
                    block = held[first] if first in held else model.block(first, last)
                    if not first:
                        held[first] = block
                    for c in range(first, last):
                        logits[full, c] = np.add.reduceat(block[c - first][cols], at[full], dtype=np.float64) / n[full]
            logits = (logits + model.bias) / model.temperature
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            best = prob.argmax(1)
            langs += [model.languages[b] if ok else UNDEFINED for b, ok in zip(best.tolist(), letters, strict=True)]
            scores += [round(float(prob[i, b]), 6) if ok else 0.0 for i, (b, ok) in enumerate(zip(best.tolist(), letters, strict=True))]
        langs = [x if x is not None else UNDEFINED for x in langs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    The model is trained on docs unless one is given. A null text, or one without a
    letter, gets `und` with score 0; so does everything where no row can be learned from.
    Ties between languages go to the first by code point. A null id counts as an empty
    one, whose checksum is 0: held out. Rows that repeat an id are scored on their own. Only
    the text is an input of a prediction. Other columns are not read; an empty table gives
    an empty result.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights that are not 0
    return source.mapInArrow(lambda b: _predict(b, shared.value), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs with a language: those predicted `und` go. A missing lang is filled with the prediction.

    Predictions are made row by row beside all columns, so no join is needed.
    """
    model = train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, lang_at = names.index(text_col), names.index(lang_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zero = pa.array([None] * len(batch), pa.int64())
            flag = pa.array([None] * len(batch), pa.bool_())
            part = pa.RecordBatch.from_arrays([zero, flag, batch.column(at)], names=["doc_id", "held_out", "text"])
            found = next(_predict(iter([part]), shared.value)).column(2)
            columns = list(batch.columns)
            columns[lang_at] = pc.coalesce(columns[lang_at], found)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pc.not_equal(found, UNDEFINED))

    return docs.mapInArrow(judge, docs.schema)
