"""Periodic runs of words by harmonic grid probing.

A run is a maximal stretch with smallest period p whose length is at least `least` and
`power` * p. It holds at least `power` neighbouring points of the grid 0, p, 2p, ..., at
which the words are equal. So for each p the words at jp and (j+1)p are compared, n / p
pairs, in all n ln n of them; where power - 1 neighbouring pairs agree, a few words behind
them are tested, and the stretch is extended both ways by comparing chunks of the array with
the chunks p words on, each twice as long as the one before. Periods go up in octaves [P, 2P),
of which none divides another: pairs inside a run found before whose period divides p are
skipped, as their stretch has that smaller period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, text_steps

#: Grid pairs that are compared at once.
PAIRS = 1 << 20
#: Words of the first chunk of an extension.
CHUNK = 64
#: Words behind a grid point that are tested before a survivor is extended.
TESTS = 12

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def _stretch(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The largest [start, end) around at in which w[i] == w[i + p]."""
    end, size, n = at, CHUNK, len(w) - p
    while end < n:
        equal = w[end : min(end + size, n)] == w[end + p : min(end + size, n) + p]
        if not equal.all():
            end += int(equal.argmin())
            break
        end += len(equal)
        size *= 2
    start, size = at, CHUNK
    while start > 0:
        low = max(0, start - size)
        equal = w[low:start] == w[low + p : start + p]
        if not equal.all():
            start -= int(equal[::-1].argmin())
            break
        start = low
        size *= 2
    return start, end


def _survivors(w: np.ndarray, first: int, last: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (p, jp) for p in [first, last) from which `need` neighbouring pairs agree."""
    p = np.arange(first, last)
    count = (len(w) - 1) // p  # pairs (j, j + 1) with (j + 1) p inside
    p, count = p[count >= need], count[count >= need]
    if not len(p):
        return p, p
    starts = np.cumsum(count) - count
    every = np.repeat(p, count)
    at = (np.arange(int(count.sum())) - np.repeat(starts, count)) * every
    equal = w[at] == w[at + every]
    room = len(equal) - need + 1
    good = equal[:room].copy()
    for j in range(1, need):
        good &= equal[j : j + room]
    here = np.flatnonzero(good)
    here = here[every[here] == every[here + need - 1]]
    return every[here], at[here]


def find_runs(w: np.ndarray, power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the words numbered in w, by start, then period."""
    n = len(w)
    runs: list[tuple[int, int, int]] = []
    by_period: dict[int, tuple[list[int], list[int]]] = {}  # the starts and ends of the runs of a period, in ascending order
    first, top = 1, n // power
    while first <= top:
        # An octave, or a part of one whose pairs fit into PAIRS.
        octave = 1 << first.bit_length()
        last = min(octave, top + 1, first + max(1, PAIRS * first // n))
        p, at = _survivors(w, first, last, power - 1)
        first = last
        for q, (starts, ends) in by_period.items():
            if not len(p):
                break
            owner = np.searchsorted(starts, at, "right") - 1
            inside = (p % q == 0) & (p > q) & (owner >= 0) & (np.array(ends)[owner] > at + p)
            p, at = p[~inside], at[~inside]
        for t in range(1, TESTS):
            if not len(p):
                break
            # Equal up to the last of the survivor's pairs, as it is from a run's first grid point on.
            ok = (t > (power - 2) * p) | (w[np.minimum(at + t, n - 1 - p)] == w[np.minimum(at + t, n - 1 - p) + p])
            p, at = p[ok], at[ok]
        period, passed = 0, 0
        for q, i in zip(p.tolist(), at.tolist(), strict=True):
            if q != period:
                period, passed = q, 0
            if i < passed:
                continue
            start, end = _stretch(w, i, q)
            passed = end
            if end + q - start < max(least, power * q):
                continue
            if any(q % d == 0 and _covered(by_period[d], start, end + q) for d in by_period if d < q):
                continue
            starts, ends = by_period.setdefault(q, ([], []))
            starts.append(start)
            ends.append(end + q)
            runs.append((start, end + q - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _covered(found: tuple[list[int], list[int]], start: int, end: int) -> bool:
    i = int(np.searchsorted(found[0], start, "right")) - 1
    return i >= 0 and found[1][i] >= end


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties go to the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text_col: str = "text", power: int = 4, least: int = 6) -> DataFrame:
    """docs with three more columns (under free names, in this order): runs, best and collapsed.

    Words are what lies between the white space `[\\x20\\x09-\\x0D]`. runs array<struct<start,
    length, period>> has every run by start, then period; best is the one of greatest length /
    period, null without runs; collapsed is the text's words, joined by one space, less
    those that a run repeats. power is at least 2 and least at least 1. Null and empty texts
    have no words and the collapsed text "". Repeated rows are judged one by one, all columns
    of docs pass, texts of any length are whole (one is in memory at a time with its words),
    and an empty table gives an empty result.
    """
    names = [free_name(docs, x) for x in ("runs", "best", "collapsed")]
    at = docs.columns.index(text_col)
    schema = docs.withColumns({names[0]: F.lit(None).cast(_RUNS), names[1]: F.lit(None).cast(_RUNS[6:-1]), names[2]: F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_steps(batch.column(at)):
                out = []
                for text in texts:
                    words = text.encode().split()  # bytes split at exactly the white space above
                    runs = find_runs(numbered(words), power, least)
                    out.append((runs, strongest(runs), collapsed(words, runs).decode()))
                runs, best, rest = zip(*out, strict=True)
                piece = batch.slice(row, len(texts))
                keys = ("start", "length", "period")
                added = [
                    pa.array([[dict(zip(keys, r, strict=True)) for r in x] for x in runs], pa.list_(_RUN)),
                    pa.array([x and dict(zip(keys, x, strict=True)) for x in best], _RUN),
                    pa.array(rest, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns, *added], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def loop_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with a loop put in by rule, for one id in ten: from some word on they repeat with one period."""
    code = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), code // 10
    if code % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts with the loops of loop_words, their words joined by one space; a null id counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, texts in text_steps(batch.column(1)):
                out = [b" ".join(loop_words(t.encode().split(), i)).decode() for i, t in zip(ids[row : row + len(texts)], texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(out, pa.string())], names=["doc_id", "text"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, text string")


def _line(run: Column) -> Column:
    return F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    found = periodic_runs(docs)
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs as islands of equal words p apart: all pairs of one word in a document, up to a quarter of its length apart. The crc32 runs bit by bit.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda s: ord(s)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h
  FROM documents),
e AS (SELECT r, doc_id, o, h, len(o) AS n, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
t AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w
  FROM e),
x AS MATERIALIZED (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM t),
m AS (SELECT a.r, a.i, b.i - a.i AS p FROM x a JOIN x b ON b.r = a.r AND b.w = a.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS MATERIALIZED (
  SELECT r, p, min(i) AS s, count(*) + p AS len FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM m)
  GROUP BY r, p, k HAVING count(*) >= 3 * p AND count(*) + p >= 6),
q AS MATERIALIZED (SELECT r, s, len, p FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.r = a.r AND b.p < a.p AND a.p % b.p = 0 AND b.s <= a.s AND b.s + b.len >= a.s + a.len)),
y AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(s, len, p) ORDER BY len::DOUBLE / p DESC, s, p) AS best, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs
  FROM q GROUP BY r),
z AS (
  SELECT x.r, string_agg(x.w, ' ' ORDER BY x.i) AS kept
  FROM x LEFT JOIN (SELECT DISTINCT r, unnest(range(s + p, s + len)) AS i FROM q) c ON c.r = x.r AND c.i = x.i WHERE c.i IS NULL GROUP BY x.r)
SELECT t.doc_id, coalesce(y.n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.p AS period, 1000 * best.len // best.p AS exponent_milli,
       sha256(coalesce(y.runs, '')) AS runs_sha256, sha256(coalesce(z.kept, '')) AS collapsed_sha256
FROM t LEFT JOIN y ON y.r = t.r LEFT JOIN z ON z.r = t.r
"""
