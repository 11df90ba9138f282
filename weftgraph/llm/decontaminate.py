"""Benchmark decontamination: a broadcast set of the benchmark's word n-grams, scanned over every window of the training texts.

Texts are lower-cased (A-Z) and cut into words. The hashes of all windows of the benchmark
items are broadcast beside the items' normalised words; a task looks up the hash of each
window of a text, compares the words byte by byte, and marks the words of every hit. Items
are cut into overlapping pieces that are dealt to parts of at most about `part_words` words,
and a part is broadcast at a time: a benchmark of any size is scanned in as many passes,
each of which adds to the spans that the one before it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LETTERS, LOWER, Scratch, free_name, gram_hashes, steps, within, word_hashes, word_spans

#: Words of a window.
WINDOW = 10
#: Benchmark words that are broadcast at a time: about 40 bytes each in a task.
PART_WORDS = 1 << 21
#: Words of a piece of an item, without those that it shares with the next one.
PIECE = 1 << 12

_SPANS_DDL = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Grams:
    """Distinct windows of one length: sorted hashes, the word at which each begins, and the items that have it."""

    hashes: np.ndarray
    words: np.ndarray
    owner_starts: np.ndarray
    owners: np.ndarray


@dataclass
class Part:
    """A part of the benchmark: its normalised words, and its windows by length."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: list[str | None]
    grams: dict[int, Grams]


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Pieces (item, text, words) of normalised item texts; neighbouring pieces share window - 1 words, so that each window is in one of them."""
    for batch in batches:
        for at, data, offsets in steps(batch.column(1)):
            low = LOWER[data]
            starts, ends, rows = word_spans(low, offsets, LETTERS)
            out = []
            for i in range(len(offsets) - 1):
                a, b = int(rows[i]), int(rows[i + 1])
                for lo in range(a, max(a + 1, b - window + 1) if b > a else a, PIECE):
                    hi = min(b, lo + PIECE + window - 1)
                    text = b" ".join(low[s:e].tobytes() for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True))
                    out.append((batch.column(0)[at + i].as_py(), text.decode(), hi - lo))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["item", "text", "words"])


def _same(data, starts, ends, at, data2, starts2, ends2, at2, k: int) -> np.ndarray:
    """Whether the k words from at and those from at2 have the same bytes, pair by pair."""
    good = np.ones(len(at), bool)
    for j in range(k):
        here = np.flatnonzero(good)
        s, t = starts[at[here] + j], starts2[at2[here] + j]
        size = ends[at[here] + j] - s
        fits = size == ends2[at2[here] + j] - t
        good[here[~fits]] = False
        here, s, t, size = here[fits], s[fits], t[fits], size[fits]
        if len(here):
            firsts = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(firsts, size)
            equal = data[np.repeat(s, size) + inside] == data2[np.repeat(t, size) + inside]
            good[here] = np.logical_and.reduceat(equal, firsts)
    return good


def build_part(pieces: list[tuple[str | None, str]], window: int = WINDOW) -> Part:
    """The windows of pieces (item, normalised text); windows of the same words are one, with all their items."""
    items = sorted({item for item, _ in pieces}, key=lambda x: (x is None, x or ""))
    number = {item: i for i, item in enumerate(items)}
    texts = pa.array([text for _, text in pieces], pa.large_string())
    owner = np.array([number[item] for item, _ in pieces], np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(pieces) + 1] if pieces else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] if pieces and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    starts, ends, rows = word_spans(data, offsets, LETTERS)
    hashes = word_hashes(data, starts, ends)
    sizes = np.diff(rows)
    grams: dict[int, list] = {}
    for k in sorted({min(window, int(n)) for n in sizes.tolist() if n}):
        chosen = (sizes >= window) if k == window else (sizes == k)
        at = np.concatenate([np.arange(a, b - k + 1) for a, b, ok in zip(rows[:-1].tolist(), rows[1:].tolist(), chosen.tolist(), strict=True) if ok])
        h = gram_hashes(hashes, k)[at]
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        # Of windows with one hash, each is led to the first one of the same words.
        lead = np.arange(len(h))
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        lead = np.maximum.accumulate(np.where(fresh, lead, 0))
        while True:
            other = np.flatnonzero((lead != np.arange(len(h))) & ~_same(data, starts, ends, at[lead], data, starts, ends, at, k))
            if not len(other):
                break
            first: dict[int, int] = {}  # a collision of hashes: what differs from its leader is led by the first of them
            lead[other] = [first.setdefault(int(x), int(o)) for x, o in zip(lead[other], other, strict=True)]
        leaders, group = np.unique(lead, return_inverse=True)
        pairs = np.unique(group.astype(np.int64) * len(items) + owner[np.searchsorted(rows, at, "right") - 1])
        own = pairs // len(items)
        grams[k] = Grams(h[leaders], at[leaders], np.searchsorted(own, np.arange(len(leaders) + 1)), pairs % len(items))
    return Part(data, starts, ends, items, grams)


def _hits(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, part: Part):
    """Yields (window length, words at which a window of the part stands, number of the window)."""
    words = word_hashes(low, starts, ends)
    for k, grams in part.grams.items():
        h = gram_hashes(words, k)
        if not len(h):
            continue
        place = np.searchsorted(grams.hashes, h)
        at = np.flatnonzero((place < len(grams.hashes)) & (grams.hashes[np.minimum(place, len(grams.hashes) - 1)] == h) & within(rows, k, len(words)))
        place = place[at]
        while len(at):  # a second turn only where windows of different words share a hash
            ok = _same(low, starts, ends, at, part.data, part.starts, part.ends, grams.words[place], k)
            yield k, at[ok], place[ok]
            at, place = at[~ok], place[~ok] + 1
            more = (place < len(grams.hashes)) & (grams.hashes[np.minimum(place, len(grams.hashes) - 1)] == h[at])
            at, place = at[more], place[more]


def scan_step(data: np.ndarray, offsets: np.ndarray, part: Part) -> tuple[np.ndarray, list, list]:
    """Of each row its number of words, its hit spans [start, end) in words, and the items it hits."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, LETTERS)
    n = len(offsets) - 1
    edge = np.zeros(len(starts) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for k, at, window in _hits(low, starts, ends, rows, part):
        edge[at] += 1
        edge[at + k] -= 1
        row = np.searchsorted(rows, at, "right") - 1
        grams = part.grams[k]
        found = np.unique(row * len(grams.hashes) + window)
        row, window = found // len(grams.hashes), found % len(grams.hashes)
        sizes = grams.owner_starts[window + 1] - grams.owner_starts[window]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pairs.append(np.unique(np.repeat(row, sizes) * len(part.items) + grams.owners[np.repeat(grams.owner_starts[window], sizes) + inside]))
    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    # A span ends with its row: where the next row goes on with a hit, the two are told apart.
    first = hit[1:-1] & ~hit[:-2]
    last = hit[1:-1] & ~hit[2:]
    cuts = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(starts))]
    first[cuts] = hit[1:-1][cuts]
    last[cuts - 1] = hit[1:-1][cuts - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(rows, a, "right") - 1
    spans: list = [[] for _ in range(n)]
    for i, s, e in zip(row.tolist(), (a - rows[row]).tolist(), (b - rows[row]).tolist(), strict=True):
        spans[i].append((s, e))
    items: list = [[] for _ in range(n)]
    pair = np.unique(np.concatenate(pairs))
    for i, item in zip((pair // max(1, len(part.items))).tolist(), (pair % max(1, len(part.items))).tolist(), strict=True):
        if part.items[item] is not None:
            items[i].append(part.items[item])
    return np.diff(rows), spans, items


def merged(old: list, new: list) -> list:
    """The union of two sorted lists of spans; spans that touch become one."""
    if not old or not new:
        return new or old
    out: list = []
    for s, e in sorted([*old, *new]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def parts_of(bench: DataFrame, item_col: str, text_col: str, window: int, part_words: int) -> Iterator[Part]:
    """The benchmark's parts, one on the driver at a time."""
    source = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    pieces = source.mapInArrow(lambda b: _pieces(b, window), "item string, text string, words long").distinct()
    total = pieces.agg(F.sum("words")).first()[0] or 0
    count = -(-total // part_words)
    for p in range(count):
        dealt = pieces if count == 1 else pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == p)
        yield build_part([(r.item, r.text) for r in dealt.select("item", "text").collect()], window)  # about part_words words


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs with three more columns (under free names, in this order): words long, spans array<struct<start, end>>, items array<string>.

    A window is `window` consecutive words of an item; an item with fewer is one window, and
    one without words none. spans are the words (from 0, end exclusive) that lie in an
    occurrence of any window, touching ones merged, items the distinct ids of the items whose
    windows occur, sorted as strings. Null and empty texts have no words. An item without id
    marks words but is not listed; items that repeat an id count as one. Repeated documents
    are judged one by one, texts of any length are whole, and all columns of docs pass. Empty
    tables give empty results or rows without hits.
    """
    spark = docs.sparkSession
    words, spans, items = (free_name(docs, name) for name in ("words", "spans", "items"))
    frame = docs.withColumns({words: F.lit(None).cast("long"), spans: F.lit(None).cast(_SPANS_DDL), items: F.lit(None).cast("array<string>")})
    at, first = docs.columns.index(text_col), len(docs.columns)
    scratch = Scratch(spark, "leaks")
    schema = frame.schema
    before = None
    for number, part in enumerate(_always_one(parts_of(bench, item_col, bench_text_col, window, part_words))):
        if before is not None:
            frame = scratch.write(frame, f"part-{number}")
            before.unpersist()
            scratch.drop(f"part-{number - 1}")
        shared = spark.sparkContext.broadcast(part)  # bounded by part_words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, data, offsets in steps(batch.column(at)):
                    n = len(offsets) - 1
                    piece = batch.slice(row, n)
                    words, spans, items = scan_step(data, offsets, shared.value)
                    old_spans, old_items = piece.column(first + 1), piece.column(first + 2)
                    if old_spans.null_count < n:
                        spans = [merged([(s["start"], s["end"]) for s in a or []], b) for a, b in zip(old_spans.to_pylist(), spans, strict=True)]
                        items = [sorted({*(a or []), *b}) for a, b in zip(old_items.to_pylist(), items, strict=True)]
                    spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS)
                    yield pa.RecordBatch.from_arrays([*piece.columns[:first], pa.array(words, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

        frame, before = frame.mapInArrow(run, schema), shared
    return frame


def _always_one(parts: Iterator[Part]) -> Iterator[Part]:
    """The parts, or an empty one where there are none: a scan still counts the words."""
    none = True
    for part in parts:
        none = False
        yield part
    if none:
        yield build_part([])


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "spans", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, least_share: float = 0.0) -> DataFrame:
    """docs without what they share with the benchmark, with the columns of docs.

    remove: "documents" drops rows of which more than `least_share` of the words are hit;
    "spans" cuts the hit words out of the text, from the first letter of a span to the last
    one, and leaves all other characters as they are. Rows without hits stay unchanged.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    found = scan(docs, bench, text_col, item_col, bench_text_col, window)
    words, spans, _ = found.columns[-3:]
    if remove == "documents":
        hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        return found.filter((hit == 0) | (hit <= F.lit(least_share) * F.col(words))).select(*[F.col(f"`{c}`") for c in docs.columns])
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in steps(batch.column(at)):
                piece = batch.slice(row, len(offsets) - 1)
                starts, ends, rows = word_spans(LOWER[data], offsets, LETTERS)
                out = piece.column(at).to_pylist()
                for i, some in enumerate(piece.column(len(batch.schema.names) - 2).to_pylist()):
                    if some:
                        kept, place = [], int(offsets[i])
                        for s in some:
                            kept.append(data[place : starts[rows[i] + s["start"]]].tobytes())
                            place = int(ends[rows[i] + s["end"] - 1])
                        out[i] = b"".join([*kept, data[place : offsets[i + 1]].tobytes()]).decode()
                columns = piece.columns[:-3]
                columns[at] = pa.array(out, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-3])

    return found.mapInArrow(cut, docs.schema)


def digests(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(parameters.get("text_col", "text")).cast("string").alias("text"))
    found = scan(source, bench, **{**parameters, "text_col": "text"})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", F.col("words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


#: All windows of both tables as joined words; the words that a hit covers are counted once.
ORACLE = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id::VARCHAR AS item, k, array_to_string(words[j:j + k - 1], ' ') AS t
  FROM (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS j FROM b WHERE len(words) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
m AS MATERIALIZED (SELECT r, doc_id, words FROM d),
g AS (
  SELECT r, k, j, array_to_string(words[j:j + k - 1], ' ') AS t
  FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS j FROM m, (SELECT DISTINCT k FROM w) WHERE len(words) >= k)),
h AS MATERIALIZED (SELECT g.r, g.k, g.j, w.item FROM g JOIN w ON w.t = g.t AND w.k = g.k),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(j, j + k)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT m.doc_id, len(m.words) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM m LEFT JOIN c ON c.r = m.r LEFT JOIN i ON i.r = m.r
"""
