"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles. One permutation ``sigma`` scatters the
shingles; a second one, ``pi``, is used for every signature coordinate, circularly shifted
by the coordinate's number: ``h_k(S) = min over x in S of pi(sigma(x) + k mod 2^32)``.
Both are bijections of 32-bit values, so two permutations give all 128 coordinates.

Documents with equal sets, compared as whole sets, are one class, and one of them stands for
it. Bands of 4 coordinates put representatives into buckets. A bucket is compared with its
leader, never all with all, and verified links join components. Documents of buckets that
still hold several components go through an exact prefix filter, whose pairs grow with real
similarity and not with the size of a bucket. Every link rests on the full sets.

Every join meets keys that hold many rows (a leader, a shingle, a hub) in blocks dealt to
several tasks. What stays is the work itself: n texts that are all just under the threshold
to each other share rare shingles, and an exact answer must compare each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import (
    LOWER, NOT_SPACE, STEP_BYTES, Scratch, every_block, free_name, gram_hashes, heavy_keys, in_blocks, mix64, salted_join, signed, steps, word_hashes, word_spans,
)

SHINGLE, BANDS, ROWS = 5, 32, 4
_U, _V = np.uint64, np.uint32
#: Values that a block of signature work holds: small enough for a core's cache.
_BLOCK = 1 << 14


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than k words has its whole sequence."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    sets = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        else:
            sets.append(mix64(gram_hashes(words[a:b], b - a) + _U(b - a)) if b > a else np.zeros(0, _U))
    return sets


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place on 32-bit values."""
    t = x >> _V(16)
    x ^= t
    x *= _V(0x85EBCA6B)
    np.right_shift(x, _V(13), out=t)
    x ^= t
    x *= _V(0xC2B2AE35)
    np.right_shift(x, _V(16), out=t)
    x ^= t
    return x


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """One row of coordinates per non-empty set, by the circulant scheme."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, _V)
    at = 0
    while at < len(sets):
        to, held = at + 1, len(sets[at])
        while to < len(sets) and held + len(sets[to]) <= _BLOCK:
            held += len(sets[to])
            to += 1
        block = np.concatenate(sets[at:to])
        sigma = (mix64(block * _U(0xD1342543DE82EF95) + _U(1)) >> _U(32)).astype(_V)
        cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:to]])[:-1]])
        for k in range(coordinates):
            out[at:to, k] = np.minimum.reduceat(_pi(sigma + _V(k)), cuts)
        at = to
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
    names = ["row", "doc_id", "n", "f1", "f2", "bands", "body"]
    salt = mix64(np.arange(BANDS, dtype=_U))
    for batch in batches:
        ids = batch.column(0)
        for at, data, offsets in steps(batch.column(1)):
            sets = shingle_sets(data, offsets)
            n = np.array([len(s) for s in sets], np.int64)
            f1 = np.array([mix64(s).sum(dtype=_U) if len(s) else 0 for s in sets], _U)
            f2 = np.array([np.bitwise_xor.reduce(mix64(s + _U(77))) if len(s) else 0 for s in sets], _U)
            full = np.flatnonzero(n)
            keys = np.zeros((len(sets), BANDS), np.int64)
            if len(full):
                pairs = signatures([sets[i] for i in full]).view(_U).reshape(len(full), BANDS, ROWS // 2)
                key = np.broadcast_to(salt, pairs.shape[:2])
                for j in range(ROWS // 2):
                    key = mix64(key ^ pairs[:, :, j])
                keys[full] = signed(key)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            raw = data.tobytes()
            bodies = [pack.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            numbers = pa.array(np.arange(number, number + len(sets)))
            number += len(sets)
            columns = [numbers, ids.slice(at, len(sets)).cast(pa.int64()), pa.array(n), pa.array(signed(f1)), pa.array(signed(f2)), lists, pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    unpack = zstandard.ZstdDecompressor()
    last: tuple = (None, None)

    def sets_of(bodies: list[bytes]) -> list[np.ndarray]:
        out, part, held = [], [], 0
        for raw in map(unpack.decompress, bodies):
            part.append(raw)
            held += len(raw)
            if held > STEP_BYTES:
                out += read(part)
                part, held = [], 0
        return out + (read(part) if part else [])

    def read(part: list[bytes]) -> list[np.ndarray]:
        return shingle_sets(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]))

    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            left, right = part.column(2), sets_of(part.column(3).to_pylist())
            good = []
            for i, s in enumerate(right):
                if last[0] != a[i]:
                    last = (a[i], sets_of([left[i].as_py()])[0])
                small, large = sorted((s, last[1]), key=len)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(s) + len(last[1]) - both):
                    good.append(i)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], names=["a", "b"])


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table that pass on the full sets; bodies has (id, body)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("rows"))
    heavy = heavy_keys(ids, ["id"], "rows", 2 * pairs.count())  # one table for both ends, so that the bodies are shuffled once
    ends = {x: None if heavy is None else heavy.withColumnRenamed("id", x) for x in ("a", "b")}
    joined = salted_join(pairs, bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), ["b"], "a", ends["b"])
    joined = salted_join(joined, bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), ["a"], "b", ends["a"])
    return joined.select("a", "b", "body_a", "body_b").mapInArrow(lambda x: _confirm(x, percent), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, c, n, token): every shingle of the documents, one row each."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at in range(0, len(batch), 64):
            raw = [unpack.decompress(x.as_py()) for x in batch.column(2).slice(at, 64)]
            sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
            n = np.array([len(x) for x in sets])
            columns = [np.repeat(x, n) for x in (ids[at : at + 64], c[at : at + 64], n)] + [signed(np.concatenate(sets))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "c", "n", "token"])


def _prefix_pairs(open_: DataFrame, bodies: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of open_(doc_id, c) in different components c, losing no link.

    Two sets of similarity t share a shingle among the n - ceil(t n) + 1 first of each in
    any common order, and the first that they share stands so early in both that what
    follows can still make up the overlap t (n_a + n_b) / (1 + t). In the order of document
    frequency, rarest first, a document whose own text fills its prefix has no candidates,
    whatever passages it shares. Of a shared shingle only documents outside its most
    frequent component look for partners.
    """
    rows = open_.join(bodies.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "c", "body")
    tokens = rows.mapInArrow(_tokens, "doc_id long, c long, n long, token long")
    repeated = scratch.write(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "repeated")
    total = repeated.agg(F.sum("df")).first()[0] or 0
    known = salted_join(tokens, repeated, ["token"], "doc_id", heavy_keys(repeated, ["token"], "df", total))
    doc = Window.partitionBy("doc_id")
    known = known.withColumn("rank", F.row_number().over(doc.orderBy("df", "token"))).withColumn("others", F.col("n") - F.count("*").over(doc))
    known = known.withColumn("i", F.col("others") + F.col("rank"))
    prefix = scratch.write(known.filter(f"i <= n - ceil({percent} * n / 100) + 1").select("doc_id", "c", "n", "i", "token"), "prefix")
    sizes = prefix.groupBy("token", "c").agg(F.count("*").alias("m"))
    most = sizes.groupBy("token").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("parts"), F.sum("m").alias("rows")).filter("parts > 1")
    most = scratch.write(most.select("token", F.col("top.c").alias("top"), "rows"), "most")
    heavy = heavy_keys(most, ["token"], "rows", most.agg(F.sum("rows")).first()[0] or 0)
    shared = scratch.write(salted_join(prefix, most.drop("rows"), ["token"], "doc_id", heavy), "shared")
    other = in_blocks(shared, ["token"], "doc_id", heavy)
    other = other.select("token", "block", F.col("doc_id").alias("d"), F.col("n").alias("n_d"), F.col("i").alias("i_d"), F.col("c").alias("c_d"))
    near = f"100 * least(n, n_d) >= {percent} * greatest(n, n_d) and {100 + percent} * (1 + least(n - i, n_d - i_d)) >= {percent} * (n + n_d)"
    met = every_block(shared.filter("c <> top"), ["token"], heavy).join(other, ["token", "block"]).filter(f"c <> c_d and {near}")
    return met.select(F.least("doc_id", "d").alias("a"), F.greatest("doc_id", "d").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), by alternating large and small stars.

    Smallest nodes have no row. The table is in the folder of the tables that begin with tag.

    Both stars use only grouped minima and joins, so a hub's neighbours are never gathered
    in one row; each round is written to the shared folder.
    """
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    before, step, total = None, 0, now.count()
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("m", "u").alias("m"), "rows")
        large = salted_join(both.filter("v > u"), low.drop("rows"), ["u"], "v", heavy_keys(low, ["u"], "rows", 2 * total)).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.filter("u <> v").distinct(), f"{tag}-l{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        joined = salted_join(large, least.drop("rows"), ["u"], "v", heavy_keys(least, ["u"], "rows", total))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.write(small.filter("u <> v").distinct(), f"{tag}-{step + 1}")
        count = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}-{step}", f"{tag}-l{step}")
        if tuple(count) == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, before, step, total = after, tuple(count), step + 1, count[0]


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased. A text of fewer than five
    words is one shingle; one without words, empty or null has none and links with
    nothing. Ties and repeated rows: rows with one id are one document, with the links of
    all of them. A row with a null id links with nothing and is kept. Other columns of
    docs are not read; an empty table gives an empty result.

    A pair at the threshold shares no band with a probability of about 5e-6; a link that
    is found is exact. percent: least Jaccard similarity in hundredths.
    """
    scratch = Scratch(docs.sparkSession, "near")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.write(source.mapInArrow(_sketch, "row long, doc_id long, n long, f1 long, f2 long, bands array<long>, body binary"), "sketch")
    full = sketch.filter("n > 0 and doc_id is not null")
    bodies = full.select(F.col("doc_id").alias("id"), "body")

    # Rows of equal sets, by fingerprint and then by the whole sets: `same` leads a row to the row that stands for its class.
    key = ["n", "f1", "f2"]
    classes = full.groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("rows")).filter("rows > 1")
    classes = scratch.write(classes.select(*key, F.col("rep.row").alias("a"), F.col("rep.doc_id").alias("rep"), "rows"), "classes")
    heavy = heavy_keys(classes, key, "rows", classes.agg(F.sum("rows")).first()[0] or 0)
    twins = salted_join(full.select("row", "doc_id", *key), classes.drop("rows"), key, "row", heavy).filter("a <> row")
    twins = scratch.write(twins.select("a", F.col("row").alias("b"), "doc_id", "rep"), "twins")
    equal = _verified(twins.select("a", "b"), full.select(F.col("row").alias("id"), "body"), 100)
    same = scratch.write(twins.join(equal.select(F.col("b").alias("row")), F.col("b") == F.col("row")).select("row", "doc_id", "rep"), "same")
    again = full.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    again = same.join(again, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))  # ids with several texts link all their classes
    reps = full.select("row", "doc_id", "n", "bands").join(same.select("row"), "row", "left_anti")
    bands = scratch.write(reps.select("doc_id", "n", F.explode("bands").alias("key")), "bands")

    # First round: each bucket against its leader, its smallest document.
    leaders = bands.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("lead"), F.max("doc_id").alias("top"), F.count("*").alias("rows")).filter("top > lead.doc_id")
    leaders = scratch.write(leaders.select("key", F.col("lead.doc_id").alias("a"), F.col("lead.n").alias("n_a"), "rows"), "leaders")
    heavy = heavy_keys(leaders, ["key"], "rows", leaders.agg(F.sum("rows")).first()[0] or 0)
    near = f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)"
    pairs = salted_join(bands, leaders.drop("rows"), ["key"], "doc_id", heavy).filter("a <> doc_id").filter(near).select("a", F.col("doc_id").alias("b")).distinct()
    pairs = scratch.write(pairs, "pairs")
    links = scratch.write(_verified(pairs, bodies, percent).unionByName(again), "links")
    first = components(links, scratch, "first")

    # Second round: documents of buckets that still hold several components, by an exact prefix filter.
    split = salted_join(bands, leaders.select("key"), ["key"], "doc_id", heavy).join(first, F.col("doc_id") == F.col("node"), "left")
    split = scratch.write(split.select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")), "split")
    mixed = scratch.write(split.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"), "mixed")
    open_ = salted_join(split, mixed, ["key"], "doc_id", heavy).groupBy("doc_id").agg(F.min("c").alias("c"))
    rest = _prefix_pairs(scratch.write(open_, "open"), bodies, scratch, percent)
    rest = scratch.write(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    more = scratch.write(_verified(rest, bodies, percent), "more")

    # What the second round found links components of the first, so only these are joined again.
    ends = more.join(first.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a", "left")
    ends = ends.join(first.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b", "left")
    last = components(ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), scratch, "last")

    sizes = first.groupBy("component").agg(F.count("*").alias("rows"))
    heavy = heavy_keys(sizes, ["component"], "rows", first.count())
    moved = salted_join(first, last.select(F.col("node").alias("component"), F.col("component").alias("c")), ["component"], "node", heavy, "left")
    ends = moved.select(F.col("node").alias("rep"), F.coalesce("c", "component").alias("component_id"))
    ends = ends.unionByName(last.select(F.col("node").alias("rep"), F.col("component").alias("component_id")))  # a root of the first is no node of it
    heavy = heavy_keys(classes.groupBy("rep").agg(F.sum("rows").alias("rows")), ["rep"], "rows", full.count())
    rows = sketch.select("row", "doc_id", "n").join(same.select("row", "rep"), "row", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = salted_join(rows, ends, ["rep"], "row", heavy, "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    out = scratch.write(out, "out")
    scratch.drop("sketch", "classes", "twins", "same", "bands", "leaders", "pairs", "links", "split", "mixed", "open")
    scratch.drop("repeated", "prefix", "most", "shared", "rest", "more", "first-*", "last-*")
    return out


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document stays, one document of each component, with all their columns."""
    key = free_name(docs, "stay")
    stay = near_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")


#: Shingles, links and reachability in plain SQL; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
h AS (SELECT doc_id, n, hash(gram) AS gram FROM g),
j AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM j WHERE 100 * shared >= 75 * (na + nb - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x WHERE r.c < e.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m USING (doc_id)
"""
