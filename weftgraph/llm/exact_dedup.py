"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`. The build has four steps:

1. Page files. Each task hashes its normalised texts and pre-aggregates equal ones. A text
   that comes again stays in the task's memory past a flush, so a group that holds a third
   of all rows sends one entry a task, not its rows. Entries (with text) and members
   (without) are written to the shared folder.
2. Directory. It starts as one bucket. Each round measures what the overfull buckets hold
   by the next bits of the hash and splits them; the directory doubles when a split
   bucket's local depth was the global one. A bucket of one single hash is not split: its
   texts are chained. There is no other limit on the depth.
3. Owners. The directory says in which bucket an entry lives, and each bucket has one owner
   task. It walks its entries in hash order; those of one hash form a chain: bytes are
   compared, different texts that share a hash get chain places of their own, and the best
   row of each text is kept. A bucket is written as files of its own, `bucket=<number>`.
4. Lookup. A member's hash leads through the directory to its bucket, and its entry number
   to the record in the bucket's file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, Scratch, free_name

#: Bytes of distinct text that a task pre-aggregates before it flushes its entries.
FLUSH_BYTES = 8 << 20
#: Of a flush, bytes of texts that came more than once and stay in memory for what follows.
HOT_BYTES = 2 << 20
#: Bits of the hash by which a round splits an overfull bucket.
ROUND_BITS = 4
#: Buckets at most: beyond so many times bucket_bytes of distinct text, buckets get larger instead.
MOST_BUCKETS = 1 << 16

_PAGE = "doc_id long, chars long, entry long, hash long, size long, text binary, text_sha256 string"
_SIGN = -(1 << 63)


def _better(chars: int, doc_id: int | None, e: list) -> bool:
    """Whether a row goes before the best one so far: more code points, then the smaller id, null last."""
    return (-chars, doc_id is None, doc_id or 0) < (-e[1], e[2] is None, e[2] or 0)


def _pages(batches: Iterator[pa.RecordBatch], hash_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of _PAGE: text is set in entries (best row of a text in this task or flush) and null in members."""
    from pyspark import TaskContext

    number = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
    members: list[tuple] = []
    entries: dict[bytes, list] = {}  # text: [entry, chars, doc_id, rows, hash, sha256]
    held = 0
    schema = pa.schema(
        [("doc_id", pa.int64()), ("chars", pa.int64()), ("entry", pa.int64()), ("hash", pa.int64())]
        + [("size", pa.int64()), ("text", pa.binary()), ("text_sha256", pa.string())]
    )

    def flush(last: bool) -> pa.RecordBatch:
        hot, room = {}, 0 if last else HOT_BYTES
        for text, e in sorted(entries.items(), key=lambda x: -x[1][3]):
            if e[3] < 2 or len(text) + 200 > room:
                break
            hot[text] = e
            room -= len(text) + 200
        rows = members + [(e[2], e[1], e[0], e[4], e[3], text, None) for text, e in entries.items() if text not in hot]
        members.clear()
        entries.clear()
        entries.update(hot)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_id, text = doc_id.as_py(), text.as_py() or ""
            bare = text.encode().translate(None, SPACE)
            e = entries.get(bare)
            if e is None:
                code = xxhash.xxh64_intdigest(bare) >> (64 - hash_bits) << (64 - hash_bits)
                e = entries[bare] = [number, len(text), doc_id, 0, code + _SIGN, hashlib.sha256(bare).hexdigest()]
                number += 1
                held += len(bare) + 200
            elif _better(len(text), doc_id, e):
                e[1], e[2] = len(text), doc_id
            e[3] += 1
            members.append((doc_id, len(text), e[0], e[4], None, None, e[5]))
            if held > FLUSH_BYTES or len(members) > 100_000:
                yield flush(False)
                held = sum(len(t) + 200 for t in entries)
    if entries:
        yield flush(True)


class Directory:
    """An extendible-hash directory: ``2 ** depth`` slots of the hash's leading bits, each led to its bucket.

    Neighbouring slots that share a bucket are stored once, as the bucket's first hash, so
    the directory takes 17 bytes a bucket however deep one of them is.
    """

    def __init__(self) -> None:
        self.starts = np.zeros(1, np.uint64)
        self.local = np.zeros(1, np.uint8)

    @property
    def depth(self) -> int:
        """The global depth: that of the deepest bucket."""
        return int(self.local.max())

    def slots(self) -> list[int]:
        """The bucket of every slot, for small depths."""
        return self.bucket(np.arange(1 << self.depth, dtype=np.uint64) << np.uint64(64 - self.depth) if self.depth else np.zeros(1, np.uint64)).tolist()

    def bucket(self, codes: np.ndarray) -> np.ndarray:
        """The buckets where hashes (unsigned) live."""
        return np.searchsorted(self.starts, codes, "right") - 1

    def split(self, number: int, bits: int) -> None:
        """Splits a bucket by its next bits; the directory doubles as often as its local depth passes the global one."""
        local = int(self.local[number]) + bits
        steps = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - local)
        self.starts = np.concatenate([self.starts[:number], self.starts[number] + steps, self.starts[number + 1 :]])
        self.local = np.concatenate([self.local[:number], np.full(1 << bits, local, np.uint8), self.local[number + 1 :]])

    def merge(self, mass: np.ndarray, capacity: int) -> None:
        """Takes back splits that were not needed: twins that fit into one bucket together become one.

        So do twins of which one is empty: what is over capacity then holds one hash, which no split divides.
        """
        starts, local, sizes = [], [], []
        for start, depth, size in zip(self.starts.tolist(), self.local.tolist(), mass.tolist(), strict=True):
            while local and local[-1] == depth and start >> (64 - depth) & 1 and starts[-1] >> (64 - depth) == (start >> (64 - depth)) - 1 and (sizes[-1] + size <= capacity or not (sizes[-1] and size)):
                start, depth, size = starts.pop(), local.pop() - 1, sizes.pop() + size
            starts.append(start)
            local.append(depth)
            sizes.append(size)
        self.starts, self.local = np.array(starts, np.uint64), np.array(local, np.uint8)


def grow_directory(measure, capacity: int) -> Directory:
    """Splits overfull buckets by rounds until all fit.

    measure: given a directory and the overfull buckets, the bytes of each of their parts
    by the next ROUND_BITS bits, and whether a part holds more than one hash:
    {(bucket, part): (bytes, several)}. Rounds that split by several bits are taken back
    where a smaller split would have done.
    """
    directory = Directory()
    mass, todo = np.zeros(1, np.int64), [0]
    while todo:
        found = measure(directory, todo)
        several = np.zeros(len(mass), bool)
        for number in reversed(todo):  # from the last one, so that the numbers before it stay
            bits = min(ROUND_BITS, 64 - int(directory.local[number]))
            parts = [found.get((number, p), (0, False)) for p in range(1 << bits)]
            directory.split(number, bits)
            mass = np.concatenate([mass[:number], np.array([p[0] for p in parts], np.int64), mass[number + 1 :]])
            several = np.concatenate([several[:number], np.array([p[1] for p in parts], bool), several[number + 1 :]])
        todo = [int(i) for i in np.flatnonzero((mass > capacity) & several)]
    directory.merge(mass, capacity)
    return directory


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a bucket's entries sorted by hash; the chain of one hash is in memory at a time."""
    chain: dict[bytes, list] = {}
    at = None

    def finish(bucket: int) -> pa.RecordBatch:
        rows = [(bucket, number, e[1], e[0], e[2], place) for place, e in enumerate(chain.values()) for number in e[3]]
        chain.clear()
        names = ["bucket", "entry", "keep_id", "keep_chars", "group_size", "place"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        texts = batch.column(6)
        for i, (bucket, doc_id, chars, number, code, size) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if at != (bucket, code):
                if chain:
                    ready.append(finish(at[0]))
                at = (bucket, code)
            text = texts[i].as_py()
            e = chain.get(text)  # the dictionary compares whole bytes
            if e is None:
                chain[text] = [chars, doc_id, size, [number]]
            else:
                if _better(chars, doc_id, [None, e[0], e[1]]):
                    e[0], e[1] = chars, doc_id
                e[2] += size
                e[3].append(number)
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            ready = []
    if chain:
        yield finish(at[0])


def build_index(entries: DataFrame, scratch: Scratch, bucket_bytes: int) -> tuple[Directory, DataFrame]:
    """The directory, and the index (bucket, entry, keep_id, keep_chars, group_size, place) in files by bucket."""
    spark = entries.sparkSession
    sizes = entries.select("hash", (F.octet_length("text") + 64).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    capacity = max(bucket_bytes, total // (MOST_BUCKETS // 2))

    def measure(directory: Directory, todo: list[int]) -> dict:
        shared = spark.sparkContext.broadcast((directory, np.array(todo)))  # 17 bytes a bucket, MOST_BUCKETS at most

        def part(codes: pd.Series) -> pd.Series:
            directory, todo = shared.value
            code = codes.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            number = directory.bucket(code)
            local = directory.local[number].astype(np.uint64)
            bits = np.minimum(np.uint64(ROUND_BITS), np.uint64(64) - local)
            piece = np.where(local < 64, (code << np.minimum(local, np.uint64(63))) >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), 0)
            return pd.Series(np.where(np.isin(number, todo), number.astype(np.int64) << ROUND_BITS | piece.astype(np.int64), -1))

        found = sizes.withColumn("part", F.pandas_udf(part, "long")("hash")).filter("part >= 0").groupBy("part")
        found = found.agg(F.sum("bytes").alias("bytes"), (F.min("hash") < F.max("hash")).alias("several"))
        rows = found.collect()  # at most 2 ** ROUND_BITS rows an overfull bucket
        shared.unpersist()
        return {(r.part >> ROUND_BITS, r.part & (1 << ROUND_BITS) - 1): (r.bytes, r.several) for r in rows}

    directory = grow_directory(measure, capacity) if total > capacity else Directory()
    tasks = len(directory.starts)
    owned = (
        entries.withColumn("bucket", bucket_of(spark, directory)("hash"))
        .select("bucket", "doc_id", "chars", "entry", "hash", "size", "text")
        .repartitionById(tasks, F.col("bucket").cast("int"))
        .sortWithinPartitions("bucket", "hash")
        .mapInArrow(_own, "bucket long, entry long, keep_id long, keep_chars long, group_size long, place long")
    )
    return directory, scratch.write(owned, "index", by="bucket")


def bucket_of(spark, directory: Directory):
    """A column function: the bucket of a hash, by the directory."""
    shared = spark.sparkContext.broadcast(directory)  # 17 bytes a bucket, MOST_BUCKETS at most

    def look(codes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.bucket(codes.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)))

    return F.pandas_udf(look, "long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, keep_chars.

    A null text counts as empty, and all texts of white space only are equal to it. Of
    equal texts the one with the most code points stays, then the smallest id; a null id
    comes last and is kept only if it is alone with its text or all ids are null. Rows
    that repeat an id are rows of their own in group_size, and share the decision of that
    id. Texts of any length are whole: a single one is in memory at a time beside a flush
    of FLUSH_BYTES. Other columns of docs are not read. An empty table gives an empty
    result.

    bucket_bytes: text bytes at which a bucket is split; larger where the corpus would need
    more than MOST_BUCKETS of them. Owners read a bucket sorted and as a stream, so it need
    not fit into memory. hash_bits: bits of the hash that count (fewer force longer
    chains, for tests).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pages = scratch.write(source.mapInArrow(lambda b: _pages(b, hash_bits), _PAGE), "pages")
    directory, index = build_index(pages.filter("text is not null"), scratch, bucket_bytes)
    members = pages.filter("text is null").select("doc_id", "hash", "entry", "text_sha256").withColumn("bucket", bucket_of(spark, directory)("hash"))
    out = members.join(index, ["bucket", "entry"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_chars"
    )
    out = scratch.write(out, "out")
    scratch.drop("pages", "index")
    return out


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns.

    A row is known by its id, text and length, so rows that repeat an id with another text
    are judged on their own. Of rows that agree in all three one stays, by a hash of all
    columns but maps; each task drops such repeats before anything is shuffled.
    """
    row, key, stay_key = (free_name(docs, x) for x in ("row_no", "exact_key", "stay_key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(F.translate(text, "".join(map(chr, SPACE)), ""), 256)

    def named(doc_id, sha, chars):
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), sha, chars.cast("string"))

    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    first = Window.partitionBy(key).orderBy(order)
    rows = docs.withColumn(key, named(F.col(id_col), sha, F.char_length(text))).withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1)
    stay = exact_dedup(docs, id_col, text_col).filter("kept").select(named(F.col("keep_id"), F.col("text_sha256"), F.col("keep_chars")).alias(stay_key)).distinct()
    return rows.join(stay, F.col(key) == F.col(stay_key), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: Equal texts by their normalised bytes, the rest of the decision by plain aggregates.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents),
g AS (
  SELECT bare, count(*) AS group_size,
         first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM t GROUP BY bare)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.bare) AS text_sha256
FROM t JOIN g USING (bare)
"""
