"""Shared pieces of the training-data operators: scratch tables and Arrow text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer text is a step of its own.
STEP_BYTES = 1 << 19

#: `[\x20\x09-\x0D]`: the white space of the word and size definitions.
SPACE = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session uses a temporary folder, and one on a cluster is refused, as its machines share
    no such folder. A written table is read again with the schema it was written with, so
    empty tables work. ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            base = tempfile.gettempdir() + "/weftgraph-checkpoints"
        self.base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df, in folders by a column if one is given, and reads it again."""
        path = f"{self.base}/{name}"
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables by name or by pattern, as in `step-*`."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in fs.globStatus(path) or []:
                fs.delete(found.getPath(), True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than 1 / HEAVY of all rows is dealt to several tasks; there are fewer than HEAVY such keys.
HEAVY = 4096
#: Rows below which a whole table is no burden for one task, so that none of its keys is.
LIGHT = 1 << 14


def heavy_keys(sizes: DataFrame, keys: list[str], rows: str, total: int, least: int = 500, light: int = LIGHT) -> DataFrame | None:
    """(keys, blocks): the keys with more rows than max(least, total / HEAVY), and how many tasks share one.

    sizes has a key's number of rows in the column `rows`, total is the sum; None if it is
    below `light`. Fewer than HEAVY keys can be that heavy, so the result may be broadcast
    whatever the corpus.
    """
    if total < light:
        return None
    limit = max(least, total // HEAVY)
    return sizes.filter(F.col(rows) > limit).select(*keys, F.ceil(F.col(rows) / limit).cast("int").alias("blocks"))


def every_block(one: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """one with a column `block`: each row once for every block of its key."""
    if heavy is None:
        return one.withColumn("block", F.lit(0))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    return one.join(F.broadcast(heavy), keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")


def is_small(df: DataFrame) -> bool:
    """Whether Spark's own measure of a plan's size lets it broadcast the result."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def in_blocks(many: DataFrame, keys: list[str], spread: str, heavy: DataFrame | None) -> DataFrame:
    """many with a column `block`: rows of a heavy key are dealt to its blocks by a hash of `spread`."""
    if heavy is None:
        return many.withColumn("block", F.lit(0))
    block = F.pmod(F.xxhash64(spread), F.coalesce(F.col("blocks"), F.lit(1))).cast("int")
    return many.join(F.broadcast(heavy), keys, "left").withColumn("block", block).drop("blocks")


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """The inner or left join by keys; rows of a heavy key in `many` are dealt to its blocks by a hash of `spread`, its rows in `one` go to each.

    Where one side is small enough to be broadcast, no key is dealt anywhere, and Spark joins as it likes.
    """
    if heavy is None or is_small(one) or how == "inner" and is_small(many):
        return many.join(one, keys, how)
    return in_blocks(many, keys, spread, heavy).join(every_block(one, keys, heavy), [*keys, "block"], how).drop("block")


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry truth table, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`; UTF-8 bytes of other characters are never white space.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
LETTERS = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def steps(column: pa.Array, limit: int = STEP_BYTES):
    """Yields (first row, text bytes, offsets) of consecutive rows of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def text_steps(column: pa.Array, limit: int = STEP_BYTES):
    """(first row, texts) of consecutive rows in parts of about `limit` bytes; null is empty, a longer text is a part of its own."""
    part, at, held = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        part.append(t)
        held += 4 * len(t)
        if held >= limit:
            yield at, part
            part, at, held = [], i + 1, 0
    if part:
        yield at, part


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Byte starts and ends of the words of all rows, and where each row's words begin (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = _U(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2^64."""
    if len(_powers.get("p", ())) < n:
        n = max(n, STEP_BYTES + (1 << 17))
        inverse = pow(int(_BASE), -1, 1 << 64)
        for key, base in (("p", int(_BASE)), ("i", inverse)):
            table = np.full(n, _U(base), _U)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=_U)
    return _powers["p"], _powers["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with full avalanche."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    power, inverse = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, across rows too; len(words) - k + 1 of them."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, _U)
    for j in range(k):
        total = total * _BASE + words[j : j + n]
    return mix64(total)


def within(row_words: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Which of the n_words - k + 1 runs of k words lie inside one row."""
    ok = np.ones(max(0, n_words - k + 1), bool)
    for cut in row_words[1:-1]:
        ok[max(0, cut - k + 1) : cut] = False
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
