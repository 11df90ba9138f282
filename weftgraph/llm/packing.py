"""Packing by optimal length buckets.

Documents are cut into sequences of at most `max_len` words, so the global histogram of
sequence lengths has at most `max_len` rows whatever the corpus. Dynamic programming over
the histogram chooses the bucket boundaries that minimise padding. Inside a bucket of
width L, batches of ``budget // L`` sequences form under the token budget.

All of it is DataFrame code but the dynamic programme, which runs on the driver over the
bounded histogram. Ranks inside a bucket are two-level: counts of bins, then a row number
inside each bin, so a hot bucket is spread over its bins. The order is that of a hash, or
that of the rows in their files, so that a corpus sorted by training position is batched in
windows of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch
from .curriculum import word_count


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding for {length: count}.

    Padding of lengths i < l <= j in one bucket is ``sum of count * (j - l)``. The cost is
    Monge, so each row of the programme is filled by divide and conquer over numpy slices.
    """
    lengths = sorted(x for x, c in histogram.items() if c > 0)
    if not lengths:
        return []
    size = np.array([0, *lengths], np.float64)
    count = np.cumsum([0, *(histogram[x] for x in lengths)], dtype=np.float64)
    total = np.cumsum([0, *(histogram[x] * x for x in lengths)], dtype=np.float64)
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, n)):
        following, pick = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        following[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            at = np.arange(first, min(last, mid - 1) + 1)
            cost = best[at] + size[mid] * (count[mid] - count[at]) - (total[mid] - total[at])
            k = int(np.argmin(cost))
            following[mid], pick[mid] = cost[k], at[k]
            todo += [(lo, mid - 1, first, int(at[k])), (mid + 1, hi, int(at[k]), last)]
        best = following
        choice.append(pick)
    bounds, j = [], n
    for pick in reversed(choice):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = int(pick[j])
    return sorted(bounds)


def numbered(df: DataFrame, keys: list[str], bins: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number (from 0) of each row among those of its keys, by bins and inside a bin by order.

    Keys and bins hold no nulls. Only one bin's rows are ever in one window.
    """
    before = Window.partitionBy(*keys).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, *bins).agg(F.count("*").alias("in_bin"))
    counts = counts.withColumn("front", F.coalesce(F.sum("in_bin").over(before), F.lit(0))).drop("in_bin")
    inner = F.row_number().over(Window.partitionBy(*keys, *bins).orderBy(*order))
    return df.withColumn(name, inner.cast("long") - 1).join(counts, [*keys, *bins]).withColumn(name, F.col("front") + F.col(name)).drop("front")


#: Rows of a file that one bin holds.
BIN_ROWS = 1 << 16


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, buckets: int = 16, budget: int = 65536, bins: int = 1024, in_order: bool = False
) -> DataFrame:
    """One row per sequence: doc_id, copy, part, n_tokens, bucket, batch, slot, padding.

    A token is a word `[^\\x20\\x09-\\x0D]+`. A text of more than max_len words gives
    several sequences (part 0, 1, ...), all of max_len words but the last; an empty or null
    text gives one sequence of 0 tokens in the first bucket. Rows that repeat an id are
    told apart by copy (0, 1, ...). Sequences of one length that tie in the order are
    ranked by id, copy and part. bucket is the bucket's width, (bucket, batch) names a
    batch, slot is the place in it, padding is bucket - n_tokens. An empty table gives an
    empty result; other columns of docs are not read.

    max_len bounds the histogram on the driver. A batch holds at most budget tokens,
    padding included, or one sequence. in_order: docs was read from Parquet files that
    Spark wrote, and a bucket's batches follow the rows' order in them, the files by
    number; otherwise the order is that of a hash of id, copy and part.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    words = [F.col(id_col).alias("doc_id"), word_count(text_col).alias("words")]
    if in_order:
        file = docs.metadataColumn("_metadata")
        at = F.regexp_extract(file["file_name"], r"^part-([0-9]+)", 1).cast("long")
        words += [F.coalesce(at, F.lit(-1)).alias("file_no"), file["file_name"].alias("file"), file["row_index"].alias("row")]
    sized = scratch.write(docs.select(*words), "sized")
    if in_order:
        place, order = ["file_no", "file", "bin"], ["row", "part"]
        rows = sized.withColumn("bin", F.expr(f"row div {BIN_ROWS}")).withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.lit("n")))
        rows = numbered(rows, ["key"], place, ["row"], "copy").drop("key")
    else:
        place, order = ["bin"], ["place", "doc_id", "copy", "part"]
        # Rows of one id and length are alike, so their copies are numbered by counts, written out in pieces of 1000.
        ids = sized.groupBy("doc_id", "words").agg(F.count("*").alias("times"))
        before = Window.partitionBy("doc_id").orderBy("words").rowsBetween(Window.unboundedPreceding, -1)
        ids = ids.withColumn("front", F.coalesce(F.sum("times").over(before), F.lit(0)))
        rows = ids.withColumn("piece", F.explode(F.expr("sequence(0L, (times - 1) div 1000)")))
        rows = rows.select("doc_id", "words", F.explode(F.expr("sequence(front + 1000 * piece, front + least(times, 1000 * piece + 1000) - 1)")).alias("copy"))
    parts = F.expr(f"sequence(0L, greatest(0L, (words - 1) div {max_len}))")
    cut = rows.withColumn("part", F.explode(parts))
    cut = cut.withColumn("n_tokens", F.least(F.col("words") - F.col("part") * max_len, F.lit(max_len).cast("long"))).drop("words")
    if not in_order:
        hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", "part"))
        cut = cut.withColumn("place", hashed).withColumn("bin", F.conv(F.substring("place", 1, 4), 16, 10).cast("int") % bins)
    cut = scratch.write(cut, "cut")
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("n_tokens").count().collect()}  # at most max_len + 1 rows
    bounds = optimal_buckets(histogram, buckets) or [max_len]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    ranked = numbered(cut.withColumn("bucket", bucket.cast("long")), ["bucket"], place, order, "rank")
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div greatest(bucket, 1L)"))
    out = ranked.withColumn("room", room).select(
        "doc_id", "copy", "part", "n_tokens", "bucket", F.expr("rank div room").alias("batch"), (F.col("rank") % F.col("room")).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding")
    )
    out = scratch.write(out, "out")
    scratch.drop("sized", "cut")
    return out


def oracle(max_len: int = 4096, buckets: int = 16, budget: int = 65536, bins: int = 1024) -> str:
    """DuckDB SQL of pack in the order of the hash; the dynamic programme has one table a bucket."""
    steps = ["f0 AS (SELECT 0::BIGINT AS j, 0::DOUBLE AS v, 0::BIGINT AS pick)"]
    back = [f"k{buckets} AS (SELECT max(j) AS j FROM l)"]
    for t in range(1, buckets + 1):
        steps.append(
            f"f{t} AS (SELECT * FROM f0 UNION ALL SELECT pc.j, min(f.v + cost), first(pc.i ORDER BY f.v + cost, pc.i) FROM pc JOIN f{t - 1} f ON f.j = pc.i GROUP BY pc.j)"
        )
        back.append(f"k{buckets - t} AS (SELECT f.pick AS j FROM f{buckets - t + 1} f JOIN k{buckets - t + 1} USING (j))")
    chosen = " UNION ALL ".join(f"SELECT j FROM k{t}" for t in range(buckets + 1))
    return f"""
WITH d AS (
  SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS words
  FROM documents),
c AS (SELECT doc_id, words, row_number() OVER (PARTITION BY doc_id ORDER BY words) - 1 AS copy FROM d),
p AS (SELECT doc_id, words, copy, unnest(range(0, greatest(0, (words - 1) // {max_len}) + 1)) AS part FROM c),
s AS (SELECT doc_id, copy, part, least(words - part * {max_len}, {max_len}) AS n FROM p),
h AS (SELECT n, count(*) AS c FROM s GROUP BY n),
l AS (
  SELECT row_number() OVER (ORDER BY n) AS j, n, sum(c) OVER (ORDER BY n) AS cc, sum(c * n) OVER (ORDER BY n) AS tt FROM h
  UNION ALL SELECT 0, 0, 0, 0),
pc AS (SELECT a.j AS i, b.j AS j, CAST(b.n * (b.cc - a.cc) - (b.tt - a.tt) AS DOUBLE) AS cost FROM l a JOIN l b ON a.j < b.j),
{", ".join(steps)}, {", ".join(back)},
bounds AS (SELECT n FROM l WHERE j > 0 AND j IN ({chosen})),
w AS (SELECT s.n, min(b.n) AS bucket FROM (SELECT DISTINCT n FROM s) s JOIN bounds b ON b.n >= s.n GROUP BY s.n),
m AS (SELECT s.*, w.bucket, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), copy, part)) AS place FROM s JOIN w USING (n)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ('0x' || substr(place, 1, 4))::INT % {bins}, place, doc_id, copy, part) - 1 AS rank,
         greatest(1, {budget} // greatest(bucket, 1)) AS room
  FROM m)
SELECT doc_id, copy::BIGINT AS copy, part::BIGINT AS part, n::BIGINT AS n_tokens, bucket::BIGINT AS bucket, (rank // room)::BIGINT AS batch,
       (rank % room)::BIGINT AS slot, (bucket - n)::BIGINT AS padding
FROM r
"""
