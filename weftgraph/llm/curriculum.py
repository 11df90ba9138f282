"""Mixing sources to target weights with a time-varying curriculum.

Each source s has a weight schedule over training time t in [0, 1]:
``w_s(t) = target_s * (1 + tilt_s * (2 t - 1))``. Its integral ``target_s * (t + tilt_s *
(t * t - t))`` is the cumulative token demand; the whole is the source's target. A source's
documents form a stream in a fixed pseudo-random order, repeated up to three times, and the
document that covers stream offset c trains at the time t whose cumulative demand is c.
The mix is the documents of all sources range-sorted by that position.

Everything is DataFrame code. Stream offsets are two-level prefix sums: totals of fixed
bins of the order (a small table per source), then a running sum inside each bin, so a hot
source is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, free_name

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Curriculum tilt of the sources in the same order: later, even, earlier.
TILTS = (0.5, 0.0, -0.5)
#: Times that a source or a document may be repeated.
REPEATS = 3


def word_count(text: str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, tilt: the water-filled targets; sizes has one row per source.

    A source's share of all words is by weight; where that is over REPEATS times its size
    it stops there, and the excess is shared by weight among the rest. In order of
    size / weight the capped sources come first: source k is capped if the share that the
    uncapped ones would get with the k - 1 before it capped is over its own limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(WEIGHTS)
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), number + 1).cast("double"))
    named = named.withColumn("tilt", F.element_at(F.array(*map(F.lit, TILTS)), number + 1))
    named = named.withColumn("limit", (REPEATS * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    named = named.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    return named.select("source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(final * F.col("weight")).alias("target"), "tilt")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bins: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, position.

    copies: times that the mix takes the document (0 to 3), taken: copies * size,
    position: training time in [0, 1] of its first copy, null without copies. A copy is
    taken if its midpoint in the source's stream lies before the target, so the taken words
    are within one document of the target. A null or empty text has size 0 and is taken as
    its place in the stream says; a null source is a source of its own, last; null ids come
    by the hash of the empty text. Rows that tie in the order (same id and size) may swap
    their places, with the same set of results. An empty table gives an empty result.

    bins: parts of a source's stream that are summed on their own.
    """
    return _mixed(docs, id_col, text_col, source_col, bins).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, bins: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mix")
    digits = max(1, (bins - 1).bit_length() + 3 >> 2)
    place = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), place.alias("place"))
    sized = scratch.write(sized.withColumn("bin", F.substring("place", 1, digits)), "sized")
    out = scratch.write(_placed(sized), "out")
    scratch.drop("sized")
    return out


def _placed(sized: DataFrame) -> DataFrame:
    by_bin = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sources = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    front = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    fronts = by_bin.withColumn("front", F.coalesce(F.sum("bin_size").over(front), F.lit(0))).select("source", "bin", "front")
    inner = Window.partitionBy("source", "bin").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    # The per-source and per-bin tables are joined to each other first, so the documents meet one table keyed as their window is.
    keyed = fronts.alias("f").join(sources.alias("s"), F.expr("f.source <=> s.source")).select("f.source", "bin", "front", "source_size", "target", "tilt")
    keyed = keyed.withColumnsRenamed({"source": "source_", "bin": "bin_"})
    placed = running.join(keyed, F.expr("source <=> source_ and bin = bin_")).withColumn("offset", F.col("front") + F.col("inside"))
    middle = F.col("offset") + F.col("size") / 2
    copies = sum((F.when(n * F.col("source_size") + middle <= F.col("target"), 1).otherwise(0) for n in range(REPEATS)), F.lit(0))
    done = F.when(F.col("target") > 0, F.least(F.col("offset") / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return (
        placed.withColumn("copies", copies)
        .withColumn("position", F.when(F.col("copies") > 0, moment(done, F.col("tilt"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "position", "offset", "tilt")
    )


def moment(done: Column, tilt: Column) -> Column:
    """The time t at which the share `done` of a source's demand is spent: solves t + tilt (t^2 - t) = done."""
    rest = 1 - tilt
    root = F.sqrt(rest * rest + 4 * tilt * done)
    return F.when(tilt == 0, done).otherwise((root - rest) / (2 * tilt))


def keep_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bins: int = 4096) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, range-sorted by training position, with its columns.

    Rows that repeat an id share that id's largest number of copies.
    """
    key, copy, at = (free_name(docs, x) for x in ("mix_key", "mix_copy", "mix_at"))
    mixed = _mixed(docs, id_col, text_col, source_col, bins).filter("copies > 0").groupBy(F.col("doc_id").alias(key))
    mixed = mixed.agg(F.max(F.struct("copies", "offset", "source_size", "target", "tilt")).alias(at))
    taken = docs.join(mixed, F.col(id_col).eqNullSafe(F.col(key))).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(f"{at}.copies") - 1)))
    done = F.least((F.col(f"{at}.offset") + F.col(copy) * F.col(f"{at}.source_size")) / F.col(f"{at}.target"), F.lit(1.0))
    taken = taken.withColumn(at, moment(F.coalesce(done, F.lit(0.0)), F.col(f"{at}.tilt")))
    return taken.repartitionByRange(F.col(at), F.col(key)).sortWithinPartitions(at, key).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
z AS (
  SELECT source, sum(size) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         [0.5, 0.0, -0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS tilt
  FROM d GROUP BY source),
y AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS lim FROM z),
x AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER ()
             - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM y),
v AS (SELECT *, level * weight >= lim AS capped FROM x),
t AS (
  SELECT source, source_size, tilt,
         CASE WHEN capped THEN lim
              ELSE weight * (SELECT level FROM v WHERE NOT capped ORDER BY lim / weight, source NULLS LAST LIMIT 1) END AS target
  FROM v),
o AS (
  SELECT d.*, t.source_size, t.target, t.tilt,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(off + size / 2 <= target AS INT) + CAST(source_size + (off + size / 2) <= target AS INT)
            + CAST(2 * source_size + (off + size / 2) <= target AS INT) AS copies,
         CASE WHEN target > 0 THEN least(off / target, 1.0) ELSE 0.0 END AS done
  FROM o)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies * size AS BIGINT) AS taken, copies,
       CASE WHEN copies = 0 THEN NULL WHEN tilt = 0 THEN done
            ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * done) - (1 - tilt)) / (2 * tilt) END AS position
FROM c
"""
