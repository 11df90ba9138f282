"""Classification losses, margins, accuracy and reports on logits(id, class, z) and labels(id, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elu, leaky_relu


def margins(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a node: label, z_y, best wrong class and its z, margin, log-sum-exp, prediction. One shuffle by node."""
    joined = logits.join(labels.select("id", "label"), "id")
    wrong = F.col("class") != F.col("label")
    found = joined.groupBy("id", "label").agg(
        F.max(F.when(~wrong, F.col("z"))).alias("z_y"),
        F.max(F.when(wrong, F.col("z"))).alias("z_o"),
        F.min_by("class", F.when(wrong, F.struct(-F.col("z"), F.col("class")))).alias("other"),
        F.min_by("class", F.struct(-F.col("z"), F.col("class"))).alias("pred"),
        F.max("z").alias("top"),
        F.collect_list("z").alias("zs"),  # one entry a class
    )
    lse = F.col("top") + F.log(F.aggregate(F.transform("zs", lambda z: F.exp(z - F.col("top"))), F.lit(0.0), lambda s, v: s + v))
    return found.withColumn("lse", lse).withColumn("margin", F.col("z_y") - F.col("z_o")).drop("zs", "top")


#: The losses by name; the two mixed ones may end in a share, as in tanhMarginCW-0.5.
LOSSES = ("CE", "CW", "LCW", "Margin", "tanhMargin", "tanhMarginCW", "tanhMarginMCE", "eluMargin", "MCE", "NCE")


def split_name(name: str) -> tuple[str, float]:
    """The loss and its share (0.5 if none is given); an unknown name is an error."""
    kind, _, share = name.partition("-")
    if kind not in LOSSES or share and not kind.startswith("tanhMargin"):
        raise ValueError(f"unknown loss {name}")
    return kind, float(share) if share else 0.5


def loss_column(name: str) -> Column:
    """A loss over the rows of margins(), as an aggregate; all are to be maximised. Null stands for a mean over no rows."""
    kind, a = split_name(name)
    m = F.col("margin")
    ce = F.col("lse") - F.col("z_y")
    hinge = F.greatest(m, F.lit(0.0))
    right = F.avg(F.when(F.col("pred") == F.col("label"), ce))
    table = {
        "CW": -F.avg(hinge),
        "LCW": -F.avg(leaky_relu(m, 0.1)),
        "Margin": -F.avg(m),
        "tanhMargin": F.avg(F.tanh(-m)),
        "tanhMarginCW": F.avg(a * F.tanh(-m) - (1 - a) * hinge),
        "tanhMarginMCE": a * F.avg(F.tanh(-m)) + (1 - a) * F.coalesce(right, F.lit(0.0)),
        "eluMargin": -F.avg(elu(m)),
        "MCE": right,
        "NCE": -F.avg(F.col("lse") - F.col("z_o")),
        "CE": F.avg(ce),
    }
    return table[kind]


def loss(logits: DataFrame, labels: DataFrame, name: str = "CE") -> DataFrame:
    return margins(logits, labels).agg(loss_column(name).alias("loss"))


def accuracy(logits: DataFrame, labels: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """Share of nodes whose largest logit is at their label, by part if a split(id, part) is given."""
    found = margins(logits, labels)
    hit = F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy")
    return found.join(split.select("id", "part"), "id").groupBy("part").agg(hit) if split is not None else found.agg(hit)


def classification_statistics(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node, on log-softmax: logit of the target and of the best other class, their confidences and the margin of these."""
    m = margins(logits, labels)
    target, other = F.col("z_y") - F.col("lse"), F.col("z_o") - F.col("lse")
    return m.select(
        "id",
        "label",
        target.alias("logit_target"),
        other.alias("logit_best_non_target"),
        F.exp(target).alias("confidence_target"),
        F.exp(other).alias("confidence_non_target"),
        (F.exp(target) - F.exp(other)).alias("margin"),
    )


def margin_histogram(statistics: DataFrame, bins: int = 6) -> DataFrame:
    """(bin, n, density, cumulative) of the margin over [-1, 1]; the last bin holds its upper end."""
    width = 2.0 / bins
    spot = F.least(F.floor((F.col("margin") + 1) / width), F.lit(bins - 1)).cast("int")
    counts = statistics.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    every = statistics.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    density = F.col("n") / total / width
    running = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / total
    return filled.select("bin", "n", density.alias("density"), running.alias("cumulative"))


def describe(results: DataFrame, *keys: str, value: str = "accuracy") -> DataFrame:
    return results.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
