"""Evaluation: KS, masked metrics, losses, histories and prediction columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.partition import running


def known(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def ks_score(rows: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """max(tpr - fpr) over all score thresholds, labels that are missing left out.

    Scores are counted first, so what is sorted is one row for each different score; they are summed
    up over ranges of scores, so no ``by`` is in one task.
    """
    down = -F.col(score).cast("double")
    counts = rows.where(known(F.col(label))).groupBy(*by, down.alias("down")).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("n"))
    upto = running(counts, by, "down", tp="p", fp="n")
    whole = counts.groupBy(*[F.col(b).alias(f"whole_{b}") for b in by]).agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    match = F.lit(True)
    for b in by:
        match &= F.col(b).eqNullSafe(F.col(f"whole_{b}"))
    gap = F.try_divide("tp", "ps") - F.try_divide("fp", "ns")
    return upto.join(whole, match).withColumn("gap", gap).groupBy(*by).agg(F.greatest(F.lit(0.0), F.max("gap")).alias("ks"))


def unpivot(rows: DataFrame, ids: list[str], labels: Mapping[str, str], scores: Mapping[str, str]) -> DataFrame:
    """(ids, target, label, score): only targets that have both a label and a prediction."""
    both = sorted(set(labels) & set(scores))
    items = [F.struct(F.lit(k).alias("target"), F.col(labels[k]).cast("double").alias("label"), F.col(scores[k]).cast("double").alias("score")) for k in both]
    return rows.select(*ids, F.explode(F.array(*items)).alias("x")).select(*ids, "x.*")


def masked_metric(pairs: DataFrame, metric: Column | Callable[[pd.Series, pd.Series], float]) -> DataFrame:
    """(target, value) of any metric of (label, score) by target; rows without a label are left out first.

    ``metric`` is an aggregate column of ``label`` and ``score``, of which parts are combined before the
    shuffle, or a Python function, which must see all rows of a target at once, in one task.
    """
    rows = pairs.where(known(F.col("label"))).select("target", "label", "score")
    if isinstance(metric, Column):
        return rows.groupBy("target").agg(metric.cast("double").alias("value"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"target": [key[0]], "value": [float(metric(part["label"], part["score"]))]})

    return rows.groupBy("target").applyInPandas(run, "target string, value double")


def weighted_loss(pairs: DataFrame, loss: Column, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Mean loss by target over known labels, then the weighted mean over targets; null if there is none."""
    by = pairs.where(known(F.col("label"))).groupBy("target").agg(F.avg(loss).alias("l"))
    weight = F.lit(1.0)
    if weights is not None:
        items = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*items)[F.col("target")] if items else F.lit(None).cast("double"), F.lit(0.0))
    return by.withColumn("w", weight).agg(F.try_divide(F.sum(F.col("w") * F.col("l")), F.sum("w")).alias("loss"))


def interval_likelihood(prob: Column, lower: Column, upper: Column, unit: float = 1.0, epsilon: float | None = None) -> Column:
    """-log of the probability of the periods floor(lower / unit) .. floor(upper / unit), both held to the range."""
    last = F.size(prob) - 1
    lo = F.least(F.floor(lower / unit), last.cast("long"))
    hi = F.when(upper == float("inf"), last.cast("long")).otherwise(F.least(F.greatest(F.floor(upper / unit), F.lit(0).cast("long")), last.cast("long")))
    lo = F.greatest(lo, F.lit(0).cast("long"))
    part = F.slice(prob, (lo + 1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return -F.log(F.greatest(total, F.lit(epsilon)) if epsilon is not None else total)


def deephit_loss(rows: DataFrame, prob: str = "prob", lower: str = "lower", upper: str = "upper", unit: float = 1.0, epsilon: float | None = None) -> DataFrame:
    """The mean of ``interval_likelihood`` over rows with bounds."""
    known_ = rows.where(F.col(lower).isNotNull() & F.col(upper).isNotNull())
    return known_.agg(F.avg(interval_likelihood(F.col(prob), F.col(lower), F.col(upper), unit, epsilon)).alias("loss"))


def observed(nodes: DataFrame) -> DataFrame:
    """Nodes with an observation time, of which losses and predictions are taken."""
    return nodes.where("obs_timestamp is not null")


def prediction_columns(rows: DataFrame, prediction: str, target: str, width: int | None = None) -> DataFrame:
    """A prediction as ``{target}_pred``, or a vector's as ``{target}_dim{j}_pred``."""
    if width is None:
        return rows.withColumnRenamed(prediction, f"{target}_pred")
    return rows.select(*[c for c in rows.columns if c != prediction], *[F.get(prediction, j).alias(f"{target}_dim{j}_pred") for j in range(width)])


def align(samples: DataFrame, predictions: DataFrame, key: str = "sample_key") -> DataFrame:
    """Predictions beside their samples, by key."""
    return samples.join(predictions, key, "left")


def epoch_means(log: DataFrame) -> DataFrame:
    """(epoch, mean_loss) of batch losses (epoch, loss)."""
    return log.groupBy("epoch").agg(F.avg("loss").alias("mean_loss"))


def last_epoch(history: DataFrame, value: str) -> DataFrame:
    return history.agg(F.max("epoch").alias("epoch"), F.max_by(value, "epoch").alias(value))


def first_epoch(history: DataFrame, value: str) -> DataFrame:
    return history.agg(F.min("epoch").alias("epoch"), F.min_by(value, "epoch").alias(value))


def pop_epoch(history: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The first epoch's value, and the history without that epoch."""
    first = first_epoch(history, value)
    return first, history.join(first.select("epoch"), "epoch", "left_anti")


def newest_epochs(history: DataFrame, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` epochs; the largest epoch is one number, so nothing is sorted."""
    last = history.agg(F.max("epoch")).head()[0]
    return history.where(F.col("epoch") > (last if last is not None else 0) - keep)
