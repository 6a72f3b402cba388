"""Score evaluation."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coupon_auc(scores: DataFrame, by: str = "coupon0", label: str = "label", prob: str = "prob") -> DataFrame:
    """AUC of each group with both classes: ``by``, ``positives``, ``negatives``, ``auc``.

    The AUC is the share of (positive, negative) pairs in the right order,
    ties counting half.  Rows with equal score are counted together first.
    The distinct scores are then range partitioned, so a group that holds a
    large part of all rows spreads over many tasks; each piece adds up its
    own pairs, and the pieces of a group, at most one per partition, are
    combined with the negatives of the pieces below them.
    """
    positive = F.count_if(F.col(label) == 1).alias("pos")
    negative = F.count_if(F.col(label) != 1).alias("neg")
    distinct = scores.groupBy(by, prob).agg(positive, negative)
    pieces = distinct.repartitionByRange(by, prob).withColumn("piece", F.spark_partition_id())
    below = Window.partitionBy(by, "piece").orderBy(prob).rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    partial = (
        pieces.withColumn("pairs", pairs)
        .groupBy(by, "piece")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    )
    lower = Window.partitionBy(by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    across = F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    whole = (
        partial.withColumn("across", across)
        .groupBy(by)
        .agg(
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
            F.sum(F.col("pairs") + F.col("across")).alias("ordered_pairs"),
        )
        .where((F.col("positives") > 0) & (F.col("negatives") > 0))
    )
    auc = F.col("ordered_pairs") / (F.col("positives").cast("double") * F.col("negatives"))
    return whole.select(by, "positives", "negatives", auc.alias("auc"))


def mean_coupon_auc(scores: DataFrame, by: str = "coupon0", label: str = "label", prob: str = "prob") -> DataFrame:
    """Plain mean of the group AUCs over the groups with both classes."""
    per_group = coupon_auc(scores, by, label, prob)
    return per_group.agg(F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).alias("coupons"))


def mismatches(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Number of rows predicted wrongly, and number of rows."""
    wrong = F.count_if(F.col(prediction).cast("double") != F.col(label).cast("double"))
    return predictions.agg(wrong.alias("mismatches"), F.count(F.lit(1)).alias("rows"))


def global_auc(predictions: DataFrame, label: str = "label", raw: str = "rawPrediction") -> float:
    """ROC AUC over all rows, exact: the curve keeps a point for every distinct score."""
    return BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC", numBins=0
    ).evaluate(predictions)
