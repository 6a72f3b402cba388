"""Models on MLlib."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponlab.operators.windows import stratified_folds
from couponlab.session import checkpoint_dir, stored

SEED = 0

#: Predictors of the linear baseline.
LINEAR_PREDICTORS = [
    "user_id",
    "merchant_id",
    "discount_rate",
    "discount_type",
    "discount_man",
    "discount_jian",
    "distance",
]

#: Predictors of the first exploration.
EXPLORATION_PREDICTORS = ["user_id", "merchant_id", "coupon0", "discount_share", "distance"]


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write rows to the checkpoint folder, so that iterations read them back.

    A table, since Spark works out twice what it checkpoints: once to run it, once to write it.
    """
    return stored(rows, "rows")


def fit_gbt(
    train: DataFrame,
    features: list[str],
    label: str = "label",
    *,
    rounds: int = 50,
    step: float = 0.01,
    depth: int = 5,
    subsample: float = 0.7,
    columns_share: str = "0.7",
    min_instances: int = 5,
    min_gain: float = 0.0,
    bins: int = 256,
    weight: str | None = None,
) -> PipelineModel:
    """Gradient-boosted trees with logistic loss.

    Splits are sought between ``bins`` ranges of each input, whose bounds MLlib
    takes from a sample; more bins cost memory and time in proportion.

    A child weight of 1.1 is a sum of p(1-p), at most 1/4 per row, hence five
    rows.  A split penalty of 0.1 is a sum over rows too; as a gain per row,
    which is what MLlib compares, it is nil.
    """
    checkpoint_dir(train.sparkSession)
    trees = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        maxIter=rounds,
        stepSize=step,
        maxDepth=depth,
        subsamplingRate=subsample,
        featureSubsetStrategy=columns_share,
        minInstancesPerNode=min_instances,
        minInfoGain=min_gain,
        maxBins=bins,
        checkpointInterval=10,
        seed=SEED,
    )
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), trees]).fit(train)


def score(model: PipelineModel, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Kept columns and ``prob``, the probability of class 1."""
    kept = keep or ["user_id", "coupon_id", "date_received"]
    probability = vector_to_array("probability")[1].alias("prob")
    return model.transform(rows).select(*kept, probability)


def split_importance(model: PipelineModel, features: list[str], path: str, spark: SparkSession) -> DataFrame:
    """How often each feature splits a node, most used first.

    The fitted trees are saved under ``path`` and read back as a table of
    nodes.  Features that never split are left out.
    """
    trees = model.stages[-1]
    trees.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    names = spark.createDataFrame(list(enumerate(features)), "feature_index int, feature_name string")
    return (
        nodes.select(F.col("nodeData.split.featureIndex").alias("feature_index"))
        .where(F.col("feature_index") >= 0)
        .groupBy("feature_index")
        .agg(F.count(F.lit(1)).alias("importance"))
        .join(F.broadcast(names), "feature_index")
        .select("feature_name", "importance")
        .orderBy(F.desc("importance"), "feature_name")
    )


def gain_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Normalised gain of each feature, highest first."""
    gains = model.stages[-1].featureImportances.toArray()
    pairs = [(name, float(gain)) for name, gain in zip(features, gains)]
    return spark.createDataFrame(pairs, "feature_name string, importance double").orderBy(
        F.desc("importance"), "feature_name"
    )


def fit_elastic_net(
    train: DataFrame,
    features: list[str] = LINEAR_PREDICTORS,
    label: str = "label",
    *,
    grid: tuple[float, ...] = (0.001, 0.01, 0.1),
    folds: int = 3,
    iterations: int = 100,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Scaler and elastic-net logistic regression, tuned by global ROC AUC.

    ``grid`` is used for the penalty and for its L1 share.  Folds hold equal
    parts of each label.
    """
    regression = LogisticRegression(labelCol=label, featuresCol="scaled", maxIter=iterations)
    stages = [
        _assembler(features),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        regression,
    ]
    points = (
        ParamGridBuilder()
        .addGrid(regression.regParam, list(grid))
        .addGrid(regression.elasticNetParam, list(grid))
        .build()
    )
    search = CrossValidator(
        estimator=Pipeline(stages=stages),
        estimatorParamMaps=points,
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=SEED,
    )
    folded = stratified_folds(train.select("row_id", label, *features), folds, label)
    return search.fit(cut_lineage(folded))


def grid_results(search: CrossValidatorModel, spark: SparkSession) -> DataFrame:
    """Mean AUC for each point of the grid."""
    rows = []
    for params, auc in zip(search.getEstimatorParamMaps(), search.avgMetrics):
        named = {param.name: value for param, value in params.items()}
        rows.append((float(named["regParam"]), float(named["elasticNetParam"]), float(auc)))
    return spark.createDataFrame(rows, "reg_param double, elastic_net_param double, mean_auc double").orderBy(
        F.desc("mean_auc")
    )


def _labelled(estimator: Estimator, features: list[str], label: str) -> Pipeline:
    """A classifier over any integer labels; ``prediction`` holds a label."""
    estimator = estimator.copy({estimator.labelCol: "label_index", estimator.predictionCol: "predicted_index"})
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[_assembler(features), indexer, estimator])


def fit_naive_bayes(
    train: DataFrame, features: list[str], label: str = "label", kind: str = "gaussian", smoothing: float = 1.0
) -> PipelineModel:
    """Gaussian or multinomial naive Bayes."""
    return _labelled(NaiveBayes(modelType=kind, smoothing=smoothing), features, label).fit(train)


def fit_linear_svc(
    train: DataFrame, features: list[str], label: str = "label", cost: float = 5.0, iterations: int = 100
) -> PipelineModel:
    """Linear support vector classifiers, one per class, with penalty ``1 / (cost * rows)``."""
    rows = max(train.count(), 1)
    machine = LinearSVC(maxIter=iterations, regParam=1.0 / (cost * rows), standardization=True)
    return _labelled(OneVsRest(classifier=machine, parallelism=2), features, label).fit(train)


def predict_labels(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and the predicted label as an integer."""
    known = next(stage for stage in model.stages if isinstance(stage, StringIndexerModel)).labels
    names = F.array(*[F.lit(int(float(name))) for name in known])
    predicted = F.get(names, F.col("predicted_index").cast("int")).alias("prediction")
    return model.transform(rows).select(*keep, predicted)


def standardised(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Features shifted to mean 0 and scaled to sample deviation 1."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = Pipeline(stages=[_assembler(features), scaler]).fit(rows)
    values = vector_to_array("scaled")
    scaled = model.transform(rows).withColumn("values", values)
    return scaled.select(*keep, *[F.col("values")[i].alias(f"scaled_{name}") for i, name in enumerate(features)])


def load_or_fit(path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """Reuse the model saved at ``path``, or fit one and save it there."""
    try:
        return PipelineModel.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    model = fit()
    model.write().save(path)
    return model
