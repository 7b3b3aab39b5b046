"""Clusters, classifiers and regressors on the Spark ML pipeline API.

Models are pooled over all entities: an entity enters through its smoothed
class rates, so one distributed fit replaces one fit per entity and no entity's
rows are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.operators.aggregate import attach
from pitchframe.operators.metrics import log_loss
from pitchframe.operators.shape import columns_by_type
from pitchframe.operators.standardize import standard_scale


def cluster(df: DataFrame, columns: Sequence[str], k: int = 10, *, seed: int = 0, out: str = "cluster") -> DataFrame:
    """k-means cluster of each row on population-standardised columns."""
    rows = df.dropna(how="any", subset=list(columns))
    scaled = standard_scale(rows, columns)
    assembler = VectorAssembler(inputCols=[f"{c}_scaled" for c in columns], outputCol="_features")
    points = assembler.transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out).fit(points)
    return model.transform(points).drop("_features", *[f"{c}_scaled" for c in columns])


def entity_rates(
    train: DataFrame, df: DataFrame, entity: str, target: str, classes: Sequence[str], *, prior: float = 20.0
) -> DataFrame:
    """Adds the entity's smoothed class shares of the training rows as ``rate_<class>``.

    ``prior`` rows of the overall distribution are mixed in; an unseen entity
    has exactly the overall shares.
    """
    overall = train.agg(
        F.struct(*[F.avg(F.when(F.col(target) == c, 1.0).otherwise(0.0)).alias(c) for c in classes])
    ).scalar()
    counts = train.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(target) == c).alias(f"_c_{c}") for c in classes]
    )
    joined = df.join(counts, entity, "left").withColumn("_all", overall)
    n = F.coalesce(F.col("_n"), F.lit(0))
    rates = {
        f"rate_{c}": (F.coalesce(F.col(f"_c_{c}"), F.lit(0)) + F.col("_all")[c] * prior) / (n + prior) for c in classes
    }
    return joined.withColumns(rates).drop("_n", "_all", *[f"_c_{c}" for c in classes])


def out_of_fold_rates(
    df: DataFrame, entity: str, target: str, classes: Sequence[str], fold: Column, *, prior: float = 20.0
) -> DataFrame:
    """Adds the entity's smoothed class shares over the rows of the other folds as ``rate_<class>``.

    A row's own class never enters its features, as it would with
    :func:`entity_rates` on the rows they were counted on. Group sums per entity
    and fold are reduced first; what the other folds hold is the entity's sum
    minus the own fold's, and likewise for the overall shares that are mixed in.
    """
    rows = df.withColumn("_fold", fold)
    counted = [F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(target) == c).alias(f"_c{i}") for i, c in enumerate(classes)]]
    names = ["_n", *[f"_c{i}" for i in range(len(classes))]]
    sums = rows.groupBy(entity, "_fold").agg(*counted)
    whole = Window.partitionBy(entity)
    others = sums.withColumns({f"{c}_other": F.sum(c).over(whole) - F.col(c) for c in names})
    # Overall sums of each fold, one short list whatever the number of entities.
    folds = sums.groupBy("_fold").agg(*[F.sum(c).alias(c) for c in names])
    listed = folds.agg(F.collect_list(F.struct("_fold", *names))).scalar()
    rest = F.filter(F.col("_folds"), lambda f: ~f["_fold"].eqNullSafe(F.col("_fold")))
    outside = lambda c: F.aggregate(F.col("_rest"), F.lit(0).cast("long"), lambda a, f: a + f[c])
    others = others.withColumn("_folds", listed).withColumn("_rest", rest)
    rates = {}
    for i, c in enumerate(classes):
        share = F.coalesce(F.try_divide(outside(f"_c{i}"), outside("_n")), F.lit(0.0))
        rates[f"rate_{c}"] = (F.col(f"_c{i}_other") + share * prior) / (F.col("_n_other") + prior)
    return attach(rows, others.select(entity, "_fold", *[v.alias(k) for k, v in rates.items()]), [entity, "_fold"]).drop("_fold")


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and text feature names; a column of any other type raises."""
    kinds = columns_by_type(df.drop(*exclude))
    if kinds["other"]:
        raise TypeError(f"not usable as features: {kinds['other']}")
    return kinds["numeric"], kinds["text"]


@dataclass
class Encoder:
    """Fitted label codes (alphabetical) and feature vectors."""

    model: PipelineModel
    classes: list[str]
    features: list[str]
    target: str

    def vectors(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def labelled(self, df: DataFrame) -> DataFrame:
        """Feature vectors with the numeric label; a class outside the codes has NULL."""
        names = F.array(*[F.lit(c) for c in self.classes])
        place = F.array_position(names, F.col(self.target))
        return self.vectors(df).withColumn("_label", F.when(place > 0, (place - 1).cast("double")))


def fit_encoder(train: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str] = ()) -> Encoder:
    """Min-max scaled numbers and alphabetical codes; an unseen text value keeps a code of its own."""
    stages, inputs = [], []
    if numeric:
        stages += [
            VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="error"),
            MinMaxScaler(inputCol="_numbers", outputCol="_scaled"),
        ]
        inputs.append("_scaled")
    if text:
        codes = [f"_code_{c}" for c in text]
        stages.append(
            StringIndexer(inputCols=list(text), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep")
        )
        inputs += codes
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    labels = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(train).labels
    return Encoder(Pipeline(stages=stages).fit(train), list(labels), [*numeric, *text], target)


class ClassScores:
    """What models with ``classes``, ``target`` and ``probabilities`` (an array in class order per row) have in common."""

    def long_probabilities(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """One row per input row and class."""
        names = F.array(*[F.lit(c) for c in self.classes])
        pairs = F.arrays_zip(names.alias("class"), F.col("probabilities").alias("probability"))
        return self.probabilities(df).select(*keep, F.inline(pairs).alias("class", "probability"))

    def true_probability(self):
        """Probability of the row's own class after :meth:`score`; 0 for a class never fitted."""
        names = F.array(*[F.lit(c) for c in self.classes])
        place = F.array_position(names, F.col(self.target)).cast("int")
        return F.when(place > 0, F.try_element_at("probabilities", F.greatest(place, F.lit(1)))).otherwise(0.0)

    def with_true_probability(self, df: DataFrame, out: str = "p_true") -> DataFrame:
        return self.probabilities(df).withColumn(out, self.true_probability())


@dataclass
class Classifier(ClassScores):
    """A fitted encoder and estimator."""

    encoder: Encoder
    model: object

    def __post_init__(self):
        # A training summary holds the session, and once a query was observed that can't go to the tasks with the model.
        if getattr(self.model, "hasSummary", False):
            none = SparkSession.getActiveSession()._jvm.scala.Option.empty()
            self.model._java_obj.setSummary(none)

    @property
    def target(self) -> str:
        return self.encoder.target

    @property
    def classes(self) -> list[str]:
        return self.encoder.classes

    def score(self, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Class probability array (in code order) and most likely class of encoded rows."""
        names = F.array(*[F.lit(c) for c in self.classes])
        scored = self.model.transform(vectors)
        return scored.withColumns(
            {
                "probabilities": vector_to_array("probability"),
                "predicted": F.element_at(names, F.col("prediction").cast("int") + 1),
            }
        ).select(*keep, "probabilities", "predicted")

    def probabilities(self, df: DataFrame) -> DataFrame:
        return self.score(self.encoder.vectors(df), df.columns)

    def importances(self, spark) -> DataFrame:
        """Feature importances, or mean absolute coefficients of a linear model, largest first."""
        if hasattr(self.model, "featureImportances"):
            weights = self.model.featureImportances.toArray()
        else:
            weights = abs(self.model.coefficientMatrix.toArray()).mean(axis=0)
        rows = [(name, float(w)) for name, w in zip(self.encoder.features, weights)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _bind(estimator):
    return estimator.copy().setFeaturesCol("_features").setLabelCol("_label")


def forest(**parameters) -> RandomForestClassifier:
    return RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": 0, **parameters})


def softmax(**parameters) -> LogisticRegression:
    return LogisticRegression(**{"family": "multinomial", "maxIter": 50, **parameters})


def fit_classifier(
    train: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str] = (), estimator=None
) -> Classifier:
    """Encoder and multiclass probability model of the complete training rows."""
    encoder = fit_encoder(train, target, numeric, text)
    model = _bind(estimator or forest()).fit(encoder.labelled(train).select("_features", "_label"))
    return Classifier(encoder, model)


# Fixed shape of the greedy search: three groups of two parameters, three values each.
GREEDY_GROUPS = [
    {"maxDepth": [2, 3, 5], "minInstancesPerNode": [1, 3, 5]},
    {"subsamplingRate": [0.5, 0.7, 0.9], "featureSubsetStrategy": ["0.5", "0.7", "0.9"]},
    {"minInfoGain": [0.0, 0.001, 0.01], "numTrees": [10, 20, 40]},
]


def greedy_search(
    train: DataFrame,
    test: DataFrame,
    target: str,
    numeric: Sequence[str],
    text: Sequence[str] = (),
    groups: Sequence[Mapping[str, Sequence[object]]] = tuple(GREEDY_GROUPS),
) -> tuple[dict[str, object], list[tuple[int, dict, float]]]:
    """Grid search group by group; the best setting of a group is kept for the next ones.

    Returns the best parameters and every trial with its log loss on the test
    rows. The first setting wins ties. Rows are encoded once and cached for all
    fits; a lost cached part is recomputed from its source.
    """
    encoder = fit_encoder(train, target, numeric, text)
    fit_rows = encoder.labelled(train).select("_features", "_label").cache()
    test_rows = encoder.labelled(test).select(target, "_features").cache()
    best: dict[str, object] = {}
    trials = []
    try:
        for number, group in enumerate(groups):
            chosen, lowest = {}, float("inf")
            for values in product(*group.values()):
                setting = dict(zip(group, values))
                fitted = Classifier(encoder, _bind(forest(**{**best, **setting})).fit(fit_rows))
                loss = log_loss(fitted.score(test_rows, [target]), fitted.true_probability()).first()["log_loss"]
                trials.append((number, {**best, **setting}, loss))
                if loss < lowest:
                    chosen, lowest = setting, loss
            best |= chosen
    finally:
        fit_rows.unpersist()
        test_rows.unpersist()
    return best, trials


def cross_validate(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    text: Sequence[str],
    estimator,
    grid: Mapping[str, Sequence[object]],
    *,
    folds: int = 3,
    metric: str = "logLoss",
    parallelism: int = 4,
    seed: int = 0,
) -> tuple[Classifier, list[tuple[dict, float]]]:
    """Full grid search with k folds; returns the best model and every setting with its mean metric."""
    encoder = fit_encoder(df, target, numeric, text)
    bound = _bind(estimator)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(bound.getParam(name), list(values))
    maps = builder.build()
    evaluator = MulticlassClassificationEvaluator(labelCol="_label", metricName=metric)
    validator = CrossValidator(
        estimator=bound, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed
    )
    found = validator.fit(encoder.labelled(df).select("_features", "_label"))
    results = [({p.name: v for p, v in m.items()}, float(score)) for m, score in zip(maps, found.avgMetrics)]
    return Classifier(encoder, found.bestModel), results


def fit_regressors(
    df: DataFrame, targets: Sequence[str], features: Sequence[str], kind: str = "tree", **parameters
) -> dict[str, object]:
    """One regressor per target: ``tree`` or ``ridge``."""
    points = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df.dropna(how="any", subset=[*targets, *features]))
    if kind == "tree":
        make = lambda t: DecisionTreeRegressor(featuresCol="_features", labelCol=t, predictionCol=f"{t}_hat", **{"maxDepth": 5, "seed": 0, **parameters})
    else:
        make = lambda t: LinearRegression(featuresCol="_features", labelCol=t, predictionCol=f"{t}_hat", **{"elasticNetParam": 0.0, "regParam": 1.0, **parameters})
    return {t: make(t).fit(points) for t in targets}


def residuals(df: DataFrame, regressors: Mapping[str, object], features: Sequence[str]) -> DataFrame:
    """Adds ``<target>_hat`` and ``<target>_residual`` for every target."""
    out = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df.dropna(how="any", subset=[*regressors, *features]))
    for target, model in regressors.items():
        out = model.transform(out).withColumn(f"{target}_residual", F.col(target) - F.col(f"{target}_hat"))
    return out.drop("_features")


def regression_report(scored: DataFrame, targets: Sequence[str]) -> DataFrame:
    """R squared and mean squared error per target, all in one scan."""
    aggregates, rows = [], []
    for i, t in enumerate(targets):
        error = F.col(f"{t}_residual") ** 2
        aggregates += [F.avg(error).alias(f"e{i}"), F.var_pop(t).alias(f"v{i}")]
        rows.append(
            F.struct(
                F.lit(t).alias("target"), (F.lit(1.0) - F.try_divide(F.col(f"e{i}"), F.col(f"v{i}"))).alias("r2"), F.col(f"e{i}").alias("mse")
            )
        )
    return scored.agg(*aggregates).select(F.inline(F.array(*rows)))
