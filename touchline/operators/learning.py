"""Training, tuning, stacking and feature selection with Spark ML."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, QuantileDiscretizer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_stages(features: list[str], scale: bool = False) -> list:
    stages: list = [
        Imputer(inputCols=features, outputCols=[f"{c}_f" for c in features], strategy="mean"),
        VectorAssembler(inputCols=[f"{c}_f" for c in features], outputCol="raw" if scale else "features"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return stages


def classifier(name: str, n_features: int, weight: str | None = None, classes: int = 3, seed: int = 42, **params):  # noqa: ANN003, ANN201
    """lr, rf, gbt (one-vs-rest for more than two classes) or mlp, on `features` and `label`."""
    w = {"weightCol": weight} if weight else {}
    if name == "lr":
        return LogisticRegression(maxIter=50, **w, **params)
    if name == "rf":
        return RandomForestClassifier(seed=seed, **{"numTrees": 30, "maxDepth": 5, **params}, **w)
    if name == "gbt":
        gbt = GBTClassifier(seed=seed, **{"maxIter": 10, "maxDepth": 3, **params}, **(w if classes == 2 else {}))
        return gbt if classes == 2 else OneVsRest(classifier=gbt, **w)
    if name == "mlp":
        return MultilayerPerceptronClassifier(seed=seed, layers=[n_features, 8, classes], **{"maxIter": 50, **params})
    raise ValueError(f"unknown classifier {name!r}")


def train(data: DataFrame, features: list[str], name: str, weight: str | None = None, classes: int = 3, **params) -> Model:  # noqa: ANN003
    """Fitted pipeline from feature columns and `label` to predictions."""
    stages = feature_stages(features, scale=name in ("lr", "mlp"))
    return Pipeline(stages=[*stages, classifier(name, len(features), weight, classes, **params)]).fit(data)


def score(model: Model, data: DataFrame, keep: list[str], classes: int = 3) -> DataFrame:
    """Class probabilities p0, p1, ... ; one-vs-rest models give their normalised margins."""
    out = model.transform(data)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        grown = F.transform(raw, lambda v: 1 / (1 + F.exp(-2 * v)))
        total = F.aggregate(grown, F.lit(0.0), lambda a, v: a + v)
        p = F.transform(grown, lambda v: v / total)
    return out.withColumn("_p", p).select(*keep, "prediction", *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(classes)])


def evaluate(scored: DataFrame) -> dict[str, float]:
    """Accuracy, weighted precision, recall and F1."""
    return {
        m: MulticlassClassificationEvaluator(metricName=m, labelCol="label").evaluate(scored)
        for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")
    }


def time_folds(data: DataFrame, fold: str) -> list[tuple[DataFrame, DataFrame]]:
    """(rows of earlier folds, rows of the fold) for every fold but the first; no training row is later than a scored one."""
    last = int(data.agg(F.max(fold)).first()[0])
    return [(data.filter(F.col(fold) < f), data.filter(F.col(fold) == f)) for f in range(1, last + 1)]


def tune(data: DataFrame, features: list[str], name: str, grid: dict[str, list], fold: str, classes: int = 3) -> list[tuple[dict[str, float], float]]:
    """Grid search over folds in time order: each fold is scored by models of the folds before it. (parameters, mean log loss) each."""
    loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label")
    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        scores = [loss.evaluate(train(past, features, name, None, classes, **params).transform(now)) for past, now in time_folds(data, fold)]
        out.append((params, sum(scores) / len(scores)))
    return out


def out_of_fold(data: DataFrame, features: list[str], names: list[str], fold: str, keep: list[str]) -> DataFrame:
    """Probabilities of each base model for fold f, trained on folds before f; the first fold has none."""
    parts = None
    for f in range(1, int(data.agg(F.max(fold)).first()[0]) + 1):
        past, now = data.filter(F.col(fold) < f), data.filter(F.col(fold) == f)
        for n in names:
            s = score(train(past, features, n), now, keep).withColumn("model", F.lit(n)).drop("prediction")
            parts = s if parts is None else parts.unionByName(s)
    return parts


def stack(oof: DataFrame, names: list[str], keep: list[str]) -> Model:
    """Logistic regression on the base models' out-of-fold probabilities side by side."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"{n}_{i}" for n in names for i in range(2)], outputCol="features"), LogisticRegression(maxIter=50)]).fit(
        side_by_side(oof, names, keep)
    )


def side_by_side(oof: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return oof.groupBy(*keep).agg(*[F.max(F.when(F.col("model") == n, F.col(f"p{i}"))).alias(f"{n}_{i}") for n in names for i in range(3)])


def poisson_btts(data: DataFrame, test: DataFrame, features: list[str], home: str, away: str, keep: list[str]) -> DataFrame:
    """Both-score probability from two Poisson regressions for the two sides' goals."""
    prep = Pipeline(stages=feature_stages(features)).fit(data)
    out, ready = prep.transform(test), prep.transform(data)
    for side, label in (("lam", home), ("mu", away)):
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=label, regParam=0.01, predictionCol=side)
        out = glm.fit(ready).transform(out)
    return out.select(*keep, "lam", "mu", ((1 - F.exp(-F.col("lam"))) * (1 - F.exp(-F.col("mu")))).alias("p_btts"))


# ---------------------------------------------------------------- feature selection


def importances(model: Model, features: list[str]) -> list[tuple[str, float]]:
    """Tree importances, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, (float(v) for v in values), strict=True), key=lambda kv: (-kv[1], kv[0]))


def eliminate(data: DataFrame, features: list[str], keep: int) -> list[str]:
    """Recursive elimination: drop the least important feature of a forest until `keep` are left."""
    left = list(features)
    while len(left) > keep:
        left = [n for n, _ in importances(train(data, left, "rf", numTrees=10, maxDepth=4), left)][:-1]
    return left


def sequential(data: DataFrame, test: DataFrame, features: list[str], keep: int, forward: bool = True) -> list[str]:
    """Add the best (or drop the worst) feature one at a time by accuracy on `test`."""

    def accuracy(cols: list[str]) -> float:
        scored = train(data, cols, "lr").transform(test)
        return MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label").evaluate(scored)

    chosen = [] if forward else list(features)
    while len(chosen) != keep:
        if forward:
            chosen.append(max((f for f in features if f not in chosen), key=lambda f: (accuracy([*chosen, f]), f)))
        else:
            chosen.remove(max(chosen, key=lambda f: (accuracy([c for c in chosen if c != f]), f)))
    return chosen


def above_threshold(ranked: list[tuple[str, float]], threshold: float) -> list[str]:
    return [n for n, v in ranked if v >= threshold]


def l1_features(data: DataFrame, features: list[str], strength: float = 0.01) -> list[str]:
    """Features with a non-zero coefficient for some class under an L1 penalty."""
    model = train(data, features, "lr", regParam=strength, elasticNetParam=1.0)
    coef = model.stages[-1].coefficientMatrix.toArray()
    return [f for i, f in enumerate(features) if abs(coef[:, i]).max() > 1e-9]


def univariate(data: DataFrame, features: list[str], top: int) -> list[str]:
    """Best features by the F test against the class."""
    ready = Pipeline(stages=feature_stages(features)).fit(data).transform(data)
    sel = UnivariateFeatureSelector(featuresCol="features", labelCol="label", selectionMode="numTopFeatures")
    model = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top).fit(ready)
    return [features[i] for i in model.selectedFeatures]


def mutual_information(data: DataFrame, features: list[str], label: str, bins: int = 10, codes: DataFrame | None = None) -> DataFrame:
    """Mutual information of each binned feature with the class, from joint counts."""
    binned = codes
    if binned is None:
        buckets = QuantileDiscretizer(numBuckets=bins, inputCols=features, outputCols=[f"{c}_b" for c in features], handleInvalid="keep").fit(data)
        binned = buckets.transform(data).select(F.col(label).alias("y"), *[F.col(f"{c}_b").alias(c) for c in features])
    long = binned.unpivot("y", features, "feature", "bin")
    joint = long.groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_class = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    j = joint.join(by_bin, ["feature", "bin"]).join(by_class, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("t")
    return j.groupBy("feature").agg(F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def redundant_pairs(correlations: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs (a, b, r) whose correlation exceeds the threshold in size."""
    return correlations.filter(F.abs("r") > threshold)


def drop_redundant(pairs: DataFrame, ranking: DataFrame) -> DataFrame:
    """The lower ranked feature of each redundant pair; `ranking` is (feature, importance)."""
    a = ranking.select(F.col("feature").alias("a"), F.col("importance").alias("ia"))
    b = ranking.select(F.col("feature").alias("b"), F.col("importance").alias("ib"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.select(F.when(F.col("ia") >= F.col("ib"), F.col("b")).otherwise(F.col("a")).alias("feature")).distinct()
