"""Operator 7: quality by a sparse rule ensemble that runs as Spark column expressions.

Statistics of whole texts are columns. Trees fitted on a bounded labelled sample give their paths as rules (conjunctions of bounds on
statistics); a logistic model with an L1 penalty weights the rules, and those with a weight become one column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import held_out, labelled, written

SAMPLE = 20_000  # labelled rows that trees and weights are fitted on, about
TREES, DEPTH = 20, 3
PARTS = 4  # partitions of the bounded sample while models are fitted
THRESHOLD = 0.3
STATISTICS = ["chars", "words", "word_length", "capitals", "digits", "marks", "loud", "distinct", "lines", "distinct_lines"]

Bound = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass
class Rules:
    rules: list[tuple[Bound, ...]]
    weights: list[float]
    bias: float


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a column `__stats` (struct of doubles) on whole texts; a null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("__rest", F.regexp_replace(t, r"[\p{Ll}\s]+", "")).withColumn("__words", F.split(F.trim(t), r"\s+")).withColumn("__lines", F.split(t, "\n"))
    chars, n = F.greatest(F.length(t), F.lit(1)).cast("double"), F.size("__words").cast("double")
    rest = F.col("__rest")
    no_capitals = F.regexp_replace(rest, r"\p{Lu}+", "")
    stats = {
        "chars": F.log1p(F.length(t).cast("double")),
        "words": F.log1p(n),
        "word_length": chars / n,
        "capitals": (F.length(rest) - F.length(no_capitals)) / chars,
        "digits": (F.length(no_capitals) - F.length(F.regexp_replace(no_capitals, r"\p{Nd}+", ""))) / chars,
        "marks": F.length(F.regexp_replace(no_capitals, r"[\p{L}\p{N}.,;:'\-]+", "")) / chars,
        "loud": (F.length(rest) - F.length(F.replace(rest, F.lit("!"), F.lit("")))) / chars,
        "distinct": F.size(F.array_distinct("__words")) / n,
        "lines": F.size("__lines") / n,
        "distinct_lines": F.size(F.array_distinct("__lines")) / F.size("__lines"),
    }
    return rows.withColumn("__stats", F.struct(*[stats[s].cast("double").alias(s) for s in STATISTICS])).drop("__rest", "__words", "__lines")


def _paths(node, path: tuple[Bound, ...] = ()) -> list[tuple[Bound, ...]]:
    """All paths from the root of a fitted tree to its nodes."""
    out = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        k, at = split.featureIndex(), float(split.threshold())
        out += _paths(node.leftChild(), (*path, (k, False, at))) + _paths(node.rightChild(), (*path, (k, True, at)))
    return out


def _holds(rule: tuple[Bound, ...], stat) -> Column:
    out = F.lit(True)
    for k, above, at in rule:
        out = out & ((stat(k) > at) if above else (stat(k) <= at))
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Rules:
    """Fit on about `sample` labelled documents; with rows of one class only, or none, the score is the smoothed share of label 1."""
    rows = with_statistics(labelled(docs, labels, column, sample)).select("label", "__stats.*")
    rows = written(VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows), "quality-sample").coalesce(PARTS)
    n = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    positive = n.pos or 0.0
    prior = Rules([], [], math.log((positive + 0.5) / (n.n - positive + 0.5)))
    if not 0 < positive < n.n:
        return prior
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({p for t in forest.trees for p in _paths(t._java_obj.rootNode())})
    if not rules:
        return prior
    flags = [_holds(r, lambda k: F.col(STATISTICS[k])).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    flagged = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(rows.select("label", *flags))
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=1e-3, maxIter=60, standardization=True).fit(flagged.select("label", "features"))
    weights = lasso.coefficients.toArray().tolist()
    used = [i for i, w in enumerate(weights) if abs(w) > 1e-9]
    return Rules([rules[i] for i in used], [weights[i] for i in used], float(lasso.intercept))


def compiled(rules: Rules, stats: str = "__stats") -> Column:
    """The ensemble as one column expression over the statistics."""
    margin = F.lit(rules.bias)
    for rule, weight in zip(rules.rules, rules.weights, strict=True):
        margin = margin + F.when(_holds(rule, lambda k: F.col(f"{stats}.{STATISTICS[k]}")), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def score_quality(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with `score` (0 to 1) and `predicted` (1 if score >= threshold), from whole texts by column expressions alone.

    A null or empty text is scored as an empty one; repeated rows get equal scores. Columns of these names are replaced.
    """
    return with_statistics(docs).withColumn("score", compiled(rules)).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__stats")


def keep_good(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of `docs`.

    The statistics pass through a generator, so the filter stays above them; pushed below, it would compute them again in every rule.
    """
    scored = with_statistics(docs).withColumn("__stats", F.explode(F.array("__stats")))
    return scored.where(compiled(rules) >= threshold).select(*docs.columns)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that may be learned from and score all documents; adds held_out."""
    scored = score_quality(docs.select("doc_id", "text"), fit_rules(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
