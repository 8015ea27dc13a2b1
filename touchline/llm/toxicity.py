"""Operator 8: toxicity by a classifier chain over words.

Categories are predicted one after another by linear models. A later model also gets the probabilities of the earlier categories; while
fitting, these come from models that have not seen the row (out of fold), so a later model learns from what it will get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import held_out, labelled, utf8, written

SAMPLE = 20_000  # labelled rows that the chain is fitted on, about
VOCABULARY = 2_000
MIN_Z = 4.0
FOLDS = 3
PARTS = 4  # partitions of the bounded sample while models are fitted
THRESHOLD = 0.5
#: Words that mark the kinds of insult told apart before the label itself (fixed values).
CATEGORIES = {"person": ("idiot", "moron", "clown", "fool", "loser"), "contempt": ("worthless", "pathetic", "disgusting", "stupid", "trash")}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


@dataclass
class Chain:
    names: list[str]
    index: dict[bytes, int]
    weights: np.ndarray  # (categories, words)
    earlier: np.ndarray  # (categories, categories): weights of earlier probabilities
    bias: np.ndarray


def words(piece: bytes) -> set[bytes]:
    """Distinct words of UTF-8 text: runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return set(piece.translate(_WORDS).split())


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        found = [[w.decode("utf-8", "replace") for w in sorted(words(raw[a:b]))] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["id", "label", "words"])


def _vocabulary(rows: DataFrame, size: int) -> list[str]:
    """Words of three or more rows whose share among positive rows differs most and by MIN_Z standard errors, a fixed number at most."""
    n = rows.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    if not n.n or not n.pos:
        return []
    p = n.pos / n.n
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"), F.sum("label").alias("pos")).where("c >= 3")
    z = F.abs(F.col("pos") - p * F.col("c")) / F.sqrt(p * (1 - p) * F.col("c") + 1)
    return [r.word for r in counts.where(z >= MIN_Z).orderBy(F.desc(z), "word").limit(size).select("word").collect()]


def fit_chain(docs: DataFrame, labels: DataFrame, column: str = "toxic", categories: dict[str, tuple[str, ...]] | None = None, sample: int = SAMPLE) -> Chain:
    """Fit on about `sample` labelled documents. A category before the last is a positive row with one of its words; the last is the label.

    Without rows, or where a category has one class only, its model is its smoothed share of positive rows.
    """
    categories = CATEGORIES if categories is None else categories
    names = [*categories, column]
    rows = written(labelled(docs, labels, column, sample).mapInArrow(_with_words, "id long, label double, words array<string>"), "toxicity-sample")
    vocabulary = _vocabulary(rows, VOCABULARY)
    k, v = len(names), len(vocabulary)
    chain = Chain(names, {w.encode(): i for i, w in enumerate(vocabulary)}, np.zeros((k, v)), np.zeros((k, k)), np.zeros(k))
    total = rows.count()
    if not v:
        chain.bias[:] = -np.log(total + 1)
        return chain
    known = {c: [w for w in ws if w.encode() in chain.index] for c, ws in categories.items()}
    marked = rows.withColumns({f"y{i}": (F.col("label") * F.arrays_overlap("words", F.array(*map(F.lit, known[c]))).cast("double") if known.get(c) else F.lit(0.0)) for i, c in enumerate(categories)}).withColumn(f"y{k - 1}", F.col("label"))
    marked = CountVectorizerModel.from_vocabulary(vocabulary, "words", "x").setBinary(True).transform(marked)
    marked = written(marked.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(FOLDS))).drop("words", "label"), "toxicity-features").coalesce(PARTS)
    for i in range(k):
        positive = marked.agg(F.sum(f"y{i}")).first()[0] or 0.0
        if not 0 < positive < total:
            chain.bias[i] = np.log((positive + 0.5) / (total - positive + 0.5))
            marked = marked.withColumn(f"p{i}", F.lit((positive + 0.5) / (total + 1.0)))
            continue
        made = VectorAssembler(inputCols=["x", *(f"p{j}" for j in range(i))], outputCol="features").transform(marked)
        model = LogisticRegression(labelCol=f"y{i}", regParam=2e-4, maxIter=40, probabilityCol="prob", rawPredictionCol="raw", predictionCol="pred")
        whole = model.fit(made)
        weight = whole.coefficients.toArray()
        chain.weights[i], chain.earlier[i, :i], chain.bias[i] = weight[:v], weight[v:], whole.intercept
        if i < k - 1:
            parts = [model.fit(made.where(F.col("fold") != f)).transform(made.where(F.col("fold") == f)) for f in range(FOLDS)]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            marked = written(out.withColumn(f"p{i}", vector_to_array("prob")[1]).drop("features", "prob", "raw", "pred"), "toxicity-fold").coalesce(PARTS)
    return chain


def _probabilities(chain: Chain, column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    raw, known = memoryview(data), set(chain.index)
    out = np.empty((len(offsets) - 1, len(chain.names)))
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        hits = [chain.index[w] for w in words(bytes(raw[a:b])) & known]
        margin = chain.weights[:, sorted(hits)].sum(axis=1) + chain.bias
        for i in range(len(chain.names)):
            out[r, i] = 1 / (1 + np.exp(-np.clip(margin[i] + chain.earlier[i, :i] @ out[r, :i], -500, 500)))
    return out


def score_toxicity(docs: DataFrame, chain: Chain, keep: list[str] | None = None, threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """Columns `keep` with a probability per category (p_<name>), `score` (that of the last category) and `toxic` of every whole text.

    `prefix` is put before the names of the added columns, where `keep` holds names like theirs.

    A null or empty text gets the scores of a text without words. Rows are independent; other columns are not looked at.
    """
    keep = ["doc_id"] if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(held.value, batch.column("__text"))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1]), pa.array(p[:, -1] >= threshold)], names=[*batch.schema.names[:-1], *added])

    added = [prefix + c for c in (*(f"p_{n}" for n in chain.names), "score", "toxic")]
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"`{c}` {'boolean' if c == added[-1] else 'double'}" for c in added)])
    return rows.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that may be learned from and score all documents; adds held_out."""
    return score_toxicity(docs, fit_chain(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))
