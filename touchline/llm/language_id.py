"""Operator 2: language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1. For each bit one linear n-gram classifier tells the languages with +1 from those with -1;
its weights are log ratios of smoothed n-gram frequencies, its margin (the mean weight of a text's n-grams) is calibrated on the training
rows. The codeword with the least loss, weighted by how well each bit was learned, names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample, held_out, learnable, slices, utf8, written

SAMPLE = 40_000  # rows that the bit classifiers are fitted on, about
BUCKETS = 1 << 15
ORDERS = (3, 4)
AMBIGUOUS = 0.7  # a text is ambiguous if the runner-up reaches this share of the winner's score
_SLICE = 1 << 20
_TO = np.full(256, 32, np.uint8)
_TO[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TO[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TO[128:] = np.arange(128, 256)


@dataclass
class Codes:
    langs: list[str]
    words: np.ndarray  # (languages, bits) of +1 and -1
    weights: np.ndarray  # (buckets, bits)
    middle: np.ndarray
    slope: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1: all splits in two up to six languages, else a random code with the largest least distance of 64 tries."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cols = [[1, *(1 if bits >> k & 1 else -1 for k in range(n - 1))] for bits in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, 8 * int(np.ceil(np.log2(n)))))
        code[0] = 1
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code[:, None, :] != code[None]).sum(axis=2) + np.eye(n, dtype=int) * code.shape[1]
        if apart.min() > most:
            best, most = code, int(apart.min())
    return best


def ngrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, start of each text among them, whether a text holds an ASCII letter or a byte beyond), slice by slice."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, _SLICE):
        lo, hi = int(offsets[a]), int(offsets[b])
        n = b - a
        lengths = np.diff(offsets[a : b + 1])
        # each text gets a space at both ends, so no n-gram spans two texts' letters
        out = np.full(hi - lo + 2 * n + max(ORDERS), 32, np.uint8)
        starts = offsets[a:b] - lo + 2 * np.arange(n)
        at = np.arange(hi - lo) + np.repeat(2 * np.arange(n) + 1, lengths)
        raw = data[lo:hi]
        mapped = _TO[raw]
        upper = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)) + 1  # capital letters with accents
        mapped[upper] += 32
        out[at] = mapped
        keep = (out != 32) | np.concatenate([[True], out[:-1] != 32])  # runs of blanks count once
        place = np.cumsum(keep) - 1
        first = place[starts]
        text = out[keep].astype(np.uint32)
        size = len(text) - max(ORDERS) + 1
        grams = np.zeros(size, np.uint32)
        parts = []
        for k in range(max(ORDERS)):
            grams = grams * np.uint32(257) + text[k : k + size]
            if k + 1 in ORDERS:
                parts.append(((grams * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32) ^ np.int32(k))
        letters = np.add.reduceat(np.concatenate([(out[:-1] != 32), [False]]).astype(np.int64), starts) > 0 if n else np.zeros(0, bool)
        yield np.stack(parts), first, letters


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        names, codes = np.unique(langs, return_inverse=True)
        total = np.zeros((len(names), BUCKETS), np.int64)
        row = 0
        for grams, first, _ in ngrams(batch.column("text")):
            ends = np.append(first[1:], grams.shape[1])
            for i, (s, e) in enumerate(zip(np.minimum(first, grams.shape[1]), ends, strict=True)):
                total[codes[row + i]] += np.bincount(grams[:, s:e].ravel(), minlength=BUCKETS)
            row += len(first)
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[k].tolist(), pa.string()), pa.array(g.astype(np.int32)), pa.array(total[k, g])], names=["lang", "gram", "n"])


def _margins(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of each text's n-grams for every bit; whether it may hold a letter."""
    out, some = [], []
    for grams, first, letters in ngrams(column):
        size = grams.shape[1]
        start = np.minimum(first, size - 1)
        ends = np.append(first[1:], size)
        n = np.maximum(np.minimum(ends, size) - start, 1)
        sums = sum(np.add.reduceat(weights[g], start, axis=0) for g in grams)
        out.append(sums / (n[:, None] * len(grams)))
        some.append(letters)
    width = weights.shape[1]
    return (np.concatenate(out), np.concatenate(some)) if out else (np.zeros((0, width)), np.zeros(0, bool))


def fit_codes(rows: DataFrame, sample: int = SAMPLE) -> Codes:
    """Fit on about `sample` rows of (id, text, lang); rows without a text or a language are left out."""
    spark = rows.sparkSession
    rows = written(bounded_sample(rows.where("text is not null and lang is not null"), "id", sample).select("text", "lang"), "language-sample")
    found = rows.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if not langs:
        return Codes([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1), np.ones(1))
    words = codewords(len(langs))
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, found.column("lang").to_pylist()), found.column("gram").to_numpy()] = found.column("n").to_numpy()
    rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    side = lambda sign: np.stack([rate[words[:, b] == sign].mean(axis=0) if (words[:, b] == sign).any() else np.full(BUCKETS, 1 / BUCKETS) for b in range(words.shape[1])])
    weights = np.log(side(1) / side(-1)).T.astype(np.float32)
    held = spark.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, _ = _margins(batch.column("text"), held.value)
            for b in range(m.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.full(len(m), b, np.int32)), pa.array(m[:, b].astype(np.float64))], names=["lang", "bit", "m"])

    stats = rows.mapInArrow(margins, "lang string, bit int, m double").groupBy("lang", "bit").agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var")).collect()
    mean, var = np.zeros(words.shape), np.zeros(words.shape)
    for r in stats:
        mean[langs.index(r.lang), r.bit], var[langs.index(r.lang), r.bit] = r["mean"], r["var"]
    middle, slope, trust = np.zeros(words.shape[1]), np.ones(words.shape[1]), np.ones(words.shape[1])
    for b in range(words.shape[1]):
        up, down = words[:, b] == 1, words[:, b] == -1
        if up.any() and down.any():
            low, high = mean[up, b].min(), mean[down, b].max()
            gap, spread = mean[up, b].mean() - mean[down, b].mean(), var[:, b].mean() + 1e-4
            middle[b] = (low + high) / 2 if low > high else (mean[up, b].mean() + mean[down, b].mean()) / 2
            slope[b] = min(gap / spread, 200.0)
            trust[b] = gap**2 / (gap**2 + spread)
    return Codes(langs, words, weights, middle, slope, trust)


def _decode(codes: Codes, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = (m - codes.middle) * codes.slope
    loss = np.stack([(codes.trust * np.logaddexp(0, -w * z)).sum(axis=1) for w in codes.words], axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    score = p[np.arange(len(p)), best]
    rest = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return best, score, rest >= AMBIGUOUS * score


def predict_language(docs: DataFrame, codes: Codes) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and `ambiguous` of every whole text; other columns are not looked at.

    A null or empty text, or one without a letter, is `und` with score 0, and so is every text if nothing was learned. Rows are
    independent, so ties and repeated rows get equal results (equal scores go to the first language by name).
    """
    held = docs.sparkSession.sparkContext.broadcast(codes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            column = batch.column("text")
            m, some = _margins(column, c.weights)
            if len(some) and not some.all():
                some = some.copy()
            data, offsets = utf8(column)
            for i in np.flatnonzero(some):  # beyond ASCII letters, ask Unicode
                piece = data[offsets[i] : offsets[i + 1]]
                if not _ASCII_LETTER[piece].any():
                    some[i] = any(ch.isalpha() for ch in bytes(piece).decode())
            if not c.langs or not len(m):
                names, score, unsure = ["und"] * len(m), np.zeros(len(m)), np.zeros(len(m), bool)
            else:
                best, score, unsure = _decode(c, m)
                names = [c.langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                score, unsure = np.where(some, score, 0.0), unsure & some
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows that may be learned from, predict all; adds held_out. See `predict_language` for odd rows."""
    codes = fit_codes(docs.where(learnable(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), "lang"), sample)
    return predict_language(docs, codes).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
