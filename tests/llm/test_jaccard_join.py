"""Jaccard classes against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest

from touchline.llm import components as components_module
from touchline.llm import jaccard_join
from touchline.llm.jaccard_join import jaccard_classes, keep_one


def brute(rows, k=5, percent=75):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for i, (d, _) in enumerate(rows):
        if d is None:
            continue
        for j in range(i):
            linked = rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if linked or (rows[j][0] == d and sets[i] and sets[j]):
                a, b = root(i), root(j)
                parent[a] = b
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    del by_id
    return sorted(((d, len(sets[i]), None if d is None else low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def made(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = [rnd.choice(vocab) for _ in range(30)]
    rows, bases = [], [[rnd.choice(vocab) for _ in range(rnd.choice([3, 12, 60, 200]))] for _ in range(12)]
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            words = shared + words
        rows.append((rnd.randrange(10**6) if i % 9 else i, rnd.choice([" ", "\n", "\t "]).join(words).upper() if i % 2 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 16)])
def test_classes_equal_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CENTRES", 2)
    rows = [*made(seed, 260), (7, ""), (8, None), (None, "a b c d e f"), (9, "one two"), (10, "ONE two"), (11, "one two"), (5, "x y"), (5, "x y"), (5, "q r s t u v"), (12, "q r s t u v"), (13, "É ß")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, id string, n int")
    got = sorted((tuple(r) for r in jaccard_classes(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_components_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    one = sorted(map(tuple, components_module.components(df).collect()))
    monkeypatch.setattr(components_module, "BLOCK", 80)
    assert sorted(map(tuple, components_module.components(df).collect())) == one
    assert dict(one)[60] == 0


def test_long_texts_and_empty_table(spark):
    words = [f"v{i}" for i in range(20_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[:14_000])), (4, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert jaccard_classes(df.where("doc_id < 0")).count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (3, "z"), (None, "z"), (4, None)], "doc_id long, text string")
    kept = keep_one(df, jaccard_classes(df))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "4", "None"]
