"""The manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    for level in tree[:-1]:
        first = at // 8 * 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def plain(rows):
    """Set of (doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            sides = [*path(trees[g], i), *path(top, n)]
            held = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                held = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(held)
            for a, b in sides:
                node = sha(a, node, b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[a + b for a, b in sides]), node, node == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(df):
    return sorted([tuple(r) for r in merkle.verified(df).collect()], key=repr)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (9, 8, 1), (65, 7), (600, 520, 3), (5000, 2, 1, 513)])
def test_manifest_equals_a_plain_tree(spark, sizes):
    names = [None, "", "en", "Én", "zz"]
    rows = [(i * 7 % 6000, f"s{i % 3}", names[g], i, f"Text {i} É") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = got(df)
    assert found == plain(rows)
    if len(rows) > 20:
        assert {r[-1] for r in found} == {True, False}


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "s", "en", 3, "Abc"), (3, "s", "en", None, ""), (9, None, "en", 1, "B" * 200_000), (-4, "s", "en", 1, "no change"), (9, "s", "de", 0, "日本 A")]
    rows += [(12, "s", "en", 2, "Same")] * 40 + [(12, "s", "en", 2, f"other {i}") for i in range(30)] + [(12, "x", None, 2, None)] * 9
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("group", "idx", "node", "path", "top", "total", "span", "tie")})
    assert got(df) == plain(rows)


def test_empty_table_and_many_languages(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(df) == []
    rows = [(i, "s", f"lang{i % 700}", i, "T") for i in range(1000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_any_change_breaks_the_proof(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(100)]
    df = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    checked = df.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"), (merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("other"))
    assert {tuple(r) for r in checked.collect()} == {(True, False)}
