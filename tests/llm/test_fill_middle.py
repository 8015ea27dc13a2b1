"""Displacement scatter against the form built from strings."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import fill_middle

ODD = [None, "", "\n", "\n\n\n", "no end", "one\n", "é\n日本\n😀", "has <P> in it\nx", "a<S>", "<M>", "<P\n>S>\n<", "<\nS>\nP>\n", ">\n<M\n<S", "line\n" * 40_000, "z" * 100_000]


def plain_form(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(lines), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    made = ["".join(rnd.choice(["a", "é", "\n", "<", ">", "P", "S", "M", "😀", "word "]) for _ in range(rnd.randrange(60))) for _ in range(600)]
    return [*enumerate([*ODD, *made]), (30, made[1]), (30, made[1]), (None, "a\nb\nc"), (-5, "a\nb")]


@pytest.mark.parametrize("rate", [100, 40])
def test_form_and_restored_text(spark, rows, rate):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("h1", F.lit("x")).repartition(3)
    got = fill_middle.restore(fill_middle.fill_in_middle(df, rate=rate)).collect()
    want = sorted([repr((d, *plain_form(d, t, rate=rate), t or "")) for d, t in rows])
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in got) == want


def test_digests_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {str(d): t for d, t in rows}
    for r in fill_middle.transformed(df.where("doc_id <> 30")).collect():
        n, form, p, m, out = plain_form(r.doc_id, texts[str(r.doc_id)])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[str(r.doc_id)] or "").encode()).hexdigest()
    assert fill_middle.transformed(df.where("doc_id = 99999")).count() == 0


@pytest.mark.parametrize("window", [1, 7, 1000])
def test_shifts_do_not_depend_on_the_window(window):
    rnd = np.random.default_rng(1)
    bounds = np.sort(rnd.integers(0, 300, 40))
    bounds[0] = 0
    moves = rnd.integers(-50, 50, 40)
    want = moves[np.searchsorted(bounds, np.arange(300), "right") - 1]
    got = np.concatenate([x for _, _, x in fill_middle.shifts(bounds, moves, 300, window)])
    assert (got == want).all()
