"""Byte-level BPE through the table of distinct words, against the tokenizer's own library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import word_table

ODD = [None, "", "   ", " \n\t \n", "→ 123 !", "x" * 50_000, "word " * 30_000, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "don't we'll I'M 'tis ''s", "日本語 text ١٢٣ 한국", "été­😀\x00   end ", "  two  spaces", "᠎ ​ z", "Ǆ ₧5 ½ x² ª"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_table.vocabulary_path())


@pytest.mark.parametrize(("block", "shard"), [(word_table.BLOCK, word_table.SHARD), (400, 50)])
def test_ids_are_those_of_the_library(spark, tokenizer, block, shard):
    rnd = random.Random(3)
    made = [" ".join(rnd.choice(["alpha", "Beta", "the", "été", "12", "x_1", "…", "日本", "don't", "\n"]) for _ in range(rnd.randrange(60))) for _ in range(80)]
    rows = [*enumerate([*ODD, *made]), (20, made[0]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    coded = word_table.encode_documents(df, block=block, shard=shard)
    want = sorted((str(d), tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == want
    texts = {r.doc_id: r.text for r in word_table.decode_documents(coded.where("doc_id < 15")).collect()}
    assert texts == {i: t or "" for i, t in enumerate(ODD)}


def test_digests(spark, tokenizer):
    df = spark.createDataFrame([*enumerate(ODD)], "doc_id long, text string")
    for r in word_table.round_trips(df).collect():
        ids = tokenizer.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_table.round_trips(df.where("doc_id < 0")).count() == 0
    assert word_table.round_trips(df.where("doc_id < 2")).select("n_tokens").collect() == [(0,), (0,)]


def test_text_ids_and_other_kinds_of_key(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "name string, body string")
    got = word_table.encode_documents(df, id_col="name", text_col="body")
    assert {r.doc_id: len(r.ids) for r in got.collect()} == {"a": 2, "b": 0}


def test_decoding_of_any_ids(spark, tokenizer):
    rnd = random.Random(4)
    rows = [(i, [rnd.randrange(50257) for _ in range(rnd.randrange(30))]) for i in range(50)] + [(90, None), (91, [60_000, -1]), (92, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r.text for r in word_table.decode_documents(df).collect()}
    assert got == {i: tokenizer.decode([x for x in ids or [] if 0 <= x < 50257], skip_special_tokens=False) for i, ids in rows}


def test_each_distinct_word_is_encoded_once(spark):
    words = word_table.words_of(word_table.vocabulary_path())
    texts = ["the cat the dog", " the end", "the cat"]
    assert [words.split(t) for t in texts] == [["the", " cat", " the", " dog"], [" the", " end"], ["the", " cat"]]
    df = spark.createDataFrame(enumerate(texts * 50), "doc_id long, text string").repartition(6)
    plan = word_table.encode_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # words to shards, ids to blocks; positions stay in their buckets
