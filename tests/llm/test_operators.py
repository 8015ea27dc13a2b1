"""Operators of the llm package on small and odd inputs, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import exact_topk, html_text, language_id, merge_dropout, packing, permutation_index, quality, secrets, toxicity, vectors
from touchline.llm.agendas import Numbers

ODD = [None, "", "   ", "→ 123 !", "\n\n", "x" * 50_000, "word " * 30_000]


def in_sample(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


@pytest.fixture(scope="module")
def vecs(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 16))
    rows = [(i, [float(x) for x in (centres[i % 6] + rnd.normal(size=16)) / 4], "x") for i in range(600)]
    rows += [(601, None, "x"), (620, [float("nan")] * 16, "x"), (640, [None] * 16, "x"), (660, [], "x"), (None, [1.0] * 16, "x"), (680, [0.0] * 16, "x"), (5, rows[5][1], "x"), (700, rows[20][1], "y"), (701, rows[20][1], "y"), (810, [1.0, 2.0], "z"), (820, [2.0, 2.0], "z"), (800, [3.0, 4.0], "z")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def whole(rows):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            out.setdefault((i, len(v)), []).append(tuple(v))
    return {k: np.array(min(v)) for k, v in out.items()}


@pytest.mark.parametrize(("block", "chunk"), [(8192, 1024), (90, 7)])
def test_exact_topk_equals_brute_force(vecs, block, chunk):
    rows, df = vecs
    ints = {k: np.floor(64 * v).astype(int) for k, v in whole(rows).items()}
    got = {}
    for r in exact_topk.exact_topk(df, F.col("id") % 20 == 0, 20, block=block, chunk=chunk).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in {i for i, _ in ints if i % 20 == 0}:
        scored = [(-int(v @ ints[(q, d)]), i) for (i, d), v in ints.items() if i != q and (q, d) in ints]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:20])]


def test_exact_topk_big_numbers_and_empty(spark):
    df = spark.createDataFrame([(i, [1e6 * i, -3e7]) for i in range(1, 30)], "vec_id long, embedding array<double>")
    rows = exact_topk.exact_topk(df, F.col("id") == 20, 2).collect()
    assert [r.vec_id for r in rows] == [29, 28]
    assert rows[0].score == 64 * 64 * (20 * 29 * 10**12 + 9 * 10**14)
    assert exact_topk.exact_topk(df.where("vec_id < 0"), F.col("id") % 20 == 0).count() == 0


def test_permutation_index_recall(vecs):
    rows, df = vecs
    unit = {k: v / np.linalg.norm(v) for k, v in whole(rows).items() if np.linalg.norm(v)}
    found = permutation_index.nearest(df, F.col("id") % 10 == 0, 5, share=0.3).collect()
    hits = total = 0
    for q, d in unit:
        if q % 10 == 0 and d == 16:
            best = sorted((-float(v @ unit[(q, d)]), i) for (i, e), v in unit.items() if i != q and e == d)[:5]
            got = [r for r in found if r.query_id == q]
            assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
            hits += len({i for _, i in best} & {r.vec_id for r in got})
            total += 5
            for r in got:
                assert r.score == pytest.approx(float(unit[(r.vec_id, d)] @ unit[(q, d)]), abs=1e-12)
    assert hits / total >= 0.9
    assert not [r for r in found if r.query_id == 680 or r.vec_id == 680]
    assert vectors.finite(df, "vec_id", "embedding").where("id is null").count() == 0


def test_permutation_index_keeps_ties_of_a_hot_vector(spark):
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(8, 16))
    v = np.array([centres[i % 8] + rnd.normal(size=16) / 2 for i in range(1800)])
    v[rnd.permutation(1800)[:600]] = centres[0]  # a third of the rows
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    copies = np.flatnonzero((v == centres[0]).all(axis=1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got: dict = {}
    for r in permutation_index.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    asked = range(0, 1800, 20)
    hits = 0
    for q in asked:
        if q in copies:
            assert got[q] == [c for c in copies.tolist() if c != q][:5]
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        hits += len(set(np.lexsort((np.arange(1800), -score))[:5].tolist()) & set(got[q]))
    assert hits / (5 * len(asked)) >= 0.95


def test_permutation_index_of_very_large_and_small_vectors(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(120, 8))
    size = np.array([1.0, 1e200, 1e-200, 1e-310])[np.arange(120) % 4]
    df = spark.createDataFrame([(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(v, size, strict=True))], "vec_id long, embedding array<double>")
    kept = np.array([[float(c) for c in r.embedding] for r in df.orderBy("vec_id").collect()])
    unit = kept / np.abs(kept).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for r in permutation_index.nearest(df, F.col("id") % 10 == 0).collect():
        best = np.sort(np.delete(unit @ unit[r.query_id], r.query_id))[::-1]
        assert r.score == pytest.approx(best[r["rank"] - 1], abs=1e-9)


def test_languages(spark):
    rnd = random.Random(1)
    words = {"en": "the and that with this from have which their".split(), "de": "der und nicht eine mit auch sich werden über".split(), "fr": "les des une dans pour avec être cette où".split()}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(3, 40))), lang, "s", i) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    rows += [(1000 + i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = {r.doc_id: r for r in language_id.identify_languages(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out != in_sample(i) and 0 <= got[i].score <= 1 for i in got)
    held = [r for r in rows[:300] if not in_sample(r[0])]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert [got[1000 + i].lang_pred == "und" for i in range(len(ODD))] == [not any(c.isalpha() for c in t or "") for t in ODD]
    nothing = language_id.identify_languages(df.where("doc_id < 0"))
    assert nothing.count() == 0
    unlearned = language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearned.select("lang_pred").distinct().collect()} == {"und"}


def test_codewords():
    for n in (2, 3, 4, 6, 9, 40):
        code = language_id.codewords(n).astype(int)
        apart = (code[:, None] != code[None]).sum(axis=2)
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


def test_secrets(spark):
    hexes = "0123456789abcdef" * 3
    texts = [*ODD, f'password = "hunter2hunter2" and é TOKEN:{hexes} x AKIA{"Z" * 20}', "api_key=short apiKey: 'abcd1234efgh'", hexes, "pwd: x9$Kq!27pLz@ ok", "password is qwertyuiop", "see http://bob:x9Kq27pLzR4@host/", "ſecret=aaaaaaaaaa", "secret=1234567 secret=12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in secrets.secret_spans(df).collect():
        text, base = texts[r.doc_id] or "", []
        for kind, pattern, least, group in (("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)):
            found = [m for m in re.finditer(pattern, text) if len(m[group]) >= least]
            assert r[f"n_{kind}"] == len(found)
            base += [(m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}") for m in found]
        said = ",".join(x for _, _, x in sorted(base))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(r.spans.split(",")) or not said
        assert ("guess" in r.spans) == ("x9" in text)
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df.select("doc_id", "text")).collect()}
    assert masked[len(ODD)].startswith("[assign]") and hexes not in masked[len(ODD)]
    assert [masked[i] for i in range(5)] == ODD[:5]
    assert secrets.secret_spans(df.where("doc_id < 0")).count() == 0


def test_whole_values_are_secrets(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789$!") for _ in range(400))
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20))
    texts = [f"auth: {long} end", f"x://{'u' * 90}:{long}@host", "password=Abcd1234!x9$Kq#7 end", f"pwd: {letters} end", "pwd: " + "z" * 60_000, "pwd: " + "xy12" * 15_000, "password=Abcd1234efgh end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert masked[0] == "auth: [guess] end" and masked[1] == f"x://{'u' * 90}:[guess]@host"
    assert "x9" not in masked[2] and "Kq" not in masked[2] and masked[2].startswith("[assign]") and masked[2].endswith(" end")
    assert masked[3] == "pwd: [guess] end"
    assert [masked[4], masked[5], masked[6]] == [texts[4], texts[5], "[assign] end"]
    spans = {r.doc_id: r.spans for r in secrets.secret_spans(df).collect()}
    assert spans[2] == "assign:0:17,guess:9:25" and spans[0] == "guess:6:406"


def test_guess_cost_is_the_cheapest_split():
    assert secrets.guess_cost("password123") < secrets.guess_cost("xqzvbnwr12") < secrets.guess_cost("x9$Kq!27pLz@")
    for easy in ("qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "2024-01-31", "abcdefghij", "P4ssword"):
        assert secrets.guess_cost(easy) < secrets.MIN_GUESSES
    assert secrets.guess_cost("") == 0


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(10, 60))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "Moron,", "worthless", "pathetic!"]))
        rows.append((i, " ".join(w + "%%%" for w in words) if bad else " ".join(words), "en", "s", 7))
        labels.append((i, None if i == 8 else int(not bad), int(toxic)))
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "plain words here", "en", "s", 1), (5, rows[5][1], "en", "s", 7)]
    labels += [(None, 1, 1), (99_999, 0, 0), (5, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(judged):
    docs, labels = judged
    got = quality.quality(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400 and truth[r.doc_id] is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality(docs.where("doc_id < 0"), labels).count() == 0
    assert quality.quality(docs, labels.where("doc_id < 0")).count() == len(got)


def test_rules_as_columns_equal_plain_rules(judged):
    docs, labels = judged
    rules = quality.fit_rules(docs, labels)
    assert rules.rules
    for r in quality.with_statistics(docs).select("__stats.*", quality.compiled(rules).alias("p")).collect():
        holds = [all((r[quality.STATISTICS[k]] > at) == above for k, above, at in rule) for rule in rules.rules]
        margin = rules.bias + sum(w for w, h in zip(rules.weights, holds, strict=True) if h)
        assert r.p == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-9)


def test_toxicity(judged):
    docs, labels = judged
    got = toxicity.toxicity(docs.withColumn("toxic", F.lit(1)), labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.toxic == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.where("doc_id < 0"), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><!-- c <p>no</p> -->
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>side</p></div>
<{tag}><h1>{title}</h1><p><b>{a}<br><p>{b} &amp; &eacute;&nbsp;x</p><div class="ad">buy</div><form><p>mail</p></form><ul><li>one<li>two</ul><div class="comments"><p>first!</p></div></{tag}>
<footer>&copy; site</footer></body>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(tag="article" if i % 2 else "div", title=f"Title {i}", a=f"first {i} \n  text", b=f"second {i}")) for i in range(24)]
    rows += [(100, "http://h1.example/x", None), (101, None, ""), (102, None, "no tags & <3 at all"), (103, "http://one.example", "<p>a<p>b<script>x"), (104, "http://h1.example/y", "<article>" + "<p>long text</p>" * 5000), (104, "http://h1.example/y", "<article>" + "<p>long text</p>" * 5000), (None, "u", "<p>q</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("wrapper", F.lit(1))
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i in range(24):
        assert by[i] == f"Title {i}\nfirst {i} text\nsecond {i} & é x\none\ntwo"
    assert (by[100], by[101], by[102], by[103], by[104], by[None]) == ("", "", "no tags & <3 at all", "a\nb", "\n".join(["long text"] * 5000), "q")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_pages(df.where("page_id < 0")).count() == 0


def test_attributes_are_read_to_their_end():
    props = "{&quot;x&quot;: " + "1, " * 3000 + "}"
    page = f"<body><article><p>kept</p><div data-props='{props}' class=\"sidebar\">gone</div><div data-props='class=\"ad\" hidden'>kept too</div><div data-class=ad data-id=nav>and this</div></article></body>"
    assert html_text.main_text(page, None) == "kept\nkept too\nand this"


def test_template_of_each_layout_from_all_pages(spark):
    shop = "<body><div class=x>Call us now</div><div class=y><h2>own {i} words</h2><p class=n>Printed by us</p><div class=t>text {i} of this</div></div></body>"
    blog = "<body><div class=q>Read more</div><section><h2>post {i} here</h2><div class=t>said {i} again</div></section><div class=z>All rights</div></body>"
    rows = [(i, "http://h.example/a", (blog if i % 5 == 0 else shop).replace("{i}", str(i))) for i in range(60)]
    rows += [(100 + i, "http://copies.example/a", "<body><div class=a>same text</div><div class=b>and more</div></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for r in html_text.extract_pages(df).collect():
        i = r.page_id
        assert r.text == ("same text\nand more" if i >= 100 else f"post {i} here\nsaid {i} again" if i % 5 == 0 else f"own {i} words\ntext {i} of this")


def test_constant_parts_are_template():
    pages = [f"<body><div class=x>Follow us today</div><div class=y><p>own {i} words</p><div class=z>Printed by us</div><p>more {i}</p></div></body>" for i in range(6)]
    wrapper = html_text._loaded(html_text.induce(pages))
    assert html_text.main_text(pages[2], wrapper) == "own 2 words\nmore 2"


def test_merge_dropout(spark):
    import sentencepiece

    texts = [*ODD[:5], "Hello world, this is lossless.", "a  b\n\n c\t", " lead", "trail ", "▁ x▁y \x00 é😀", "日本語 text", "wörd-mixed,tokens(1.5)!" * 400]
    plain = merge_dropout.Pieces(merge_dropout.vocabulary_path(), 0.0)
    model = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.vocabulary_path())
    for t in texts:
        if t and "▁" not in t and "\x00" not in t:
            assert np.frombuffer(plain.encode(t, 3), "<u4").tolist() == model.encode(t)
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string").withColumn("ids", F.lit(0))
    coded = merge_dropout.encode_documents(df)
    again = {(r.doc_id, tuple(r.ids)) for r in coded.collect()}
    assert again == {(r.doc_id, tuple(r.ids)) for r in merge_dropout.encode_documents(df.repartition(3)).collect()}
    assert len(again) == len(texts)
    assert {r.doc_id: r.text for r in merge_dropout.decode_documents(coded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    other = {(r.doc_id, tuple(r.ids)) for r in merge_dropout.encode_documents(df, seed=43).collect()}
    assert other != again
    for r in merge_dropout.round_trips(df).collect():
        ids = next(i for d, i in again if d == r.doc_id)
        assert r.lossless and r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert merge_dropout.round_trips(df.where("doc_id < 0")).count() == 0


def test_merge_dropout_of_one_long_word():
    import sentencepiece

    word = "internationalisierung" * 4000
    path = merge_dropout.vocabulary_path()
    dropped = merge_dropout.Pieces(path)
    assert dropped.decode(dropped.encode(word, 3)) == word and len(dropped.encode(word, 3)) > len(dropped.encode(word, None))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert np.frombuffer(dropped.encode(word, None), "<u4").tolist() == model.encode(word)


def test_merge_dropout_draws_for_each_occurrence():
    path, word = merge_dropout.vocabulary_path(), "international"
    dropped, plain = merge_dropout.Pieces(path, 0.5), merge_dropout.Pieces(path, 0.0)
    found = {dropped.encode(word, merge_dropout._key(d, 42)) for d in range(400)}
    assert len(found) > 20 and all(dropped.decode(x) == word for x in found)
    each = dropped._drawn([merge_dropout.SPACE + word] * 400, dropped._keys(7, 0, 400))
    assert len(set(each)) > 20 and dropped.encode(" ".join([word] * 400), 7) == b"".join(each)
    # the first merge alone: a word of two characters is left whole at the rate of the dropout
    pair = next(x for x in plain.ids if len(x) == 2 and x[0] == merge_dropout.SPACE and x[1].isalpha())
    for rate in (0.1, 0.5, 0.9):
        p = merge_dropout.Pieces(path, rate)
        split = sum(len(p.encode(pair[1], merge_dropout._key(d, 42))) > 4 for d in range(4000)) / 4000
        assert abs(split - rate) < 0.03
    everything = merge_dropout.Pieces(path, 1.0)
    assert everything.encode(word, 3) == b"".join(everything._word(c, None) for c in merge_dropout.SPACE + word)


def test_merge_dropout_of_many_words_is_that_of_each():
    rnd = random.Random(9)
    path = merge_dropout.vocabulary_path()
    for dropout in (0.0, 0.1, 0.6):
        dropped = merge_dropout.Pieces(path, dropout)
        made = ["".join(rnd.choice("abcdeinorstuß é😀\x00 日.") for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
        words = [(merge_dropout.SPACE + w.replace(" ", ""), rnd.randrange(merge_dropout.VARIANTS)) for w in made] + [("\n", 1), ("abc", 0), (merge_dropout.SPACE * 2 + "ab", 2)]
        assert dropped._new_words(words) == [dropped._word(w, v) for w, v in words]
        assert dropped._new_words(words[:3]) == [dropped._word(w, v) for w, v in words[:3]]


def test_merge_dropout_runs_agendas_of_many_texts_together(monkeypatch):
    rnd = random.Random(10)
    dropped = merge_dropout.Pieces(merge_dropout.vocabulary_path(), 0.3)
    made = [" ".join("".join(rnd.choice("abcdeinorstuß é日😀") for _ in range(rnd.choice([1, 3, 7, 12, 20, 60]))) for _ in range(rnd.randrange(40))) for _ in range(200)]
    keys = [merge_dropout._key(d, 42) for d in range(len(made))]
    each = [b"".join(dropped._word(w, k) for w, k in zip(words, dropped._keys(key, 0, len(words)).tolist())) for words, key in zip(map(dropped._words, made), keys)]
    alone, calls = merge_dropout.Pieces.merge, []
    monkeypatch.setattr(merge_dropout.Pieces, "merge", lambda self, word, gaps=None: calls.append(word) or alone(self, word, gaps))
    monkeypatch.setattr(merge_dropout, "_CHUNK", 500)
    monkeypatch.setattr(merge_dropout, "_CACHED", 700)
    assert list(dropped.encode_all(made, keys)) == each and not calls
    odd = ["", "a\u2581b c", "x" * 65 + " y", "\n\n"]
    assert list(dropped.encode_all(odd, [1, 2, 3, 4])) == [dropped.encode(t, k) for k, t in enumerate(odd, 1)]
    assert {len(w) for w in calls if w.endswith("x")} == {66}


def test_numbers_by_key():
    rnd = np.random.default_rng(5)
    keys = np.unique(rnd.integers(1, 1 << 62, 1000).astype(np.uint64))
    held = Numbers(len(keys))
    held.add(keys[:10], np.arange(10))
    held.add(keys[10:], np.arange(10, len(keys)))
    assert held.find(keys[::-1]).tolist() == list(range(len(keys)))[::-1] and (held.find(keys + np.uint64(1 << 63)) == -1).all()
    with pytest.raises(ValueError):
        held.add(np.array([1 << 63], np.uint64), np.zeros(1))


def test_quality_filter_keeps_what_the_score_keeps(spark):
    rnd = random.Random(3)
    rules = quality.Rules([tuple((rnd.randrange(10), rnd.random() < 0.5, rnd.random() * 3) for _ in range(3)) for _ in range(40)], [rnd.uniform(-1, 1) for _ in range(40)], -0.5)
    rows = [*enumerate(ODD), *((100 + i, "".join(rnd.choice("ab C1!.\n ") for _ in range(rnd.randrange(200)))) for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    kept = quality.keep_good(docs, rules)
    want = quality.score_quality(docs, rules).where("predicted = 1")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 10


def test_packing(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    texts = [*ODD, *(" ".join(rnd.choice(["alpha", "beta", "gamma", "Δelta", "été", "日本"]) for _ in range(rnd.randrange(1, 900))) for _ in range(60))]
    rows = [*enumerate(texts), (7, texts[7]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in rows}
    got = packing.pack_documents(df, shard=20).collect()
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        copies = 2 if d == 7 else 1
        assert sum(n for _, n in pieces[d]) == copies * len(x)
        covered = np.zeros(len(x), int)
        for s, n in pieces[d]:
            covered[s : s + n] += 1
        assert (covered == copies).all()
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(df.where("doc_id < 0")).count() == 0


def test_packing_encodes_like_the_tokenizer_by_default(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "été<|endoftext|><|endoftext|>日本", "no <|end oftext|> here", "x " * 1500 + "<|endoftext|>"]
    for t in texts:
        assert np.frombuffer(packing.encoder(packing.vocabulary_path()).encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert 50256 in tokenizer.encode(texts[0], add_special_tokens=False).ids
    for r in packing.pack_documents(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_packing_encodes_many_texts_together(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    marks = ["'s", "'ll", "'re", "'", "''", " ", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "\x1c", "\x00", "é", "ª", "²", "½", "’", "€", "…", "1", "23", ".", "-", "the", "over", "ſ", "don't", "WE'LL", "antidisestablishmentarian"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(40))) for _ in range(2000)]
    plain = packing.Encoder(packing.vocabulary_path())
    want = [plain.encode(t) + b"\0\0\0\0" for t in texts]
    for t, x in zip(texts, want):
        if not set(t) & {"\x85", "\xa0"}:
            assert np.frombuffer(x[:-4], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    alone = []
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, t, encode=packing.Encoder.encode: alone.append(t) or encode(self, t))
    for words, ids, size in ((1 << 19, 1 << 22, 1 << 20), (300, 1 << 22, 400), (1 << 19, 200, 2000)):  # all are kept; kept words are forgotten
        monkeypatch.setattr(packing, "_WORDS", words)
        monkeypatch.setattr(packing, "_IDS", ids)
        monkeypatch.setattr(packing, "_BYTES", size)
        for _ in range(2):
            assert list(packing.Encoder(packing.vocabulary_path()).encode_all(pa.array(texts))) == want and not alone
    monkeypatch.setattr(packing, "_BYTES", 300)
    odd = ["日本 text", None, "", "a" * 301, "x <|endoftext|> y", "😀", "Ωmega", "x" * 200, "plain"]
    got = list(plain.encode_all(pa.array(["cut off", *odd])[1:]))
    assert alone == [odd[i] for i in (0, 3, 4, 5, 6)]
    assert got == [plain.encode(t or "") + b"\0\0\0\0" for t in odd]


def test_packing_deals_as_each_document_by_itself():
    import pyarrow as pa

    rnd = random.Random(12)
    heavy = [np.array(rnd.sample(range(40), rnd.choice([0, 1, 2, 5, 16])), np.int32) for _ in range(300)]
    deal = packing.Deal(np.array([rnd.randrange(6) for _ in range(40)]))
    batch = pa.RecordBatch.from_arrays([packing.lists(heavy, pa.int32()), pa.array([rnd.getrandbits(63) - (1 << 62) for _ in heavy], pa.int64())], names=["heavy", "salt"])
    for level in range(packing.LEVELS + 1):
        found = deal.groups(batch)
        assert found[50:90] == deal.groups(batch.slice(50, 40)) == [deal.groups(batch.slice(i, 1))[0] for i in range(50, 90)]
        deal.bins |= {g: 2 for g in found if len(g) == level + 1 and level < packing.LEVELS}
    for (first, *_), h in zip(found, heavy):
        assert first == (min(h.tolist(), key=lambda t: (-deal.common[t], t)) if len(h) else -1)
    assert {len(g) for g in found} == {packing.LEVELS + 1}


def test_bm25_of_wanted_documents_is_as_before():
    rnd = np.random.default_rng(8)
    docs = [np.concatenate([rnd.integers(0, 6, 30), rnd.integers(6, 300, 30)]).astype(np.uint32) for _ in range(60)]
    index, wanted = packing.Bm25(docs), rnd.random(60) < 0.5
    assert 0 < len(index.rows) < len(index.row)
    before = [index.scores(d) for d in docs]
    index.keep(wanted)
    for d, x in zip(docs, before):
        assert index.scores(d).tolist() == np.where(wanted, x, 0.0).tolist()


def test_packing_brings_lexical_neighbours_together(spark):
    rnd = random.Random(6)
    names = ["".join(rnd.choice("bcdfghjklmnpqrstvwxz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(600)]
    rows = []
    for i in range(400):  # twenty documents of each of twenty subjects
        subject = names[30 * (i % 20) : 30 * (i % 20) + 30]
        rows.append((i, " ".join(rnd.choice(subject if rnd.random() < 0.5 else ["the", "of", "and", "to", "in"]) for _ in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sequences = {}
    for r in packing.pack_documents(df, shard=25).collect():
        sequences.setdefault(r.sequence_id, []).append(r.doc_id)
    pairs = [(a % 20 == b % 20) for ids in sequences.values() for a, b in zip(ids, ids[1:]) if a != b]
    assert sum(pairs) >= 0.6 * len(pairs)


def test_packing_of_a_hot_group_and_of_long_documents(spark):
    rows = [(i, f"same words in every copy {i % 3}") for i in range(300)] + [(1000 + i, f"zebra{i % 2} quagga " * 10 + "and so on " * 900) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, shard=30).collect()
    shards = {}
    for r in got:
        if r.doc_id < 1000:
            shards.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    assert max(map(len, shards.values())) <= 90
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    assert len({r.sequence_id >> 32 for r in got if r.doc_id >= 1000 and r.doc_id % 2 == 0}) == 1


def test_bm25_uses_the_counts_of_the_corpus_and_whole_documents():
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(0, 30, rnd.integers(1, 60)).astype(np.uint32) for _ in range(25)]
    df = np.array([sum(t in x for x in docs) for t in range(30)])
    mean = float(np.mean([len(d) for d in docs]))
    every, some = packing.Bm25(docs), packing.Bm25(docs[:5], packing.Corpus(25, mean, df))
    assert some.scores(docs[2]) == pytest.approx(every.scores(docs[2])[:5])
    rests, known = [np.full(600, t, np.uint32) for t in (1, 2, 3)], [np.array(x, np.uint32) for x in ([1, 7, 7], [2, 8], [3, 7, 7])]
    assert [d for d, _, _ in next(packing.fill(rests, known=known))] == [0, 2]


def test_bm25_equals_plain_sums():
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 30, rnd.integers(1, 60)).astype(np.uint32) for _ in range(25)]
    index, mean = packing.Bm25(docs), np.mean([len(d) for d in docs])
    for q in (0, 7):
        for i, d in enumerate(docs):
            want = 0.0
            for t in set(docs[q].tolist()):
                df, tf = sum(t in x for x in docs), int((d == t).sum())
                want += np.log1p((25 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            assert index.scores(docs[q])[i] == pytest.approx(want)


def test_pipeline_stages(spark, judged, tmp_path):
    docs, labels = judged
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        before = at.count()
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == columns
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        at.write.parquet(path)
        at = spark.read.parquet(path)
        if name == "toxicity":
            left = {r.doc_id for r in at.select("doc_id").collect()}
            assert not left & {i for i in range(400) if i % 5 == 1}
            assert {i for i in range(400) if i % 5 != 1} <= left
        if name == "secrets":
            assert at.count() == before
    assert set(at.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
