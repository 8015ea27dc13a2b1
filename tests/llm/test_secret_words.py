"""Words of the corpus make prose cheap to guess; values that no document says stay dear."""

from __future__ import annotations

from touchline.llm import secrets

PROSE = ["The password is incorrect.", "The secret is everything", "auth: authentication", "credentials: administrator"]
VALUES = ["pwd: x7$Kq!vR2mZp", "The password is gT4-wq9Zr.Lm2"]
SAID = ["An incorrect answer is everything that authentication needs", "The administrator wants everything incorrect", "authentication by the administrator"]


def test_prose_is_silent_and_random_values_are_found(spark):
    docs = spark.createDataFrame(list(enumerate([*PROSE, *VALUES, *SAID, None, ""])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    n = len(PROSE)
    assert all(got[i] == "" for i in range(n))
    assert got[n] == f"guess:5:{len(VALUES[0])}" and got[n + 1] == f"guess:16:{len(VALUES[1])}"
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert [masked[i] for i in range(n)] == PROSE and masked[n] == "pwd: [guess]" and masked[n + 5] is None


def test_words_are_counted_by_document_outside_contexts(spark):
    texts = ["zebra zebra apple", "apple pwd: zebrazebra", "apple mango", "mango token=walrus123", "walrus", None, ""]
    ranks = secrets.common_words(spark.createDataFrame([(t,) for t in texts], "text string"), words=5)
    assert ranks["apple"] == 1 and ranks["mango"] == 2
    assert "zebrazebra" not in ranks and "walrus" not in ranks and "zebra" not in ranks
    none = spark.createDataFrame([], "text string")
    assert secrets.common_words(none) == secrets._RANK


def test_a_split_takes_words_of_the_corpus():
    ranks = {"everything": 40, "incorrect": 900}
    assert secrets.guess_cost("everythingincorrect", ranks) < 6 < 10 < secrets.guess_cost("everythingincorrect")
