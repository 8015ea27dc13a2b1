"""Pages that are deep, long, unclosed or hidden."""

from __future__ import annotations

import time

import pytest

from touchline.llm import html_text


def wrapped(pages: list[str]) -> html_text.Wrapper:
    return html_text._loaded(html_text.induce(pages))


def test_nesting_of_any_depth(spark):
    pages = [(i, "http://deep.example/x", "<div>" * 5000 + f"text {i}" + "</div>" * 5000) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(6)}


@pytest.mark.parametrize("html", ["<a " * 100_000, '<a "x>' * 50_001 + "t", "<!x" * 100_000, "<b><i>" * 10_000 + "</u>" * 10_000 + "t", "<p><b>" * 10_000 + "t"])
def test_unclosed_markup_takes_linear_time(html):
    start = time.process_time()
    assert html_text.main_text(html, None)
    assert time.process_time() - start < 10


def test_a_stray_quote_hides_no_later_tag():
    assert html_text.main_text('<p title="x>one</p><p>two</p>', None) == "one\ntwo"
    assert html_text.main_text("<p title='a>b'>one</p><p>two</p>", None) == "one\ntwo"


def test_hidden_parts_are_left_out():
    assert html_text.main_text("<article><p style='color:red'>a</p><p style='display: none'>b</p></article>", None) == "a"


def test_table_of_matches_by_pieces_is_the_same():
    nodes, parts = tuple("hp" * 1500 + "x"), tuple("ph" * 1400)
    found = html_text._matched(nodes, parts)  # 8 million cells, beyond the size that is kept whole
    kept = [k for k in found if k >= 0]
    assert kept == sorted(kept) and all(parts[k] == c for c, k in zip(nodes, found, strict=True) if k >= 0)
    best = [0] * (len(parts) + 1)  # most nodes matched, from the end, one row at a time
    for c in reversed(nodes):
        top, row = 0, [0] * (len(parts) + 1)
        for j in range(len(parts), -1, -1):
            top = max(top, best[j], best[j] + 1 if j < len(parts) and parts[j] == c else 0)
            row[j] = top
        best = row
    assert len(kept) == best[0]
