"""Nulls, empty and repeated rows, empty tables and clashing names for the operators without a file of their own."""

import re
from collections import Counter

import pytest

from grainmill.llm import decontaminate, html, lines, quality, urls

FOLDER = "/root/testdata/sf0.001"
ITEM = " ".join(f"i{k}" for k in range(20))


def test_leaks(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, f"before {ITEM} after", "x"), (3, f"before {ITEM} after", "x"),
         (4, ITEM.upper(), "x"), (5, "one two", "x"), (6, "nothing here at all to see", "x"), (None, ITEM, "x")],
        "doc_id long, text string, hash string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "one two")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(3, 7), (4, 7), (5, 10)}
    assert decontaminate.drop_leaking(docs, items).columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_lines(spark):
    rows = [(k, f"own {k}\nshared line\n\n", f"s{k}") for k in range(12)] + [(50, None, "s1"), (51, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert [out[k].n_removed for k in range(12)] == [0] + [1] * 11
    assert out[3].text == "own 3\n\n" and out[50].text is None and out[51].n_lines == 0
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
    full = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)),
            len(covered))


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b c a b c a\n\n é#\né#\n"), (-4, "\n \n")],
                                "doc_id long, text string")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    both = docs.unionByName(odd)
    got = {r.doc_id: r for r in quality.quality_verdicts(both, quality.fit(both, labels), ["doc_id"]).collect()}
    for r in both.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == base(r.text), r.doc_id
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    heads = quality.fit(both, labels.limit(0))
    assert heads == {"quality": None, "toxic": None}
    assert quality.keep_good(docs.limit(0), heads).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?q"), (5, "ftp://net/y"),
            (6, "http://x.org/fr/"), (7, "http://x.example.com/de/1#f"), (8, "http://internet/z"), (9, "a://b?c://d/e")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(pages, ["page_id"]).collect()}
    assert out[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert out[5][2:] == ("net/", "block") and out[6][2:] == ("org/fr/", "allow")
    assert out[7][2:] == ("example.com/de/", "block") and out[8][2] is None and out[9][:2] == ("b", "")
    assert out[1][:3] == out[3][:3] == ("", "", None)
    assert urls.url_verdicts(pages.limit(0), ["page_id"]).count() == 0


def test_html(spark):
    page = ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; line</h1>"
            "<p>First  long\nparagraph of the article.<p>Second<script>no()</script> one.<aside>side</aside>"
            "<div class='comments'><p>reader</p></div></article><footer>foot</footer>")
    frame = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain text")], "page_id long, html string")
    out = {r.page_id: (r.text, r.n_chars) for r in html.extract(frame, ["page_id"]).collect()}
    want = "Head & line\n\nFirst long paragraph of the article.\n\nSecond one."
    assert out == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain text", 10)}
    assert html.extract(frame.limit(0), ["page_id"]).count() == 0
