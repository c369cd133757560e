"""Titles, words, stems, keywords, chunks: known inputs and results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.stemming import stem
from scriptorium.operators import chunks, fulltext, keywords


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("page", "title"), [
    ("<h1>A Good Heading</h1>", "A Good Heading"),
    ("<h2>Second Level Only</h2>", "Second Level Only"),
    ("<h1>Introduction</h1><h2>The Real Title</h2>", "The Real Title"),
    ("<h1>Hi</h1><h2>Longer Heading</h2>", "Longer Heading"),
    ("<h1 class='x'><a href='/'>Linked Title</a></h1>", "Linked Title"),
    ("<p>none</p>", None),
    (None, None),
])
def test_html_title(spark, page, title):
    assert one(spark, page, X.html_title) == title


@pytest.mark.parametrize(("text", "title"), [
    ("Deep Learning for Filters\nbody text follows here.", "Deep Learning for Filters"),
    ("Home\nwww.example.com\nA Survey of Digital Filters", "A Survey of Digital Filters"),
    ("the quick summary of the work is here and runs on for a while.\nMethods in Signal Processing Today", "Methods in Signal Processing Today"),
    ("page 3\n123\n2024-01-01", None),
    ("", None),
    (None, None),
])
def test_text_title(spark, text, title):
    assert one(spark, text, X.text_title) == title


@pytest.mark.parametrize(("raw", "clean"), [
    ("A Fairly Long Article Title - Site", "A Fairly Long Article Title"),
    ("Short - Site", "Short - Site"),
    ("  many   blanks here ", "many blanks here"),
    ("PDF: Annual Report", "Annual Report"),
    ("The Main Part of the Title | Section - Site Name", "The Main Part of the Title"),
    ("Ein Ärgernis größerer Art — Zeitung", "Ein Ärgernis größerer Art"),
])
def test_clean_title(spark, raw, clean):
    assert one(spark, raw, X.clean_title) == clean


def test_truncation_never_cuts_a_character(spark):
    assert one(spark, "one two three four five", lambda c: X.truncate(c, 15)) == "one two three"
    assert one(spark, "é" * 100, lambda c: X.truncate(c, 15)) == "é" * 15
    assert one(spark, "short", lambda c: X.truncate(c, 15)) == "short"


def test_junk_lines(spark):
    junk = ["http://x.org", "Table of Contents", "posted on Monday", "page 12", "a@b.org", "12.3 - 4"]
    fine = ["The History of Rome", "Chapter One", "Pages of History in Long Form"]
    rows = spark.createDataFrame([(x,) for x in junk + fine], "x string").select("x", X.is_junk_line("x").alias("j")).collect()
    assert {r["x"] for r in rows if r["j"]} == set(junk)


def test_stems_of_the_published_examples():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat rational ration triplicate triplic hopeful hope goodness good adjustable adjust adoption adopt controll control roll roll rate rate cease ceas".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want


def test_query_parsing():
    p = fulltext.parse
    assert [(x.tokens, x.prefix) for x in p("hello world")] == [(("hello",), False), (("world",), True)]
    assert [(x.tokens, x.prefix) for x in p("rust* foo-bar baz")] == [(("rust",), True), (("foo", "bar"), False), (("baz",), True)]
    assert p('"" \\') == []
    for bad in ("", "   ", "x" * 1001):
        with pytest.raises(ValueError, match="1 to 1000"):
            p(bad)


@pytest.mark.parametrize(("text", "check"), [
    ("", lambda c: c == []),
    ("short", lambda c: c == []),
    ("A" * 500, lambda c: c == ["A" * 500]),
    ("Hello world. " * 500, lambda c: len(c) >= 3 and all(len(x) >= 100 for x in c)),
    ("Word. " * 1000, lambda c: all(a[-50:] in b for a, b in zip(c, c[1:], strict=False))),
    ("é" * 3000, lambda c: all(len(x) <= 2000 for x in c)),
])
def test_chunks(text, check):
    assert check(chunks.split(text))


def test_keywords():
    text = "Digital filters shape the frequency response. A digital filter has coefficients. Filter design uses the frequency domain. Digital signals need filters."
    found = keywords.extract(text, 5)
    assert [s for _, s in found] == sorted(s for _, s in found)
    assert any(w in k for k, _ in found for w in ("filter", "digital", "frequency"))
    assert keywords.extract("hi") == []
