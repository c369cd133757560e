"""Queries without SQL against plain Python, on documents of all kinds."""

from __future__ import annotations

from collections import defaultdict

import pytest

from scriptorium.operators import keywords
from scriptorium.plans import catalogue

TEXTS = [
    "A Short History Of Printing\nthe press came to the town in spring and then it stayed.",
    "plain words come first here.\nÜber Die Geschichte Des Buchdrucks In Köln\nein satz folgt.",
    "Élan Vital Über Ñandú\nune phrase plus longue suit ici sans majuscule.",
    "日本語のテキストについての長い行です\nsecond line of ordinary words.",
    "kurz\n" + "Ä" * 120,
    "",
    None,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark, tmp_path):
    def write(texts):
        rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def brute_title(text):
    """For texts without junk lines and openings of bodies."""
    best = None
    for at, line in enumerate((text or "").split("\n")[:30]):
        line, words, size = line.strip(), line.split(), len(line.strip().encode())
        if not 10 <= size <= 200:
            continue
        score = max(25 - at, 0) + (10 if 30 <= size <= 120 else 3 if size < 30 else 0) + (0 if line.endswith(".") else 5)
        shouted = line == line.upper() and not any(c.islower() for c in line)
        score -= 10 if size < 30 and shouted else 0
        score += 5 if len(words) >= 3 and sum(w[0].isupper() for w in words) > len(words) // 2 else 0
        if best is None or score > best[0]:
            best = score, line
    return best and best[1]


def test_every_document_has_a_title_row(spark, table):
    got = catalogue.QUERIES["title_from_text"](spark, table(TEXTS)).collect()
    assert {r["doc_id"]: r["title"] for r in got} == {i: brute_title(t) for i, t in enumerate(TEXTS)}
    assert len(got) == len(TEXTS)


def brute_ranked(entries):
    """(keyword, count, best) of (title, text) pairs, the best first."""
    scores = defaultdict(list)
    for title, text in entries:
        for word, score in keywords.extract(f"{title}. {text}", 10):
            scores[word].append(score)
    return sorted(((w, len(s), min(s)) for w, s in scores.items()), key=lambda x: (-x[1], x[2], x[0]))


def test_keywords_come_from_whole_texts(spark, table):
    body = "Harbour Pilots guided every Steam Ferry. The Steam Ferry passed the Harbour Pilots again. "
    entries = [(f"Title number {i} of the series", body * (1 + i % 3) + f"Steam Ferry {i} sank.") for i in range(6)]
    sf = table([f"{title}\n{text}" for title, text in entries])
    whole = [(title, f"{title}\n{text}") for title, text in entries]
    got = [(r["keyword"], r["count"], r["best"]) for r in catalogue.QUERIES["keywords_top"](spark, sf).collect()]
    want = brute_ranked(whole)[:20]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert any("ferry" in g[0] for g in got)
    labels = {r["topic"]: r["label"] for r in catalogue.QUERIES["topic_labels"](spark, sf).collect()}
    assert labels == {f"src{k}": " / ".join(w[0] for w in brute_ranked(whole[k::2])[:3]) for k in range(2)}
