"""Collocations against a plain version."""

import re
from collections import Counter

import pytest

from corpusmill.llm import phrases
from tests.llm.common import ascii_lower, odd_docs


def plain(docs, least, best=2000, longest=3):
    """By definition, from (lang, text)."""
    f, n = {}, Counter()
    for lang, text in docs:
        mine = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            mine.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, mine in f.items():
        candidates = {p: a for p, a in mine.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, b in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= 50 * candidates[q[i : i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
                rows.append((" ".join(p), a, mine[p[:k]], mine[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:best], 1)]
    return sorted(out)


TEXTS = [
    ("en", "Alpha beta gamma. alpha BETA\tgamma, alpha beta delta; beta gamma\nalpha beta"),
    ("en", "a a a a a a a. a a"),
    (None, "x y z x y z x y z!x y"),
    ("und", "x y z x y z x\x0by"),
    ("de", "Straße STRASSE straße Ä ä Ä ä"),
    ("fr", ""),
    ("fr", None),
    ("fr", " \t.,;"),
]


@pytest.mark.parametrize(("salt_rows", "least", "longest"), [(1 << 19, 2, 3), (2, 2, 3), (3, 3, 4), (1, 1, 2)])
def test_phrases(spark, salt_rows, least, longest):
    docs = spark.createDataFrame([(*t, 1, "c") for t in TEXTS], "lang string, text string, n int, word string")
    got = phrases.collocations(docs, least=least, longest=longest, salt_rows=salt_rows).collect()
    assert sorted(map(tuple, got)) == plain(TEXTS, least, longest=longest)


def test_phrases_of_odd_documents(spark):
    docs = odd_docs(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs, least=2).collect())) == plain(rows, 2)
    assert sorted(map(tuple, phrases.collocations(docs, least=2, best=3).collect())) == plain(rows, 2, best=3)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_words_that_share_slots_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FEWEST_SLOTS", 4)
    monkeypatch.setattr(phrases, "MOST_SLOTS", 4)
    monkeypatch.setattr(phrases, "BLOCK_SLOTS", 4)
    monkeypatch.setattr(phrases, "HELD_WORDS", 3)
    docs = spark.createDataFrame(TEXTS * 3, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, least=4, salt_rows=5).collect())) == plain(TEXTS * 3, 4)


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_019, 4_000_000_007, 5_000_000_029
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(f"{phrases.SCORE} AS s").first().s == 1_000_000 * a * a // (l * r)
