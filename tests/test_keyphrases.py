"""Keyphrases by frequency: counted over the rows of an id."""

from collections import Counter

from corpusmill.functions import keywords


def plain(rows, k):
    """By definition: terms of over 2 letters, in order of their number and first place."""
    out = []
    for id_ in {r[0] for r in rows}:
        n, first = Counter(), {}
        for _, text in (r for r in rows if r[0] == id_ and r[1] is not None and len(r[1].strip()) >= 20):
            for i, w in enumerate(text.lower().split()):
                if len(w) > 2:
                    n[w] += 1
                    first[w] = min(first.get(w, i), i)
        best = sorted(n, key=lambda w: (-n[w], first[w]))[:k]
        out += [(id_, w, n[w], r) for r, w in enumerate(best, 1)]
    return sorted(out, key=str)


TEXTS = [(1, "zebra apple zebra Apple cherry banana zebra"), (2, "one two three four five six seven"), (3, ""), (4, None), (5, "ab cd ef gh ij kl mn op qr st"), (6, "short text"), (7, "solo " * 500)]


def test_keyphrases(spark):
    for rows in (TEXTS, [*TEXTS, (1, "later cherry cherry cherry cherry"), (None, "nobody nobody somebody else"), (None, "somebody nobody other words")]):
        df = spark.createDataFrame([(i, t, "en") for i, t in rows], "id int, text string, lang string")
        got = keywords.keyphrases(df, "id", "text", "lang", 3)
        assert got.dtypes == [("id", "int"), ("term", "string"), ("n", "bigint"), ("rank", "int")]
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 3)


def test_distinct_ids_need_no_shuffle(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in TEXTS], "id int, text string, lang string")
    assert "Exchange" not in keywords.keyphrases(df, "id", "text", "lang")._jdf.queryExecution().executedPlan().toString()
