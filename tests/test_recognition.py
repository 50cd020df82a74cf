"""Chains of engines for images, and search for substrings."""

import re

from corpusmill.operators import ocr, retrieval


def test_chain(spark):

    def strict(images):
        if any(b"bad" in i for i in images):
            raise ValueError("bad image")
        return [[(i.decode(), 0.9, 1.0, 2.0)] if b"clear" in i else [(" ", 1.0, 0.0, 0.0)] if b"blank" in i else [("?", 0.2, 0.0, 0.0)] for i in images]

    def rough(images):
        assert not any(b"clear" in i for i in images)  # it gets only what the first left
        return [[("rough", 0.6, 0.0, 0.0)] if b"bad" in i else [("worse", 0.1, 0.0, 0.0)] if b"dim" in i else [] for i in images]

    rows = [(1, b"clear"), (2, b"bad"), (3, b"dim"), (4, b"blank"), (5, None), (6, b"")]
    df = spark.createDataFrame([(i, c, "kept", "x") for i, c in rows], "id int, content binary, name string, engine string").coalesce(1)
    got = {r.id: r for r in ocr.recognise(df, [("strict", strict), ("rough", rough)]).collect()}
    assert [(got[i].engine, [x.text for x in got[i].regions]) for i in range(1, 7)] == [("strict", ["clear"]), ("rough", ["rough"]), ("strict", ["?"]), (None, []), (None, []), (None, [])]
    assert got[1].errors == [] and got[2].errors == ["strict: ValueError: bad image"]
    assert got[3].errors == ["strict: confidence 0.200", "rough: confidence 0.100"] and got[4].errors == ["strict: nothing found", "rough: nothing found"]
    assert got[5].errors == [] and got[1].name == "kept"
    assert {r.engine for r in ocr.recognise(df, []).collect()} == {None}
    assert ocr.recognise(df.limit(0), [("strict", strict)]).count() == 0


def test_substrings(spark):
    texts = [(1, "aaaa b"), (2, "aa x aa aa"), (3, None), (4, ""), (5, "b.b"), (6, "aXb aaa")]
    asked = [(1, "aa"), (2, "b"), (3, "."), (4, "aa"), (5, ""), (6, None), (7, "zz"), (8, "aaa")]
    got = retrieval.substring_search(spark.createDataFrame(asked, "qid int, query string"), spark.createDataFrame(texts, "id long, text string"), 2)
    want = []
    for q, s in asked:
        hits = sorted(((len(re.findall(re.escape(s), t or "")), i) for i, t in texts if s and s in (t or "")), key=lambda h: (-h[0], h[1]))
        want += [(q, i, n, r) for r, (n, i) in enumerate(hits[:2], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = spark.createDataFrame([], "qid int, query string")
    assert retrieval.substring_search(none, spark.createDataFrame(texts, "id long, text string")).count() == 0
