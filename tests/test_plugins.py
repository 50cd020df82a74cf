"""Registered strategies and assessors, run on the workers."""

import pytest

from corpusmill.operators import plugins


class Lines:
    def cut(self, text, size, overlap):
        yield from text.split("\n")


class Windows:
    def cut(self, text, size, overlap):
        for at in range(0, len(text), size - overlap):
            if text[at] == "!":
                raise ValueError("no such letter")
            yield text[at : at + size]


class Share:
    def __init__(self, letter):
        self.letter = letter

    def score(self, text):
        return text.count(self.letter) / len(text)


def broken():
    raise RuntimeError("no model")


def test_strategies(spark):
    registry = plugins.Registry()
    registry.register("Lines", Lines)
    registry.register("windows", Windows)
    registry.register("broken", broken)
    assert registry.names() == ("broken", "lines", "windows")
    rows = [(1, "lines", "a\n \nb", 1, 0), (2, "WINDOWS", "abcdef", 4, 1), (3, "windows", "ab!", 1, 0), (4, "broken", "x", 1, 0), (5, "none", "x", 1, 0), (6, "lines", None, 1, 0), (7, None, "x", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id int, strategy string, text string, size long, overlap long")
    got = sorted((tuple(r) for r in plugins.cut_by(registry, df).collect()), key=str)
    assert got == [(1, 0, "a", None), (1, 1, "b", None), (2, 0, "abcd", None), (2, 1, "def", None), (3, 0, "a", None), (3, 1, "b", None), (3, 2, None, "ValueError: no such letter"), (4, 0, None, "RuntimeError: no model"), (5, 0, None, "no such name: none"), (7, 0, None, "no such name: ")]
    registry.register("none", Lines)  # what is registered later goes along with later plans
    assert {r.text for r in plugins.cut_by(registry, df.where("doc_id = 5")).collect()} == {"x"}
    assert plugins.cut_by(registry, df.limit(0)).count() == 0


def test_assessors(spark):
    registry = plugins.Registry(most_held=1)
    registry.register("a", lambda: Share("a"))
    registry.register("b", lambda: Share("b"))
    df = spark.createDataFrame([(1, "aab"), (2, "")], "id int, text string")
    got = {(r.id, r.assessor): (r.score, r.error) for r in plugins.assess_by(registry, df).collect()}
    assert got[1, "a"] == (pytest.approx(2 / 3), None) and got[1, "b"] == (pytest.approx(1 / 3), None)
    assert got[2, "a"][0] is None and got[2, "a"][1].startswith("ZeroDivisionError")
    assert {r.assessor for r in plugins.assess_by(registry, df, ("B", "c")).collect()} == {"b", "c"}


def test_workers_keep_the_last_few():
    made, closed = [], []

    class Heavy:
        def __init__(self, name):
            made.append(name)
            self.name = name

        def close(self):
            closed.append(self.name)

    held = plugins.Held({n: lambda n=n: Heavy(n) for n in "abc"}, 2)
    for n in "abacb":
        held.get(n)
    assert made == ["a", "b", "c", "b"] and closed == ["b", "a"] and list(held.made) == ["c", "b"]
    with pytest.raises(KeyError):
        held.get("x")
