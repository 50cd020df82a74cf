"""Segmentation against all ways to part a text, and on a corpus of known words."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import keywords
from corpusmill.operators import segment

CHANCES = {"a": 0.3, "b": 0.2, "c": 0.1, "ab": 0.15, "bc": 0.12, "abc": 0.08, "ca": 0.05}


def ways(run):
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        edges = [0, *(i for i, c in enumerate(cuts, 1) if c), len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(edges)]


@pytest.mark.parametrize("run", ["a", "abc", "abcabcab", "cabbca", "ccc", "xab", "axxc"])
def test_all_ways(run):
    s = segment.Segmenter(CHANCES, 3, rare=0.001)
    weights = [(w, math.prod(s._chance(x) for x in w)) for w in ways(run)]
    assert math.prod(map(s._chance, s.words(run))) == pytest.approx(max(p for _, p in weights)) and "".join(s.words(run)) == run
    sums, total = {}, sum(p for _, p in weights)
    s.expected(run, 5, sums)
    for word in {x for w, p in weights if p for x in w}:
        assert sums[word] == pytest.approx(5 * sum(p * w.count(word) for w, p in weights) / total)


def test_long_runs_neither_vanish_nor_overflow():
    sums = {}
    s = segment.Segmenter(CHANCES, 3)
    s.expected("abc" * 5000, 1, sums)
    assert sum(len(w) * n for w, n in sums.items()) == pytest.approx(15_000)
    assert "".join(s.words("abc" * 5000)) == "abc" * 5000


WORDS = ["数据", "引擎", "分布式", "计算", "文本", "清洗", "机器", "学习", "向量", "检索", "的", "和"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(WORDS) for _ in range(12)) + " plain words，" + "".join(rng.choice(WORDS) for _ in range(5))) for i in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, ""), (402, "no such letters")], "id int, text string")


def test_words_are_learned(corpus):
    s = segment.learn(corpus, "text")
    assert s.words("分布式计算引擎") == ["分布式", "计算", "引擎"]
    assert s.words("机器学习的文本检索和数据清洗") == ["机器", "学习", "的", "文本", "检索", "和", "数据", "清洗"]
    assert s.words("") == [] and s.words("甲乙") == ["甲", "乙"]
    few = segment.learn(corpus, "text", most_words=2, rounds=1)
    assert sum(len(w) > 1 for w in few.chances) <= 2
    assert segment.learn(corpus.where("id > 400"), "text").words("数据") == ["数", "据"]


def test_keyphrases_of_chinese_texts_are_words(spark, corpus):
    s = segment.learn(corpus, "text")
    df = spark.createDataFrame([("检索数据和数据检索，向量数据的学习学习数据 abc 引擎", "zh"), (None, "zh")], "t string, lang string")
    words = s.column(F.col("t"))
    assert df.select(words.alias("w")).first().w == ["检索", "数据", "和", "数据", "检索", "，", "向量", "数据", "的", "学习", "学习", "数据", "abc", "引擎"]
    for method in ("light", "textrank"):
        got = df.select(keywords.phrases(F.col("t"), F.col("lang"), method, 3, segmented=words).alias("k")).collect()
        assert got[0].k[0] == "数据" and set(got[0].k) <= {*WORDS, "abc"} and got[1].k == []


def test_stopwords_of_a_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the\n\n# note\n 数据 \nthe\n", encoding="utf-8")
    stop = keywords.load_stopwords(spark, f"file://{tmp_path}/stop.txt")
    assert stop == ("the", "数据")
    df = spark.createDataFrame([("数据 检索 的的",)], "t string")
    assert df.select(keywords.terms(F.col("t"), F.lit("zh"), stop).alias("k")).first().k == ["检索", "的的"]
