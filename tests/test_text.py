import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import keywords, scoring, text
from corpusmill.functions.arithmetic import evaluate
from corpusmill.functions.keywords import rank_terms
from corpusmill.operators import dedup


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *(c(F.col("t")) for c in columns)).orderBy("i").collect()]


def one(spark, inputs, column):
    return [r[0] for r in values(spark, inputs, column)]


def test_clean(spark):
    given = "这是一个测试文本。\r\n\n\n\n   多个空格   和制表符\t\t测试。"
    assert one(spark, [given, "", None, "  x "], text.clean) == ["这是一个测试文本。\n\n 多个空格 和制表符 测试。", "", None, "x"]


def test_normalize_and_id(spark):
    given = ["Ｈｅｌｌｏ　Ｗorld\n\tﬁne", "a​b", ""]
    got = values(spark, given, text.normalize, lambda t: text.chunk_id(text.normalize(t)))
    assert got[0] == ("Hello World fine", "99cbb34a88e1a741")
    assert got[1] == ("ab", "da23614e02469a0d")
    assert got[2][0] == ""


def test_query_cleaning(spark):
    assert one(spark, ["  你好，\n世界！“A”  B "], text.clean_query) == ['你好,世界!"A" B']


@pytest.mark.parametrize("given, want", [("山岳湖,前面有树,前面有树,", "山岳湖,前面有树,"), ("a, b. c", "a,b.c"), ("hello world", "hello world"), ("...", "..."), ("x;x;x;y", "x;y"), ("One. One. Two.", "One.Two."), ("", "")])
def test_collapse(spark, given, want):
    assert one(spark, [given], text.collapse_repeats) == [want]


def test_ratios(spark):
    got = one(spark, ["aaaaaa", "abcabcabc", "abcdef", "ab", ""], text.ngram_repetition)
    assert got == pytest.approx([0.75, 4 / 7, 0, 0, 0])
    assert one(spark, ["", "aab!"], text.gibberish_ratio) == [1.0, 0.25]
    assert one(spark, ["", "aab"], text.character_repetition) == pytest.approx([0, 1 / 3])


def test_quality(spark):
    assert one(spark, ["short text", "a" * 110, "a" * 200, "%" * 200], text.quality_score) == pytest.approx([0.75, 0.875, 1.0, 0.75])
    with_ocr = one(spark, ["a" * 200], lambda t: text.quality_score(t, F.lit(0.5)))
    assert with_ocr == pytest.approx([0.9])


def test_addresses(spark):
    assert one(spark, ["see www.example.com", "www\\x", "http://a", "2024-01-01 00", "a@b.co", "plain"], text.has_address) == [False, True, True, True, True, False]
    assert one(spark, ["Buy SCUM", "x"], lambda t: text.contains_any(t, ["scum", ""])) == [True, False]


def test_language(spark):
    got = one(spark, ["这是中文查询这是中文查询", "find image files", "123", "1234567890123", None], text.detect_language)
    assert got[:4] == ["zh", "en", "zh", "zh"]


def test_srt_time(spark):
    assert one(spark, ["00:01:02,500", "1:2", "aa:bb:cc"], text.srt_seconds) == [62.5, 0.0, 0.0]


def test_markdown(spark):
    assert one(spark, ["![a](u) **b** _c_ `d`"], text.markdown_text) == ["!a b c d"]


@pytest.mark.parametrize("metric, given, want", [("cosine_distance", [0, 0.5, 1, 2, 2.5], [1, 0.75, 0.5, 0, 0]), ("l2", [0, 0.5, 1, 2, 2.5], [1, 0.606531, 0.367879, 0.135335, 0.082085]), ("cosine_similarity", [0, 0.5, 1], [0.5, 0.75, 1])])
def test_scores(spark, metric, given, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(given)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(scoring.score_from_distance(F.col("v"), metric)).collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_character_classes(spark):
    """Java's classes against Python's over the Latin, Greek, Cyrillic and Han blocks."""
    chars = [chr(c) for c in [*range(32, 0x500), *range(0x2000, 0x2070), *range(0x4E00, 0x4E40)] if unicodedata.category(chr(c)) != "Cs"]
    got = values(spark, chars, text.gibberish_ratio, text.garbled_ratio)
    assert [g[0] == 0 for g in got] == [c.isalnum() or c.isspace() for c in chars]
    assert [g[1] == 1 for g in got] == [not c.isprintable() for c in chars]


def test_arithmetic():
    assert evaluate("2 + 3") == 5.0
    assert evaluate("-(2 - 4) * 3 / 4") == 1.5
    for bad in ("__import__('os')", "2 ** 3", "x", "1 +", "True"):
        with pytest.raises(ValueError):
            evaluate(bad)


def test_rank_terms():
    assert rank_terms([]) == [] and rank_terms(["a"]) == ["a"]
    assert rank_terms("hub a hub b hub c hub d".split(), 1, window=2) == ["hub"]


def test_phrases_by_method(spark):
    rows = [("the cat met the cat and one dog here", "en"), ("甲乙 丙丁 甲乙 戊己 甲乙 丙丁 庚辛 壬癸 子丑", "zh-CN"), ("short", "en"), (None, "en"), ("   ", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = lambda *how: [r[0] for r in df.select(keywords.phrases(F.col("text"), F.col("lang"), *how)).collect()]
    light = got("light", 2)
    assert light[0] == ["cat", "met"] and light[1] == ["甲乙", "丙丁"] and light[2:] == [[], [], []]
    ranked = got("textrank", 2)
    assert ranked[0] == light[0] and ranked[1][0] == "甲乙"
    assert got("none") == [[]] * 5 and got("keybert", 0) == [[]] * 5


def test_content_keeps_its_shape(spark):
    item = "struct<text:string,caption:string,at:int>"
    schema = f"a string, b array<string>, c array<{item}>, d struct<x:string,y:array<string>,z:struct<w:string>>, e array<int>"
    good, other = "a good long line here", "another fine line of it"
    rows = [
        (" x  y\r\n", [f" {good} ", "no", good, None, other], [("", f"{good} ", 1), (good, None, 2), ("  ", None, 3), (other, "c", 4)], ("p  q", [good, good], ("k  k",)), [1]),
        (None, None, None, None, None),
        ("", [], [(" ", "", 5)], (None, None, None), []),
    ]
    df = spark.createDataFrame(rows, schema)
    made = df.select(*(dedup.clean_content(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))
    assert [f.dataType for f in made.schema] == [f.dataType for f in df.schema]
    one, none, blank = made.collect()
    assert one.a == "x y" and one.b == [good, other]
    assert [tuple(r) for r in one.c] == [("", good, 1), (other, "c", 4)]
    assert (one.d.x, one.d.y, one.d.z.w, one.e) == ("p q", [good], "k  k", [1])
    assert tuple(none) == (None,) * 5
    assert (blank.a, blank.b, [tuple(r) for r in blank.c], blank.e) == ("", [], [(" ", "", 5)], [])


def test_cleaning_counts(spark):
    rows = [(1, 0, "a good long line here"), (1, 1, "a good long line here "), (1, 2, " "), (1, 3, None), (1, 4, "no"), (2, 0, "a good long line here")]
    df = spark.createDataFrame(rows, "id int, pos int, t string")
    assert tuple(dedup.cleaning_counts(df, "id", "pos", "t").first()) == (6, 4, 3, 2)
    assert tuple(dedup.cleaning_counts(df.limit(0), "id", "pos", "t").first()) == (0, 0, 0, 0)
    assert dedup.clean_items(df, "id", "pos", "t").count() == 2


ODD = ["", " ", "a", "abcde", "aa, aa,bb.", "x\r\n\r\n \r\ny z", "\u3000wide\u2003text here\x85", "www\\x", "www\\\u2028", "www.site", "HTTPS://X", "http\u017f://", "call +49 170-1234567 now", "\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u0661", "me.x@site.org", "#$%&/()=?abc",
       "abcabcabcabcabcabc", "ab", "\u4f60\u597d\uff0c\u4f60\u597d\uff0c\u4e16\u754c\u3002", "one. one . one;two", ",,,,,", "\U0001d400\U0001d401\U0001d402 five", "\u00bd \u2167 roman", "e\u0301e\u0301e\u0301 marks", "a\tb  c", "same same same", "x" * 10001, None, "a,\x1c,b,\x1f", "k@\u212a.de"]


@pytest.mark.parametrize("strict", [False, True])
def test_captions_are_judged_as_by_the_columns(spark, strict):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    before = text.clean(F.coalesce("t", F.lit("")))
    made = rows.select("i", before.alias("b")).select("i", "b", text.collapse_repeats(F.col("b")).alias("c"))
    good = text.keeps_caption(F.col("c")) & (F.col("b") != "")
    want = made.select("i", "c", (F.col("b") != "").alias("filled"), (good & (F.col("c") == F.col("b")) if strict else good).alias("keep")).orderBy("i").collect()
    assert [(r.c, r.filled, r.keep) for r in want] == [text.judged_caption(t, strict) for t in ODD]


def test_composed_gives_changed_texts_only():
    texts = ["ﬁne", None, "größer", "plain", "e\u0301", "Ａ"] * 500
    made = [x for part in text._composed(iter([pa.array(texts, pa.string()), pa.array([], pa.string())])) for x in part.to_pylist()]
    assert made == ["fine", None, None, None, "é", "A"] * 500
