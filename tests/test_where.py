from datetime import datetime, timezone

import pytest

from corpusmill.operators import where as w

CTX = w.Context(
    fields=("lang", "media_type", "quality_score", "created_at", "tags", "keyphrases"),
    lang_aliases={"汉语": "zh", "anglais": "en"}, media_keywords={"照片": "image", "photo": "image", "影片": "video", "clip": "video", "报告": "text", "report": "text"},
    media_types=frozenset({"image", "video", "text"}), fallback_lang="en", now=datetime(2024, 1, 20, tzinfo=timezone.utc),
)


@pytest.mark.parametrize("query, want", [("every photo of Rome", "image"), ("a clip", "video"), ("去年的照片在哪里", "image"), ("影片三部", "video"), ("我要报告", "text"), ("nothing of the kind", None), ("photograph", None)])
def test_aliases(query, want):
    assert w.match_alias(query, CTX.media_keywords) == want
    assert w.match_alias(query, {}) is None


@pytest.mark.parametrize("query, want", [("昨天下了大雨", "zh"), ("rain fell yesterday", "en"), ("下雨rain了吗", "zh"), ("heavy 雨 fell again", "en"), ("2024", "en"), ("?!", "en")])
def test_lang(query, want):
    assert w.infer_lang(query, CTX) == want


# The words for quality, comparison and time that conditions are told by.
@pytest.mark.parametrize("query, want", [("报告 质量>=0.35", 0.35), ("质量大于等于0.45的", 0.45), ("quality>=0.95 please", 0.95), ("质量>0.15", 0.15), ("质量大于0.25", 0.25), ("质量>=3", None), ("质量>=-2", None), ("quality >= 0.1.2", None)])
def test_quality(query, want):
    got = w.default_registry().parse("quality_score", query, CTX)
    assert got == (None if want is None else {"quality_score": {"$gte": want}})


def test_time_and_fields():
    registry = w.default_registry()
    assert registry.parse("created_at", "近一周下的雨", CTX) == {"created_at": {"$gte": "2024-01-13T00:00:00+00:00"}}
    assert registry.parse("created_at", "近一个月", CTX)["created_at"]["$gte"].startswith("2023-12-21")
    assert registry.parse("lang", "x", w.Context(fields=())) is None
    registry.register("custom", lambda q, c: {"custom": q})
    assert registry.parse("custom", "v", w.Context(fields=("custom",))) == {"custom": "v"}
    assert set(w.default_registry().parsers) == set(CTX.fields)


def test_infer():
    assert w.infer_where("影片 质量>=0.8", CTX, w.default_registry(terms=False)) == {"$and": [{"lang": {"$eq": "zh"}}, {"media_type": {"$eq": "video"}}, {"quality_score": {"$gte": 0.8}}]}
    assert w.infer_where("  ", CTX) is None


def test_restrict():
    where = {"$and": [{"lang": "en"}, {"secret": 1}, {"a": 1, "b": 2}]}
    assert w.restrict(where, ("lang", "a", "b")) == {"lang": "en"}
    assert w.restrict({"$or": [{"x": 1}]}, ("lang",)) is None
    assert w.restrict(None, ()) is None


def test_filter_strings():
    assert w.filter_strings({"$and": [{"lang": {"$eq": "zh"}}, {"quality_score": {"$gte": 0.8}}]}) == ["lang = 'zh'", "quality_score >= 0.8"]
    assert w.filter_strings({"$or": [{"a": 1}, {"b": True}]}) == ["(a = 1 OR b = true)"]
    assert w.filter_strings({"tags": {"$contains": "x"}}) == ["tags IN ['x']"]
    assert w.filter_strings({"$or": [{"$and": [{"a": 1}, {"b": 2}]}, {"c": "o'k"}]}) == ["((a = 1 AND b = 2) OR c = 'o\\'k')"]
    assert w.filter_strings({}) is None and w.filter_strings(None) is None


def test_compile(spark):
    df = spark.createDataFrame([(1, "en", ["x"]), (2, "de", ["y"]), (3, None, None)], "a int, lang string, tags array<string>")
    ids = lambda where: sorted(r.a for r in df.where(w.compile_where(where)).collect())
    assert ids(None) == [1, 2, 3]
    assert ids({"lang": "en"}) == [1]
    assert ids({"$or": [{"a": {"$gt": 2}}, {"tags": {"$in": ["x", "z"]}}]}) == [1, 3]
    assert ids({"a": {"$gte": 1, "$lt": 3}}) == [1, 2]
    assert ids({"tags": {"$contains": "y"}}) == [2]
    with pytest.raises(ValueError):
        w.compile_where({"a": {"$regex": "x"}})
