import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.config import Chunking
from corpusmill.operators import chunking as c


@pytest.mark.parametrize("media, short, long", [("text", (512, 60), (512, 76)), ("markdown", (512, 75), (512, 76)), ("pdf", (540, 90), (540, 90)), ("image", (512, 40), (512, 76)), ("video", (600, 100), (600, 100)), ("audio", (600, 100), (600, 100)), ("code", (512, 80), (512, 80))])
def test_params(media, short, long):
    assert c.chunk_params(media, 500) == short
    assert c.chunk_params(media, 50_000) == long
    assert c.chunk_params("text", 10, Chunking(auto=False)) == (800, 120)


@pytest.mark.parametrize("n, size, overlap, want", [(1000, 512, 76, [(0, 512), (436, 948), (872, 1000), (924, 1000)]), (600, 540, 90, [(0, 540), (450, 600), (510, 600)]), (500, 512, 76, [(0, 500), (424, 500)]), (0, 512, 76, [])])
def test_windows(spark, n, size, overlap, want):
    row = spark.range(1).select(c.windows(F.lit(n), F.lit(size), F.lit(overlap)).alias("w")).first()
    assert [tuple(x) for x in row.w] == want


def test_split_parts(spark):
    parts = spark.createDataFrame([(1, 1, "page", "b" * 600), (1, 0, "page", "a"), (1, 2, "table", " "), (2, 0, "page", None)], "doc_id int, ord int, chunk_type string, text string")
    rows = c.split_parts(parts, 540, 90).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.chunk_size, r.total_chunks) for r in rows] == [(1, 0, 1, 4), (1, 1, 540, 4), (1, 2, 150, 4), (1, 3, 90, 4)]


def test_paragraphs():
    assert c.paragraph_chunks("a\n\n\n\nb", 10, 3) == ["a", "ab"]
    assert c.paragraph_chunks(None, 10, 3) == []
    assert c.paragraph_chunks("一二三。四五六。七八九。", 8, 4) == ["一二三。四五六。", "七八九。"]


@given(st.text(alphabet="ab 。\n，", max_size=200), st.integers(5, 40))
def test_recursive(text, size):
    chunks = c.recursive_chunks(text, size, size // 4)
    assert all(0 < len(x) <= size for x in chunks)
    assert set("".join(chunks)) >= {x for x in text if x in "ab"}


def test_tables(spark):
    rows = [(1, [["k", "v"], ["1", " x "], ["2", ""]]), (2, [["only row"]]), (3, [["a" * 30, "b" * 30], ["1", "2"]]), (4, [])]
    df = spark.createDataFrame(rows, "i int, t array<array<string>>").select("i", c.table_text(F.col("t")).alias("x"))
    assert {r.i: r.x for r in df.collect()} == {1: "k是1，v是x\nk是2", 2: "only row", 3: "a" * 30 + " " + "b" * 30 + "\n1 2", 4: ""}


def test_regions(spark):
    items = [(1, "a", 0.9, 0, 0), (1, "b", 0.9, 5, 10), (1, "c", 0.9, 0, 28), (1, "d", 0.9, 0, 60), (1, "e", 0.1, 0, 61)]
    got = c.regions(spark.createDataFrame(items, "doc_id int, text string, confidence double, x int, y int")).orderBy("ord").collect()
    assert [(r.region_index, r.text) for r in got] == [(0, "a b c"), (1, "d")]


def test_subtitles(spark):
    cues = [("hello", 0.0, 1.0), ("world", 1.0, 2.0), ("again", 2.0, 3.0)]
    df = spark.createDataFrame([(cues,), ([],)], "cues array<struct<text:string,start_time:double,end_time:double>>")
    got = [r.x for r in df.select(c.subtitle_chunks(F.col("cues"), 10).alias("x")).collect()]
    assert [tuple(x) for x in got[0]] == [("hello world", 0.0, 2.0, 11), ("again", 2.0, 3.0, 5)]
    assert got[1] == []


def test_long_texts_are_cut_as_short_ones(spark):
    text = "".join(chr(0x1F600 + i % 60) if i % 7 == 0 else chr(97 + i % 26) if i % 11 else "\n" for i in range(20_011))
    spans = [(s, min(s + 500, len(text))) for s in range(0, len(text), 437)] + [(0, len(text)), (8191, 8193), (8192, 16384), (len(text) - 1, len(text))]
    df = spark.createDataFrame([(text, [{"start": a, "end": b} for a, b in spans])], "text string, spans array<struct<start:int,end:int>>")
    assert df.select(c.cut(df["text"], df["spans"])).first()[0] == [text[a:b] for a, b in spans]


def test_parts_of_a_document_are_numbered_on(spark):
    parts = spark.createDataFrame([("d", 2, "t", "x" * 10), ("d", 1, "t", "y" * 25), ("d", 3, "t", "  "), ("e", 1, "t", "z")], "doc_id string, ord int, chunk_type string, text string")
    got = sorted((r.doc_id, r.chunk_index, r.ord, r.text, r.chunk_size, r.total_chunks) for r in c.split_parts(parts, 10, 2).collect())
    assert got == [("d", 0, 1, "y" * 10, 10, 5), ("d", 1, 1, "y" * 10, 10, 5), ("d", 2, 1, "y" * 9, 9, 5), ("d", 3, 1, "y" * 2, 2, 5), ("d", 4, 2, "x" * 10, 10, 5), ("e", 0, 1, "z", 1, 1)]


@pytest.mark.parametrize("recursive", [True, False])
def test_texts_are_cut_in_slices(spark, monkeypatch, recursive):
    """Slices of a batch give what each text alone gives; a table that is read bounds the batches."""
    from corpusmill.sources.tables import BATCH_BYTES, read_table
    from tests.helpers import SMALL

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(c, "TEXTS", 3)
    texts = [None, "", "  ", *("word\n\n" * n + "x" * n for n in (1, 7, 90, 200, 3))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    cut = c.recursive_chunks if recursive else c.paragraph_chunks
    got = c.chunk_texts(df, "doc_id", "text", recursive=recursive).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, p) for i, t in enumerate(texts) for p in cut(t, 512, 76)]
    read_table(spark, SMALL, "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
