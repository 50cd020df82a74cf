"""Chunking by media type."""

from pyspark.sql import functions as F

from corpusmill.config import Chunking
from corpusmill.operators import chunking, strategies

SCHEMA = "doc_id string, media_type string, kind string, ord int, text string, data array<array<string>>, start_time double, end_time double"
LONG = " ".join(f"word{i}" for i in range(900))


def chunks_of(spark, rows):
    found = strategies.chunk_elements(spark.createDataFrame(rows, SCHEMA)).collect()
    return {d: sorted((r.chunk_index, r.chunk_type, r.text) for r in found if r.doc_id == d) for d in {r.doc_id for r in found}}


def test_params_of_columns_are_those_of_values(spark):
    cases = [(m, n) for m in ("text", "pdf", "image", "video", "audio", "code", "word", "other") for n in (0, 100, 983, 984, 10_000)]
    for c in (Chunking(), Chunking(auto=False), Chunking(target=3000), Chunking(target=100, overlap_ratio=0.4)):
        df = spark.createDataFrame(cases, "m string, n int").select("m", "n", *strategies.chunk_params_of(F.col("m"), F.col("n"), c))
        for m, n, size, overlap in df.collect():
            assert (size, overlap) == chunking.chunk_params(m, n, c), (m, n, c)


def test_every_media_type(spark):
    table = [["k", "v"], ["1", "2"]]
    got = chunks_of(spark, [
        ("p", "pdf", "table", 1, None, table, None, None), ("p", "pdf", "page", 1, "first page", None, None, None), ("p", "pdf", "page", 2, "  ", None, None, None), ("p", "pdf", "page", 3, "third", None, None, None),
        ("w", "word", "paragraph", 1, "one", None, None, None), ("w", "word", "paragraph", 2, "two", None, None, None), ("w", "word", "table", 1, None, table, None, None),
        ("x", "excel", "table", 1, None, table, None, None),
        ("i", "image", "region", 1, "seen", None, None, None), ("i", "image", "caption", 1, "a cat", None, None, None), ("i", "image", "caption", 2, "on a mat", None, None, None),
        ("v", "video", "cue", 1, "hello", None, 0.0, 1.0), ("v", "video", "cue", 2, "there", None, 1.0, 2.0), ("v", "video", "transcript", 0, "not used", None, None, None),
        ("u", "video", "transcript", 0, "spoken", None, None, None), ("a", "audio", "transcript", 0, "heard", None, None, None),
        ("t", "text", "text", 0, "plain", None, None, None), ("o", "strange", "page", 0, "unknown", None, None, None), ("n", "text", "text", 0, None, None, None, None),
    ])
    assert got == {
        "p": [(0, "pdf_page", "first page"), (1, "pdf_page", "third"), (2, "pdf_table", "k是1，v是2")], "w": [(0, "word_paragraph", "one"), (1, "word_paragraph", "two"), (2, "word_table", "k是1，v是2")],
        "x": [(0, "excel_sheet", "k是1，v是2")], "i": [(0, "image_region", "seen"), (1, "image_caption", "a cat on a mat")], "v": [(0, "video_subtitle", "hello there")],
        "u": [(0, "video_transcript", "spoken")], "a": [(0, "audio_transcript", "heard")], "t": [(0, "text", "plain")], "o": [(0, "text", "unknown")],
    }


def test_long_elements(spark):
    got = chunks_of(spark, [("i", "image", "region", 1, LONG, None, None, None), ("i", "image", "caption", 1, LONG, None, None, None), ("t", "text", "text", 0, LONG, None, None, None), ("p", "pdf", "page", 1, LONG, None, None, None)])
    size, overlap = chunking.chunk_params("image", 2 * len(LONG))
    assert {k for _, k, _ in got["i"]} == {"image_region_part", "image_caption_part"} and all(len(t) <= size for _, _, t in got["i"])
    assert got["i"][0][2] == LONG[:size] and got["i"][1][2] == LONG[size - overlap : 2 * size - overlap]
    assert [t for _, _, t in got["t"]] == chunking.recursive_chunks(LONG, *chunking.chunk_params("text", len(LONG)))
    assert [i for i, _, _ in got["p"]] == list(range(len(got["p"]))) and got["p"][-1][2].endswith("word899")
    assert chunks_of(spark, [(None, None, None, None, None, None, None, None)]) == {}
