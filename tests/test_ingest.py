"""The path from uploaded files to chunks."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators import strategies
from corpusmill.operators.chunking import recursive_chunks
from corpusmill.sources import files
from corpusmill.sources.files import elements, extract, upload_items

LONG = "One sentence. Another one, with words. " * 60


def _files(spark):
    rows = [("a.txt", None, LONG.encode()), ("b.md", "", b"# Head\n\nsome **bold** text"), ("c.csv", "text/csv", b"name,age\nAnn,3\nBob,4\n"), ("d.png", "image/png", b"\x89PNG"), ("e.xyz", None, "größer".encode()), ("f.xlsx", None, b"no zip"), ("g.txt", "text/plain", None), (None, None, b"nameless")]
    return spark.createDataFrame(rows, "filename string, content_type string, content binary")


def test_samples(spark):
    got = {r["filename"]: r for r in upload_items(_files(spark), "set").collect()}
    assert {n: r["media_type"] for n, r in got.items()} == {"a.txt": "text", "b.md": "markdown", "c.csv": "excel", "d.png": "image", "e.xyz": "text", "f.xlsx": "excel", "g.txt": "text", None: "text"}
    assert got["a.txt"]["content_type"] == "application/octet-stream" and got["c.csv"]["content_type"] == "text/csv"
    assert {(r["source"], r["dataset"]) for r in got.values()} == {("manual_upload", "set")}


def test_parts_of_all_types_in_one_scan(spark):
    got = {r["filename"]: r for r in extract(upload_items(_files(spark))).collect()}
    assert got["a.txt"]["text"] == LONG and got["b.md"]["text"] == "Head\n\nsome bold text"
    assert got["c.csv"]["data"] == [["name", "age"], ["Ann", "3"], ["Bob", "4"]]
    assert got["d.png"]["error"] == "no extractor for image" and got["f.xlsx"]["error"].startswith("BadZipFile")
    assert got["e.xyz"]["text"] == "größer" and got["g.txt"]["text"] == "" and got[None]["text"] == "nameless"


def test_an_unknown_media_type_is_read_as_text(spark):
    rows = spark.createDataFrame([("a", "holo", b"x"), ("b", None, b"y")], "filename string, media_type string, content binary")
    assert [(r["filename"], r["text"], r["error"]) for r in extract(rows).orderBy("filename").collect()] == [("a", "x", None), ("b", "y", None)]


def test_a_registered_model_is_used_by_the_workers(spark):
    files.register("image", lambda name, content: iter([{"kind": "caption", "ord": 1, "text": f"{name} of {len(content)}"}]))
    try:
        made = strategies.chunk_elements(elements(extract(upload_items(_files(spark)))))
        assert [(r["chunk_type"], r["text"]) for r in made.where("doc_id = 'd.png'").collect()] == [("image_caption", "d.png of 4")]
    finally:
        del files.EXTRACTORS["image"]


def test_chunks_of_files(spark):
    made = strategies.chunk_elements(elements(extract(upload_items(_files(spark)))))
    got = {}
    for r in made.orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_type"], r["text"]))
    size, overlap = strategies.chunk_params_of(files.F.lit("text"), files.F.lit(len(LONG)))
    s, o = spark.range(1).select(size, overlap).first()
    assert [t for _, t in got["a.txt"]] == recursive_chunks(LONG, s, o) and len(got["a.txt"]) > 1
    assert got["c.csv"] == [("excel_sheet", "name是Ann，age是3\nname是Bob，age是4")]
    assert set(got) == {"a.txt", "b.md", "c.csv", "e.xyz", ""}


def test_files_of_one_name_in_different_folders_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "readme.txt").write_text(f"text of {folder}")
    (tmp_path / "top.txt").write_text("top")
    found = files.scan_files(spark, str(tmp_path))
    assert sorted(r.filename for r in found.collect()) == ["a/readme.txt", "b/readme.txt", "top.txt"]
    assert [r.filename for r in files.scan_files(spark, str(tmp_path / "top.txt")).collect()] == ["top.txt"]
    items = files.upload_items(files.classify(found.withColumn("content_type", F.lit("")), "filename")[0])
    texts = {r.doc_id: r.text for r in files.elements(files.extract(items)).collect()}
    assert texts == {"a/readme.txt": "text of a", "b/readme.txt": "text of b", "top.txt": "top"}


def test_files_are_read_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    items = files.upload_items(files.scan_files(spark, str(tmp_path)).withColumn("content_type", F.lit("")))
    chunks = strategies.chunk_elements(files.elements(files.extract(items)))
    assert "MapInPandas" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in chunks.collect()] == ["text"]


def test_parts_of_many_files_share_batches(spark):
    small = [("text", f"f{i}", b"x") for i in range(3000)] + [("excel", "t.csv", b"a,b\n1,\n"), ("image", "i.png", b""), ("text", None, None)]
    large = [("text", f"g{i}", b"y" * files.PART_BYTES) for i in range(3)]
    columns = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["media_type", "filename", "content"])
    made = list(files._part_batches(iter([columns(small), columns(large)]), files.EXTRACTORS, StructType.fromDDL(f"media_type string, {files._SCHEMA}")))
    assert sum(b.num_rows for b in made) == 3006 and len(made) == 5 and max(b.num_rows for b in made) <= files.PART_ROWS
    rows = {r["filename"]: r for b in made for r in b.to_pylist()}
    assert rows["t.csv"]["data"] == [["a", "b"], ["1", ""]] and rows["i.png"]["error"] == "no extractor for image" and rows[None]["text"] == "" and len(rows["g2"]["text"]) == files.PART_BYTES
