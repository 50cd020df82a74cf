import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.operators import metadata, models, monitoring, retrieval, upsert
from corpusmill.sources import files, sinks
from corpusmill.sources.store import Store
from corpusmill.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_upsert_is_idempotent(spark):
    old = frame(spark, [("a", "1", 0), ("b", "2", 1)], "id string, text string, seq int")
    batch = frame(spark, [("a", "1", 0), ("b", "3", 1), ("c", "4", 2), ("c", "5", 3), ("", "x", 4), ("d", None, 5)], "id string, text string, seq int")
    changes = upsert.classify(batch, old, "seq", ("text",))
    assert {(r.id, r.action) for r in changes.collect()} == {("a", "same"), ("b", "update"), ("c", "new")}
    new = upsert.upsert(old, changes)
    assert {(r.id, r.text) for r in new.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {r.action for r in upsert.classify(batch, new, "seq", ("text",)).collect()} == {"same"}
    assert upsert.statistics(batch, changes).first().asDict() == {"raw": 6, "batch_dedup": 3, "existed": 2, "written": 1, "updated": 1}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.collections() == [] and not store.exists("x")
    with pytest.raises(KeyError):
        store.read("x")
    store.add("x", frame(spark, [("a", 1), ("b", 2)], "id string, v int"))
    store.add("x", frame(spark, [("a", 9), ("c", 3)], "id string, v int"))
    store.update("x", frame(spark, [("b", 7), ("z", 0)], "id string, v int"))
    assert {(r.id, r.v) for r in store.read("x").collect()} == {("a", 1), ("b", 7), ("c", 3)}
    assert store.get("x", frame(spark, [("a",), ("q",)], "id string")).count() == 1
    store.delete("x", where=F.col("v") > 5)
    store.delete("x", ids=frame(spark, [("a",)], "id string"))
    assert store.count("x") == 1 and store.peek("x", 5).count() == 1
    store.rename("x", "y")
    assert store.collections() == ["y"]
    store.drop("y")
    assert store.collections() == []


def test_stream_ingest_equals_batch(spark, tmp_path):
    frame(spark, [("a", "1", 0), ("b", "2", 1)], "id string, text string, seq int").write.parquet(f"{tmp_path}/in/p1")
    frame(spark, [("b", "3", 2), ("c", "4", 3)], "id string, text string, seq int").write.parquet(f"{tmp_path}/in/p2")
    store = Store(spark, f"file://{tmp_path}/store")
    source = events.read_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/p1").schema, 1)
    events.ingest(source, lambda df: df, store, "chunks", f"{tmp_path}/cp", "seq").awaitTermination()
    assert {r.id for r in store.read("chunks").collect()} == {"a", "b", "c"}


def test_stream_ingest_keeps_derived_tables(spark, tmp_path):
    schema = "id string, text string, seq int, doc string, chunk_index int"
    frame(spark, [("a", "red red", 0, "d", 0), ("b", "blue", 1, "d", 1)], schema).write.parquet(f"{tmp_path}/in/p1")
    frame(spark, [("b", "green", 2, "d", 1), ("c", "red", 3, "d", 2)], schema).write.parquet(f"{tmp_path}/in/p2")
    store = Store(spark, f"file://{tmp_path}/store")
    source = events.read_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/p1").schema, 1)
    events.ingest(source, lambda df: df, store, "chunks", f"{tmp_path}/cp", "seq", indexed=True).awaitTermination()
    chunks = store.read("chunks")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(store.read("chunks_postings").select("term", "id", "tf")) == rows(upsert.postings(chunks).select("term", "id", "tf"))
    assert rows(store.read("chunks_edges")) == {("a", "b"), ("b", "c")}
    assert rows(store.read("chunks_documents")) == {("a", "d"), ("b", "d"), ("c", "d")}


def test_metadata(spark):
    df = frame(spark, [("x", "", "1.5", "yes", None), ("y", "s", "bad", "?", ["a,b", " "])], "doc_id string, source string, quality_score string, flag string, tags array<string>")
    fields = (("doc_id", "string"), ("source", "string"), ("quality_score", "number"), ("flag", "boolean"), ("tags", "array"), ("missing", "number"))
    got = metadata.project_metadata(df, fields).orderBy("doc_id").collect()
    assert tuple(got[0]) == ("x", "", 1.5, True, [], 0)
    assert tuple(got[1]) == ("y", "s", None, None, ["a,b"], 0)
    flat = metadata.flatten_metadata(metadata.project_metadata(df, fields), keep=("doc_id",))
    assert [r.tags for r in metadata.restore_arrays(flat).orderBy("doc_id").collect()] == [[], ["a", "b"]]


def test_fusion(spark):
    v = frame(spark, [(1, i, 1.0 - n / 10, n + 1) for n, i in enumerate("abc")], "qid int, id string, score double, rank int")
    k = frame(spark, [(1, i, 0.5 - n / 10, n + 1) for n, i in enumerate("cda")], "qid int, id string, score double, rank int")
    got = {r.id: r.rrf for r in retrieval.rrf(v, k).collect()}
    assert got == pytest.approx({"a": 0.03226646, "c": 0.03226646, "b": 0.01612903, "d": 0.01612903}, abs=1e-6)
    alone = frame(spark, [(2, "z", 1.0, 1)], "qid int, id string, score double, rank int")
    assert {(r.qid, r.id) for r in retrieval.fuse(v.union(alone), k).collect()} >= {(2, "z")}
    best = retrieval.rerank(v, F.when(F.col("id") == "c", 9.0), 2).orderBy("rank").collect()
    assert [r.id for r in best] == ["c", "a"]


def test_context(spark):
    hits = frame(spark, [(1, n, 1.0, n, "x" * 10) for n in (1, 2, 3)] + [(2, 1, 1.0, 1, "y" * 99)], "qid int, id int, score double, rank int, text string")
    got = {r.qid: r for r in retrieval.build_context(hits, max_tokens=20).collect()}
    assert (got[1].used_tokens, got[1].from_items, got[1].citations) == (20, [1, 2], [1, 2, 3])
    assert (got[2].text, got[2].used_tokens, got[2].from_items, got[2].citations) == ("", 0, [], [1])
    asked = frame(spark, [(1, "why"), (3, "none")], "qid int, query string")
    made = {r.qid: r for r in retrieval.prompts(hits, asked, "{query}: {context}").collect()}
    assert made[1].prompt.startswith("why: xxx") and made[3].prompt is None and made[3].answer


def test_health(spark):
    checks = frame(spark, [("a", "healthy"), ("b", "degraded")], "component string, status string")
    assert monitoring.overall_status(checks).first().status == "degraded"
    assert monitoring.overall_status(checks.limit(0)).first().status == "unknown"


def test_models(spark):
    df = frame(spark, [("hello world",), ("",), (None,)], "t string").select(models.embed(F.col("t")).alias("v"))
    got = [r.v for r in df.collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1) and got[1] is None and got[2] is None
    caps = spark.range(1).select(models.best_captions(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0.1), F.lit(0.15), F.lit(0.05))).alias("c")).first()
    assert caps.c == ["b"]


def _book():
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"/></row></sheetData></worksheet>')
    return out.getvalue()


def _document():
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    for name, content in (("a.xlsx", _book()), ("b.csv", "h,i\n,\n1,é".encode("latin-1")), ("bad.xlsx", b"no zip")):
        (tmp_path / name).write_bytes(content)
    rows = files.extract(files.scan_files(spark, str(tmp_path)), "excel").collect()
    got = {r.filename: r for r in rows}
    assert got["a.xlsx"].data == [["name", "", "5"]] and got["a.xlsx"].name == "S"
    assert got["b.csv"].data[0] == ["h", "i"] and len(got["b.csv"].data) == 2
    assert got["bad.xlsx"].error.startswith("BadZipFile")
    word = files.extract(frame(spark, [("d.docx", bytearray(_document()))], "filename string, content binary"), "word").orderBy("kind").collect()
    assert [(r.kind, r.text, r.level, r.data) for r in word] == [("paragraph", "Title", 2, None), ("table", None, None, [["x"]])]


def test_text_files(spark):
    df = frame(spark, [(bytearray("héllo".encode()),), (bytearray("你好".encode("gb18030")),), (None,)], "c binary")
    assert [r[0] for r in df.select(files.decode_text(F.col("c"))).collect()] == ["héllo", "你好", None]
    with pytest.raises(ValueError):
        files.require_accepted(df.limit(0))


def test_settings():
    s = Settings.from_json('{"retrieval": {"rrf_k": 10}, "stopwords": ["a"]}')
    assert s.retrieval.rrf_k == 10 and s.retrieval.method == "rrf" and s.stopwords == ("a",)
    with pytest.raises(AttributeError):
        Settings.from_json('{"nothing": 1}')


def test_sinks(spark, tmp_path):
    rows = frame(spark, [("login", "u1", True), ("delete", None, False)], "a string, u string, ok boolean")
    records = rows.select(*sinks.audit_record(F.col("a"), F.lit("doc"), F.col("u"), F.col("ok"), details=F.struct("a")))
    for _ in range(2):
        observed, seen = sinks.counted(records, "audit", failed=~F.col("success"))
        sinks.append_json(observed, f"{tmp_path}/audit")
        assert seen.get == {"rows": 2, "failed": 1}
    back = spark.read.json(f"{tmp_path}/audit")
    assert back.count() == 4 and back.where("success = false").first().details == '{"a":"delete"}'
    sinks.append_parquet(rows, f"{tmp_path}/p", ("a",))
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_index_follows_upsert(spark):
    old = frame(spark, [("a", "x y", 0)], "id string, text string, seq int")
    changes = upsert.classify(frame(spark, [("a", "x z z", 0), ("b", "y", 1)], "id string, text string, seq int"), old, "seq", ("text",))
    got = {tuple(r) for r in upsert.refresh_postings(upsert.postings(old), changes).collect()}
    assert got == {("x", "a", 1), ("z", "a", 2), ("y", "b", 1)}


def test_vector_search_passes_over_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(6)]
    odd = [(100 + i, v) for i, v in enumerate([[nan, 0.0], [0.0, nan], [None, 1.0], [inf, 0.0], [1.0, -inf], None])]
    chunks = spark.createDataFrame(good + odd, "id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, None)], "qid long, vector array<double>")
    got = retrieval.vector_search(asked, chunks, 2).collect()
    assert [(r.qid, r.id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0, 1), (1, 3, 1.0, 2)]
