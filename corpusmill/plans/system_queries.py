"""Queries over stores, ingest by streams, decoding, conditions as strings and small functions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.arithmetic import evaluated
from corpusmill.operators import cells, index, ocr, plugins, retrieval, where
from corpusmill.operators.models import best_captions
from corpusmill.plans.retrieval_queries import _CLAUSES, _KEYWORD, _TERMS, _VECTOR, NOW, _asked, _questions, _vectors, conditional_questions
from corpusmill.plans.text_queries import docs, sql_normalize
from corpusmill.sources.files import decode_text
from corpusmill.sources.store import Store
from corpusmill.sources.tables import read_table, shared_dir
from corpusmill.streaming import events as streams


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{kind}/{uuid.uuid4().hex}"


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A collection after rows were written, added, updated, deleted by condition and by id, and it got another name."""
    rows = lambda condition, lang: docs(spark, sf, "lang").where(condition).select(F.col("doc_id").alias("id"), lang.alias("lang"))
    store = Store(spark, _folder(spark, "stores"))
    store.write("old", rows("doc_id % 3 = 0", F.col("lang")))
    store.add("old", rows("doc_id % 3 <> 2", F.lit("added")))
    store.update("old", rows("doc_id % 5 = 0", F.lit("updated")))
    store.delete("old", where=F.col("id") % 7 == 0)
    store.delete("old", ids=rows("doc_id % 11 = 0", F.col("lang")))
    store.rename("old", "new")
    return store.get("new", rows("doc_id % 2 = 0 OR doc_id % 5 = 0", F.col("lang")))


def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """All documents ingested by a stream; of the inverted index that it kept up, each term's rows and places."""
    root = _folder(spark, "streams")
    source = streams.read_stream(spark, f"{sf.rstrip('/')}/document[s].parquet", docs(spark, sf, "text", "source").schema)

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.select(text.chunk_id(text.normalize(F.col("text"))).alias("id"), "text", F.col("doc_id").alias("seq"), F.col("source").alias("doc"), F.col("doc_id").alias("chunk_index"))

    store = Store(spark, f"{root}/store")
    streams.ingest(source, prepare, store, "chunks", f"{root}/checkpoint", "seq", indexed=True).awaitTermination()
    return store.read("chunks_postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("places"))


def stored_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for the benchmark's passages, from a stored index of all documents."""
    store = Store(spark, _folder(spark, "index"))
    index.build(store, "documents", docs(spark, sf, "text"), "doc_id")
    return index.search(store, "documents", _questions(spark, sf), 10)


def stored_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, from cells of all vectors."""
    store = Store(spark, _folder(spark, "cells"))
    cells.build(store, "vectors", _vectors(spark, sf).select("id", "vector"))
    return cells.search(store, "vectors", _asked(spark, sf), 10)


def substring_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents that hold the first words of each benchmark passage most often."""
    asked = read_table(spark, sf, "benchmark", "item_id", "text").select(F.col("item_id").alias("qid"), F.substring("text", 1, 12).alias("query"))
    return retrieval.substring_search(asked, docs(spark, sf, "text").withColumnRenamed("doc_id", "id"), 10)


def _reader(images: list[bytes]) -> list[list[tuple]]:
    """A stand-in for an engine: it fails on some images, is unsure of others and finds nothing in more."""
    def read(image: bytes) -> list[tuple]:
        name, number = image.decode().rsplit("-", 1)
        if int(number) % 5 == 0:
            raise ValueError("unreadable")
        return [] if int(number) % 7 == 0 else [(name, 0.25 if int(number) % 3 == 0 else 0.75, 0.0, 0.0)]

    return [read(i) for i in images]


def recognised_images(spark: SparkSession, sf: str) -> DataFrame:
    """Events as images, read by a chain of three stand-ins: which engine's text stays, and how many before it did worse."""
    images = read_table(spark, sf, "events", "event_id", "event_type").select("event_id", F.encode(F.concat_ws("-", "event_type", "event_id"), "UTF-8").alias("content"))
    second = lambda found: [[(i.decode().upper(), 0.5, 0.0, 0.0)] if i.endswith((b"0", b"7")) else [] for i in found]
    last = lambda found: [[(i.decode(), 0.125, 1.0, 2.0)] for i in found]
    made = ocr.recognise(images, [("reader", _reader), ("second", second), ("last", last)])
    return made.select("event_id", "engine", F.get("regions", F.lit(0))["text"].alias("text"), F.size("errors").alias("n_errors"))


class _Lines:
    """A registered strategy: a text's lines."""

    def cut(self, text: str, size: int, overlap: int) -> list[str]:
        return text.split("\n")


def registered_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut by a registered strategy, or for every seventh by one that isn't there."""
    registry = plugins.Registry()
    registry.register("lines", _Lines)
    name = F.when(F.col("doc_id") % 7 == 0, "missing").otherwise("Lines")
    rows = docs(spark, sf, "text").select("doc_id", name.alias("strategy"), "text", F.lit(512).alias("size"), F.lit(0).alias("overlap"))
    return plugins.cut_by(registry, rows).select("doc_id", "chunk_index", F.md5("text").alias("digest"), "error")


def decoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts from bytes that are UTF-8, or for every third neither that nor GB 18030."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode(plain, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, sf, "text").select("doc_id", F.md5(decode_text(body)).alias("digest"))


def condition_strings(spark: SparkSession, sf: str) -> DataFrame:
    """What a batch of questions asks, as filter strings."""
    found = where.clause_columns(F.col("query"), where.Context(now=NOW))
    return conditional_questions(spark, sf).select("qid", where.filter_column(found).alias("filter"))


def arithmetic_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of expressions, some of which aren't arithmetic."""
    number = F.col("event_id").cast("string")
    made = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("f("), number, F.lit(")"))).otherwise(F.concat(F.lit("-("), number, F.lit(" + 2) * 3 / 4")))
    return read_table(spark, sf, "events", "event_id").select("event_id", evaluated(made).alias("value"))


def chosen_captions(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest captions of events with three candidates."""
    chances = F.array(F.round(F.col("value") / 1000, 3), F.lit(0.15), F.col("event_id") % 10 / 20)
    made = best_captions(F.array(*map(F.lit, "abc")), chances)
    return read_table(spark, sf, "events", "event_id", "value").select("event_id", F.array_join(made, ",").alias("captions"))


QUERIES = {f.__name__: f for f in (stored_chunks, stream_index, stored_keyword_search, stored_vector_search, substring_hits, recognised_images, registered_strategies, decoded_texts, condition_strings, arithmetic_values, chosen_captions)}

SQL = {
    "stored_chunks": """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'updated' WHEN doc_id % 3 = 0 THEN lang ELSE 'added' END AS lang FROM documents
WHERE doc_id % 3 <> 2 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND (doc_id % 2 = 0 OR doc_id % 5 = 0)""",
    "stream_index": f"""
WITH d AS (SELECT substr(sha1({sql_normalize('text')}), 1, 16) AS id, text, doc_id FROM documents WHERE text <> ''),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1),
p AS (SELECT id, unnest({_TERMS.format("text")}) AS term FROM o)
SELECT term, count(DISTINCT id) AS df, count(*) AS places FROM p GROUP BY term""",
    "stored_keyword_search": _KEYWORD,
    "stored_vector_search": _VECTOR,
    "substring_hits": """
SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM (
  SELECT q.item_id AS qid, doc_id AS id, (length(d.text) - length(replace(d.text, q.q, ''))) // length(q.q) AS score
  FROM (SELECT item_id, substr(text, 1, 12) AS q FROM benchmark) AS q JOIN documents AS d ON contains(d.text, q.q)) QUALIFY rank <= 10""",
    "recognised_images": """
WITH i AS (SELECT event_id, event_type, event_id % 5 = 0 AS fails, event_id % 5 <> 0 AND event_id % 7 = 0 AS blank, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 = 0 AS unsure, event_id % 10 IN (0, 7) AS ends FROM events),
e AS (SELECT *, CASE WHEN NOT (fails OR blank OR unsure) THEN 'reader' WHEN ends THEN 'second' WHEN unsure THEN 'reader' ELSE 'last' END AS engine FROM i)
SELECT event_id, engine, CASE engine WHEN 'reader' THEN event_type WHEN 'second' THEN upper(event_type || '-' || event_id) ELSE event_type || '-' || event_id END AS text,
  CASE WHEN NOT (fails OR blank OR unsure) THEN 0 WHEN ends THEN 1 ELSE 3 END AS n_errors FROM e""",
    "registered_strategies": r"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents WHERE doc_id % 7 <> 0))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, md5(line) AS digest, NULL::VARCHAR AS error FROM l WHERE regexp_matches(line, '[^\s]')
UNION ALL SELECT doc_id, 0, NULL, 'no such name: missing' FROM documents WHERE doc_id % 7 = 0""",
    "decoded_texts": r"""
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\x00-\x7F]', '', 'g') || 'ÿ' ELSE text END) AS digest FROM documents""",
    "condition_strings": f"""
SELECT item_id * 100 AS qid, concat_ws(' AND ', 'lang = ''' || lang || '''', 'media_type = ''' || media_type || '''', 'quality_score >= ' || quality, CASE WHEN recent THEN 'created_at >= ''2024-01-13T12:00:00''' END) AS filter FROM ({_CLAUSES})""",
    "arithmetic_values": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN -(event_id + 2)::DOUBLE * 3 / 4 END AS value FROM events",
    "chosen_captions": """
WITH t AS (SELECT event_id, list_reverse_sort([{'p': round(value / 1000, 3)::DOUBLE, 'c': 'a'}, {'p': 0.15::DOUBLE, 'c': 'b'}, {'p': (event_id % 10) / 20::DOUBLE, 'c': 'c'}])[1:2] AS l FROM events),
g AS (SELECT event_id, l, list_filter(l, lambda x: x.p >= 0.2::DOUBLE) AS g FROM t)
SELECT event_id, array_to_string(list_transform(CASE WHEN len(g) > 0 THEN g ELSE l[1:1] END, lambda x: x.c), ',') AS captions FROM g""",
}
