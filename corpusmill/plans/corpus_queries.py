"""Queries over metadata, chunking, deduplication, upserts and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import chunking, dedup, metadata, retrieval, strategies, unlike, upsert, where
from corpusmill.operators.models import LetterEmbedder, embed
from corpusmill.plans.text_queries import CLEANED, LINES, docs, lines, sql_clean, sql_letters, sql_normalize, sql_strip
from corpusmill.sources.files import classify, elements, extract, upload_items
from corpusmill.sources.tables import read_table

WHERE = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"$or": [{"text_len": {"$lt": 500}}, {"text_len": {"$gte": 5000}}]}, {"source": {"$ne": "src1"}}, {"tags": {"$contains": "t1"}}]}


def _raw_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of raw metadata: some values missing, empty or of the wrong kind."""
    k = F.col("doc_id")
    return docs(spark, sf, "text", "lang", "source").select(
        k.cast("string").alias("doc_id"), F.when(k % 5 == 0, "").otherwise(F.col("source")).alias("source"), "lang", F.length("text").alias("text_len"),
        F.when(k % 3 == 0, "0.5").when(k % 3 == 1, "x").alias("quality_score"), F.array(F.concat(F.lit(" t"), (k % 4).cast("string")), F.lit("")).alias("tags"), F.lit("a, b,c").alias("keyphrases"), (k % 7).cast("string").alias("page_number"), F.lit(1).alias("not_listed"),
    )


def metadata_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Raw metadata brought to the declared fields."""
    made = metadata.project_metadata(_raw_metadata(spark, sf))
    return made.select("doc_id", "source", "filename", "lang", "text_len", "quality_score", F.array_join("tags", "|").alias("tags"), F.array_join("keyphrases", "|").alias("keyphrases"), "page_number", "chunk_size")


def metadata_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The flat form, and arrays restored from it."""
    flat = metadata.flatten_metadata(metadata.project_metadata(_raw_metadata(spark, sf)), keep=("doc_id",))
    back = metadata.restore_arrays(flat.withColumn("flat_tags", F.col("keyphrases")))
    return back.select("doc_id", "source", "flat_tags", F.size("keyphrases").alias("n_keyphrases"), F.size("tags").alias("n_tags"))


def where_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The rows for which a nested predicate holds."""
    rows = metadata.project_metadata(_raw_metadata(spark, sf))
    return rows.where(where.compile_where(WHERE)).select("doc_id", "text_len")


def upload_files(spark: SparkSession, sf: str) -> DataFrame:
    """Invented uploads, accepted or rejected, duplicates left out."""
    k = F.col("doc_id")
    ext = F.get(F.array(*map(F.lit, (".txt", ".PDF", ".exe", "", ".Md"))), (k % 5).cast("int"))
    files = docs(spark, sf).select("doc_id", F.concat(F.lit("File"), (k % 50).cast("string"), ext).alias("filename"), F.when(k % 2 == 0, "text/plain").otherwise("Text/Plain").alias("content_type"))
    good, bad = classify(files, "doc_id")
    return good.select("doc_id", "filename", F.lit("").alias("reason")).unionByName(bad.select("doc_id", "filename", "reason"))


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as uploaded files: text, Markdown, tables, images without a model, and of an unknown type."""
    k = F.col("doc_id")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (k % 5).cast("int"))
    name = F.concat(F.lit("f"), k.cast("string"), pick(".txt", ".md", ".csv", ".png", ".bin"))
    cells = F.concat(F.lit("key,length\n"), k.cast("string"), F.lit(","), F.length("text").cast("string"), F.lit("\n"))
    body = F.when(k % 5 == 1, F.concat(F.lit("# Title\n"), F.translate("text", "`#*_[]()!", ""))).when(k % 5 == 2, cells).otherwise(F.col("text"))
    return docs(spark, sf, "text").select(name.alias("filename"), F.when(k % 2 == 0, "").alias("content_type"), F.encode(body, "UTF-8").alias("content"))


def upload_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads as raw samples with what is known of them."""
    made = upload_items(_uploads(spark, sf), "corpus")
    return made.select("filename", "content_type", "media_type", "source", "dataset", F.length("content").alias("n_bytes"))


def extracted_files(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of uploads of all media types."""
    made = extract(upload_items(_uploads(spark, sf)))
    cells = F.array_join(F.flatten("data"), "|")
    return made.select("filename", "media_type", "kind", "ord", F.md5(F.coalesce("text", cells, F.lit(""))).alias("digest"), "error")


def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """From uploads to chunks, each file by its media type: the type of a file's chunks and their number."""
    made = strategies.chunk_elements(elements(extract(upload_items(_uploads(spark, sf)))))
    return made.groupBy("doc_id").agg(F.max("chunk_type").alias("chunk_type"), F.max("total_chunks").alias("n"))


def document_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that name the document, its source or nothing before the text's."""
    k = F.col("doc_id")
    made = text.document_chunk_id(F.col("text"), F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, ""), F.col("source"))
    return docs(spark, sf, "text", "source").select("doc_id", made.alias("id"))


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut into windows of 512 characters that overlap by 76."""
    parts = docs(spark, sf, "text").select("doc_id", F.lit(0).alias("ord"), F.lit("pdf_page").alias("chunk_type"), "text")
    return chunking.split_parts(parts, 512, 76).select("doc_id", "chunk_index", F.md5("text").alias("digest"), "chunk_size", "total_chunks")


def media_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as pages, paragraphs or recognised regions, each cut by its media type's size and overlap."""
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 3).cast("int"))
    none = F.lit(None)
    elements = docs(spark, sf, "text").select("doc_id", pick("pdf", "word", "image").alias("media_type"), pick("page", "paragraph", "region").alias("kind"), F.lit(1).alias("ord"), "text", none.cast("array<array<string>>").alias("data"), none.cast("double").alias("start_time"), none.cast("double").alias("end_time"))
    return strategies.chunk_elements(elements).select("doc_id", "chunk_type", "chunk_index", F.md5("text").alias("digest"), "chunk_size", "total_chunks")


def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut by paragraphs and sentences."""
    t = docs(spark, sf, "text").withColumn("text", F.regexp_replace("text", r"\. ", "。"))
    return chunking.chunk_texts(t, "doc_id", "text")


def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut at the best separators."""
    return chunking.chunk_texts(docs(spark, sf, "text"), "doc_id", "text", recursive=True)


def table_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The nations of each region as a table, as text."""
    nations = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit(" ")).alias("r"))))
    data = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("x"))), F.transform(rows, lambda x: x["r"]))
    tables = nations.groupBy(F.col("n_regionkey").alias("doc_id")).agg(data.alias("data")).withColumn("table_index", F.lit(1))
    return chunking.table_parts(tables, "excel_sheet").select("doc_id", "text")


def ocr_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as recognised items, grouped by vertical gaps."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "value", "event_type")
    items = e.select(F.col("user_id").alias("doc_id"), F.concat(F.col("event_type"), F.lit("-"), F.col("event_id").cast("string")).alias("text"), ((F.col("event_id") % 10) / 10).alias("confidence"), (F.col("event_id") % 13).alias("x"), (F.col("event_id") * 37 % 1500).alias("y"))
    return chunking.regions(items).select("doc_id", "region_index", "text", "min_x", "max_x", "min_y", "max_y")


def subtitle_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations packed like subtitles."""
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    cue = F.struct("turn", F.col("text").alias("text"), (F.col("turn") * 2.0).alias("start_time"), (F.col("turn") * 2.0 + 1).alias("end_time"))
    cues = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    return cues.select("conv_id", F.posexplode(chunking.subtitle_chunks(F.col("cues"))).alias("chunk_index", "c")).select("conv_id", "chunk_index", "c.*")


def cleaned_items(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document, cleaned, filtered and deduplicated."""
    kept = dedup.clean_items(lines(spark, sf), "doc_id", "line_no", "line")
    return kept.select(F.col("id").alias("doc_id"), F.col("pos").alias("line_no"), F.md5("text").alias("digest"))


def cleaning_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines there are, and are left after each step of their cleaning."""
    return dedup.cleaning_counts(lines(spark, sf), "doc_id", "line_no", "line")


def cleaned_content(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as content of all shapes (a title, lines, and regions by their captions), cleaned."""
    parts = F.split("text", "\n")
    region = F.transform(parts, lambda t, i: F.struct(i.alias("no"), F.lit(None).cast("string").alias("text"), t.alias("caption")))
    made = docs(spark, sf, "text").select("doc_id", F.struct(F.get(parts, F.lit(0)).alias("title"), parts.alias("lines"), region.alias("regions")).alias("content"))
    cleaned = made.select("doc_id", dedup.clean_content(F.col("content"), made.schema["content"].dataType).alias("c"))
    digests = F.array_join(F.transform("c.lines", lambda t: F.md5(t)), ",")
    numbers = F.array_join(F.transform("c.regions", lambda r: r["no"].cast("string")), ",")
    return cleaned.select("doc_id", F.md5("c.title").alias("title"), F.md5(digests).alias("lines"), F.md5(numbers).alias("regions"))


def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each conversation that aren't near copies of an earlier one, by the letters they hold."""
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return dedup.greedy_near(turns.withColumn("vector", embed(F.col("text"), LetterEmbedder)), "conv_id", "turn", "vector")


def similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as one group, in order of their ids: those that aren't near copies of one kept before."""
    rows = read_table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("all", F.lit(0))
    return unlike.keep_unlike(rows, "all", "vec_id", "embedding").select(F.col("pos").alias("vec_id"))


def unlike_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of a language as one group: those whose letters aren't distributed like those of one kept before."""
    rows = docs(spark, sf, "text", "lang").withColumn("vector", embed(F.col("text"), LetterEmbedder))
    return unlike.keep_unlike(rows, "lang", "doc_id", "vector", 0.99).select(F.col("id").alias("lang"), F.col("pos").alias("doc_id"))


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk table: the documents of a source whose ids fall into the same hundred are a document's chunks, in order of their ids."""
    doc = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string"))
    order = Window.partitionBy("doc").orderBy("id")
    rows = docs(spark, sf, "text", "source").select(F.col("doc_id").alias("id"), doc.alias("doc"), "text")
    return rows.withColumn("chunk_index", F.row_number().over(order) - 1)


def next_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between neighbouring chunks."""
    return upsert.next_edges(chunk_table(spark, sf), "doc")


def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks within two steps of each hundredth chunk."""
    seeds = docs(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("id"))
    return retrieval.neighbours(seeds, next_edges(spark, sf), 2)


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as a batch of chunks, some of them changed since they were hashed."""
    d = docs(spark, sf, "text", "lang")
    ids = text.chunk_id(text.normalize(F.col("text")))
    changed = F.when(F.length("text") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select(ids.alias("id"), changed.alias("text"), "lang", F.col("doc_id").alias("seq"))


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    """The collection that is there already: all English documents."""
    d = docs(spark, sf, "text", "lang").where("lang = 'en'")
    return dedup.keep_first(d.withColumn("id", text.chunk_id(text.normalize(F.col("text")))), ["id"], ["doc_id"]).select("id", "text", "lang", F.col("doc_id").alias("seq"))


def upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What an upsert does with each chunk of a batch."""
    return upsert.classify(_batch(spark, sf), _existing(spark, sf), "seq", ("text", "lang")).select("id", "seq", "action")


def upsert_table(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table after the upsert."""
    old = _existing(spark, sf)
    new = upsert.upsert(old, upsert.classify(_batch(spark, sf), old, "seq", ("text", "lang")))
    return new.select("id", "seq", F.md5("text").alias("digest"))


def upsert_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks the upsert meets, writes and updates."""
    batch = _batch(spark, sf)
    return upsert.statistics(batch, upsert.classify(batch, _existing(spark, sf), "seq", ("text", "lang")))


def new_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the batch that the table doesn't hold."""
    return _batch(spark, sf).select("id").join(_existing(spark, sf), "id", "left_anti").distinct()


QUERIES = {f.__name__: f for f in (metadata_projection, metadata_flat, where_filter, upload_files, upload_samples, extracted_files, file_chunks, document_chunk_ids, chunk_windows, media_chunks, chunk_paragraphs, chunk_recursive, table_texts, ocr_regions, subtitle_chunks, cleaned_items, cleaning_counts, cleaned_content, similar_items, similar_vectors, unlike_documents, next_edges, graph_neighbours, upsert_actions, upsert_table, upsert_statistics, new_ids)}

_META = """
WITH r AS (SELECT doc_id AS k, doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source, lang, length(text) AS text_len FROM documents)"""
_CHUNKS = "SELECT doc_id AS id, concat_ws('-', source, doc_id // 100) AS doc, row_number() OVER (PARTITION BY concat_ws('-', source, doc_id // 100) ORDER BY doc_id) - 1 AS chunk_index FROM documents"
_EDGES = f"SELECT id AS src, dst FROM (SELECT id, lead(id) OVER (PARTITION BY doc ORDER BY chunk_index, id) AS dst FROM ({_CHUNKS})) WHERE dst IS NOT NULL"
_ID = f"substr(sha1({sql_normalize('text')}), 1, 16)"
_UPSERT = f"""
WITH raw AS (SELECT {_ID} AS id, CASE WHEN length(text) % 7 = 0 THEN text || '!' ELSE text END AS text, lang, doc_id AS seq FROM documents),
b AS (SELECT * FROM raw WHERE id <> '' AND text <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
e AS (SELECT {_ID} AS id, text, lang, doc_id AS seq FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY doc_id) = 1),
c AS (SELECT b.*, CASE WHEN e.id IS NULL THEN 'new' WHEN e.text IS DISTINCT FROM b.text OR e.lang IS DISTINCT FROM b.lang THEN 'update' ELSE 'same' END AS action FROM b LEFT JOIN e USING (id))"""



def _greedy(vectors: str, threshold: float) -> str:
    """Going through each group of ``vectors`` (id, pos, v) item by item."""
    return f"""
WITH RECURSIVE l AS ({vectors}),
u AS (SELECT id, pos, n, list_transform(v, lambda x: x / coalesce(nullif(n, 0), 1)) AS v, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM l)),
s AS (SELECT id, pos, i, true AS stays, CASE WHEN n > 0 THEN [v] ELSE [] END AS kept FROM u WHERE i = 1
  UNION ALL SELECT id, pos, i, stays, CASE WHEN stays AND n > 0 THEN list_append(kept, v) ELSE kept END FROM (
    SELECT u.*, s.kept, u.n = 0 OR coalesce(list_max(list_transform(s.kept, lambda k: list_dot_product(k, u.v))) < {threshold}, true) AS stays FROM s JOIN u ON u.id = s.id AND u.i = s.i + 1))
SELECT id, pos FROM s WHERE stays"""


SQL = {
    "metadata_projection": _META + """
SELECT doc_id, coalesce(source, '') AS source, '' AS filename, coalesce(lang, '') AS lang, text_len, CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN NULL ELSE 0.0::DOUBLE END AS quality_score,
  't' || (k % 4) AS tags, 'a, b,c' AS keyphrases, k % 7 AS page_number, 0::BIGINT AS chunk_size FROM r""",
    "metadata_flat": _META + " SELECT doc_id, nullif(source, '') AS source, 'a, b,c' AS flat_tags, 3 AS n_keyphrases, 1 AS n_tags FROM r",
    "where_filter": _META + """
SELECT doc_id, text_len FROM r WHERE lang IN ('en', 'de') AND (text_len < 500 OR text_len >= 5000) AND source <> 'src1' AND k % 4 = 1""",
    "upload_files": """
WITH f AS (SELECT doc_id, 'File' || (doc_id % 50) || ['.txt', '.PDF', '.exe', '', '.Md'][doc_id % 5 + 1] AS filename, doc_id % 5 AS e FROM documents)
(SELECT doc_id, filename, '' AS reason FROM f WHERE e IN (0, 1, 4) QUALIFY row_number() OVER (PARTITION BY lower(filename) ORDER BY doc_id) = 1)
UNION ALL SELECT doc_id, filename, CASE e WHEN 2 THEN 'unsupported extension: ''.exe''' ELSE 'unsupported extension: ''N/A''' END FROM f WHERE e IN (2, 3)""",
    "upload_samples": """
SELECT 'f' || doc_id || ['.txt', '.md', '.csv', '.png', '.bin'][doc_id % 5 + 1] AS filename, 'application/octet-stream' AS content_type, ['text', 'markdown', 'excel', 'image', 'text'][doc_id % 5 + 1] AS media_type,
  'manual_upload' AS source, 'corpus' AS dataset, strlen(CASE doc_id % 5 WHEN 1 THEN '# Title' || chr(10) || translate(text, '`#*_[]()!', '') WHEN 2 THEN 'key,length' || chr(10) || doc_id || ',' || length(text) || chr(10) ELSE text END)::INT AS n_bytes FROM documents""",
    "extracted_files": """
SELECT 'f' || doc_id || ['.txt', '.md', '.csv', '.png', '.bin'][doc_id % 5 + 1] AS filename, ['text', 'markdown', 'excel', 'image', 'text'][doc_id % 5 + 1] AS media_type,
  ['text', 'text', 'table', NULL, 'text'][doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 5 <> 3 THEN 1 END AS ord,
  md5(CASE doc_id % 5 WHEN 1 THEN 'Title' || chr(10) || translate(text, '`#*_[]()!', '') WHEN 2 THEN 'key|length|' || doc_id || '|' || length(text) WHEN 3 THEN '' ELSE text END) AS digest,
  CASE WHEN doc_id % 5 = 3 THEN 'no extractor for image' END AS error FROM documents""",
    "document_chunk_ids": f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE coalesce(source, '') END || ':' || substr(sha1({sql_normalize('text')}), 1, 16) AS id FROM documents""",
    "chunk_windows": f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length({sql_strip("text")}) > 0),
k AS (SELECT *, CASE WHEN n <= 512 THEN 0 ELSE ceil((n - 512) / 436.0::DOUBLE)::INT END AS last FROM d),
s AS (SELECT doc_id, text, n, i * 436 AS a, least(i * 436 + 512, n) AS b FROM k, unnest(range(0, last + 1)) AS u(i)
  UNION ALL SELECT doc_id, text, n, n - 76, n FROM k WHERE n > 512 AND n - 76 > last * 436)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index, md5(substr(text, a + 1, b - a)) AS digest, (b - a)::INT AS chunk_size, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM s""",
    "media_chunks": f"""
WITH m AS (SELECT doc_id, text, length(text) AS n, doc_id % 3 AS m, floor(length(text) / 1.6::DOUBLE) < 614.4 AS short FROM documents WHERE length({sql_strip("text")}) > 0),
d AS (SELECT *, CASE m WHEN 0 THEN 540 ELSE 512 END AS size, CASE m WHEN 0 THEN 90 WHEN 1 THEN CASE WHEN short THEN 75 ELSE 76 END ELSE CASE WHEN short THEN 40 ELSE 76 END END AS lap FROM m),
k AS (SELECT *, CASE WHEN n <= size THEN 0 ELSE ceil((n - size) / (size - lap)::DOUBLE)::INT END AS last FROM d),
s AS (SELECT doc_id, m, size, text, n, i * (size - lap) AS a, least(i * (size - lap) + size, n) AS b FROM k, unnest(range(0, last + 1)) AS u(i)
  UNION ALL SELECT doc_id, m, size, text, n, n - lap, n FROM k WHERE n > size AND n - lap > last * (size - lap))
SELECT doc_id, CASE m WHEN 0 THEN 'pdf_page' WHEN 1 THEN 'word_paragraph' ELSE CASE WHEN n > size THEN 'image_region_part' ELSE 'image_region' END END AS chunk_type,
  (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index, md5(substr(text, a + 1, b - a)) AS digest, (b - a)::INT AS chunk_size, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM s""",
    "table_texts": """
SELECT n_regionkey AS doc_id, string_agg('key是' || n_nationkey || '，name是' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""",
    "ocr_regions": """
WITH i AS (SELECT user_id AS doc_id, event_type || '-' || event_id AS text, event_id % 13 AS x, event_id * 37 % 1500 AS y FROM events WHERE event_id % 10 >= 5),
g AS (SELECT *, coalesce((abs(y - lag(y) OVER w) >= 20)::INT, 0) AS gap FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY y, x, text)),
r AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY y, x, text) AS region FROM g)
SELECT doc_id, region::BIGINT AS region_index, string_agg(text, ' ' ORDER BY y, x, text) AS text, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM r GROUP BY doc_id, region""",
    "subtitle_chunks": f"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(text, '') AS t, turn * 2.0::DOUBLE AS a, turn * 2.0::DOUBLE + 1 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
s AS (SELECT conv_id, i, 0 AS k, t, a, b FROM c WHERE i = 1
  UNION ALL SELECT c.conv_id, c.i, CASE WHEN length(s.t) + length(c.t) <= 600 OR s.t = '' THEN k ELSE k + 1 END,
    CASE WHEN length(s.t) + length(c.t) > 600 OR s.t = '' THEN c.t ELSE s.t || ' ' || c.t END,
    CASE WHEN length(s.t) + length(c.t) <= 600 AND s.t <> '' THEN s.a ELSE c.a END, c.b FROM s JOIN c ON c.conv_id = s.conv_id AND c.i = s.i + 1)
SELECT conv_id, k AS chunk_index, {sql_strip("t")} AS text, a AS start_time, b AS end_time, length(t)::INT AS chunk_size FROM s WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY i DESC) = 1""",
    "cleaned_items": CLEANED,
    "cleaning_counts": f"""
WITH c AS ({CLEANED.split("QUALIFY")[0]})
SELECT (SELECT count(*) FROM {LINES}) AS original, (SELECT count(*) FROM {LINES} WHERE {sql_clean("line")} <> '') AS cleaned, (SELECT count(*) FROM c) AS filtered, (SELECT count(*) FROM (SELECT DISTINCT doc_id, digest FROM c)) AS final""",
    "cleaned_content": f"""
WITH k AS ({CLEANED}),
g AS (SELECT doc_id, string_agg(digest, ',' ORDER BY line_no) AS l, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS n FROM k GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS n, bool_or({sql_strip("line")} <> '') AS filled FROM {LINES} GROUP BY doc_id)
SELECT doc_id, md5({sql_clean("string_split(text, chr(10))[1]")}) AS title, md5(coalesce(l, '')) AS lines, md5(CASE WHEN filled THEN coalesce(g.n, '') ELSE a.n END) AS regions
FROM documents JOIN a USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "similar_items": _greedy(f"""SELECT conv_id AS id, turn AS pos, {sql_letters("lower(coalesce(text, ''))")} AS v FROM conversations""", 0.95),
    "similar_vectors": _greedy("SELECT 0 AS id, vec_id AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings", 0.95).replace("SELECT id, pos FROM s", "SELECT pos AS vec_id FROM s"),
    "unlike_documents": _greedy(f"""SELECT lang AS id, doc_id AS pos, {sql_letters("lower(coalesce(text, ''))")} AS v FROM documents""", 0.99).replace("SELECT id, pos FROM s", "SELECT id AS lang, pos AS doc_id FROM s"),
    "next_edges": _EDGES,
    "graph_neighbours": f"""
WITH edges AS ({_EDGES}), both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT doc_id AS qid, dst AS id, 1 AS hops FROM documents JOIN both_ways ON doc_id = src WHERE doc_id % 100 = 0),
two AS (SELECT qid, dst AS id, 2 AS hops FROM one JOIN both_ways ON id = src)
SELECT qid, id, min(hops)::INT AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE id <> qid GROUP BY qid, id""",
    "upsert_actions": _UPSERT + " SELECT id, seq, action FROM c",
    "upsert_table": _UPSERT + """
SELECT id, seq, md5(text) AS digest FROM (SELECT id, text, seq FROM c WHERE action <> 'same' UNION ALL SELECT id, text, seq FROM e WHERE id NOT IN (SELECT id FROM c WHERE action <> 'same'))""",
    "upsert_statistics": _UPSERT + """
SELECT (SELECT count(*) FROM raw) AS raw, count(*) AS batch_dedup, count(*) FILTER (action <> 'new') AS existed, count(*) FILTER (action = 'new') AS written, count(*) FILTER (action = 'update') AS updated FROM c""",
    "new_ids": _UPSERT + " SELECT DISTINCT id FROM raw WHERE id NOT IN (SELECT id FROM e)",
}
