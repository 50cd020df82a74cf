"""Queries over search, fusion, contexts and monitoring, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import answering, monitoring, retrieval, upsert, where
from corpusmill.operators.models import LetterEmbedder, embed
from corpusmill.plans.corpus_queries import _EDGES, next_edges
from corpusmill.plans.text_queries import SP, docs, sql_count, sql_letters, sql_strip
from corpusmill.sources.tables import materialise, read_table, shared_dir
from corpusmill.streaming import events as streams

NOW = datetime(2024, 1, 20, 12, 0, 0)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("qid"), "vector")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark passages as questions; their ids are hundreds, like those of the vectors that are asked for."""
    return read_table(spark, sf, "benchmark", "item_id", "text").select((F.col("item_id") * 100).alias("qid"), F.col("text").alias("query"))


#: What is put before the benchmark's passages, by item, to make questions with conditions of them.
_ASKS = ("近一周 质量>=0.8 视频 ", "quality > 0.6 image ", "查找图片文件和其他很多很多的中文内容", "pdf 质量至少1.5 ", "")


def inferred_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """What a batch of questions asks of language, media type, quality and age."""
    ask = F.get(F.array(*map(F.lit, _ASKS)), (F.col("item_id") % len(_ASKS)).cast("int"))
    found = where.clause_columns(F.concat(ask, "text"), where.Context(now=NOW))
    return read_table(spark, sf, "benchmark", "item_id", "text").select("item_id", found["lang"].alias("lang"), found["media_type"].alias("media_type"), found["quality_score"].alias("quality"), found["created_at"].isNotNull().alias("recent"))


def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return retrieval.vector_search(_asked(spark, sf), _vectors(spark, sf), 10)


def vector_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same among vectors of one label, with a threshold."""
    return retrieval.vector_search(_asked(spark, sf), _vectors(spark, sf), 10, "cosine_distance", 0.3, F.col("label") == 1)


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for the benchmark's passages."""
    d = docs(spark, sf, "text")
    return retrieval.bm25(_questions(spark, sf), upsert.postings(d, "doc_id"), upsert.lengths(d, "doc_id"), 10)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and keyword hits fused by ranks."""
    return retrieval.rrf(vector_search(spark, sf), keyword_search(spark, sf))


def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """The same fused by scores."""
    return retrieval.weighted_sum(vector_search(spark, sf), keyword_search(spark, sf))


def graph_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """All keyword hits, followed by ten of their neighbours at most."""
    hits = materialise(keyword_search(spark, sf), "hits")
    return retrieval.expand(hits, next_edges(spark, sf), 1, 10)


def _with_text(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_search(spark, sf).join(docs(spark, sf, "text").withColumnRenamed("doc_id", "id"), "id")


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of at most 6000 characters."""
    made = retrieval.build_context(_with_text(spark, sf), max_tokens=6000)
    return made.select("qid", F.md5("text").alias("digest"), "used_tokens", F.array_join("from_items", ",").alias("from_items"), F.array_join("citations", ",").alias("citations"))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    """The first three hits' texts."""
    return retrieval.preview(_with_text(spark, sf)).select("qid", F.md5("preview").alias("digest"), F.length("preview").alias("n"))


def conditional_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's passages with conditions put before them, as questions."""
    ask = F.get(F.array(*map(F.lit, _ASKS)), (F.col("item_id") % len(_ASKS)).cast("int"))
    return read_table(spark, sf, "benchmark", "item_id", "text").select((F.col("item_id") * 100).alias("qid"), F.concat(ask, "text").alias("query"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as chunks with the fields that conditions are about."""
    k = F.col("doc_id")
    media = F.get(F.array(*map(F.lit, ("text", "image", "video", "pdf"))), (k % 4).cast("int"))
    made = F.lit(NOW) - F.make_interval(days=(k % 14).cast("int"))
    return docs(spark, sf, "text", "lang").select(k.alias("id"), "text", "lang", media.alias("media_type"), (k % 10 / 10).alias("quality_score"), made.alias("created_at"))


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).withColumn("vector", embed(F.col("text"), LetterEmbedder))


_CTX = where.Context(now=NOW)


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with conditions, by meaning: the ten nearest documents that meet them, from a score on."""
    return answering.vector_hits(conditional_questions(spark, sf), _embedded(spark, sf), LetterEmbedder, 10, 0.97, ctx=_CTX)


def filtered_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The same by words, with the hits' texts wherever a column holds them."""
    hits = answering.keyword_hits(conditional_questions(spark, sf), _chunks(spark, sf), 10, 0.5, _CTX, scale=40.0)
    blank = lambda n: F.when(F.col("doc_id") % n == 0, "").otherwise(F.col("text"))
    found = hits.join(docs(spark, sf, "text", "lang").select(F.col("doc_id").alias("id"), blank(3).alias("text"), blank(6).alias("content"), "lang"), "id")
    return found.select("qid", "id", "score", "rank", F.md5(answering.hit_text(found)).alias("digest"))


def orchestrated(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions, both searches, fusion, expansion, reranking, previews, prompts and answers for a batch of questions."""
    found = answering.answer(conditional_questions(spark, sf), _embedded(spark, sf), next_edges(spark, sf), _CTX, LetterEmbedder)
    items = F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ",")
    return found.select("qid", F.md5("preview").alias("digest"), "content", items.alias("items"), F.get_json_object("applied_where", "$.media_type").alias("media_type"), "matched_count")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")


def metric_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each metric over six hours."""
    made = monitoring.metric_stats(_points(spark, sf).withColumnRenamed("event_type", "name"), NOW, 6 * 3600, "event_id")
    return made.withColumn("avg", F.round("avg", 6))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("event_id", "ts", F.col("event_type").alias("action"), F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"), (F.col("event_type") != "error").alias("success"))


def audit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A week's audit records by action and user."""
    return monitoring.audit_statistics(_audit(spark, sf), NOW, 7).withColumn("success_rate", F.round("success_rate", 6))


def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last hundred views of a range."""
    found = monitoring.audit_records(_audit(spark, sf), 100, datetime(2024, 1, 10), NOW, order=("ts", "event_id"), action="view")
    return found.select("event_id", "action")


def last_points(spark: SparkSession, sf: str) -> DataFrame:
    """The last twenty points of each metric."""
    return monitoring.keep_last(_points(spark, sf), ["ts", "event_id"], 20, ["event_type"]).select("event_type", "event_id")


def health(spark: SparkSession, sf: str) -> DataFrame:
    """The overall status of components that report how full they are, each day and at three heights of the worst component."""
    day = F.date_format("ts", "yyyy-MM-dd")
    usage = _points(spark, sf).groupBy(day.alias("day"), F.col("event_type").alias("component")).agg(F.round(F.max("value"), 6).alias("p"))
    rows = usage.select("day", "component", "p", F.explode(F.array(*map(F.lit, (75.0, 88.0, 1000.0)))).alias("height"))
    capped = rows.withColumn("status", monitoring.usage_status(F.least("p", "height"), 80, 90))
    return monitoring.overall_status(capped, ["day", "height"])


def session_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last three messages of each conversation."""
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    last = monitoring.keep_last(turns, ["turn"], 3, ["conv_id"])
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")).alias("digest"))


def http_heads(spark: SparkSession, sf: str) -> DataFrame:
    """What a fetch of each page returns at most: 2000 characters."""
    return read_table(spark, sf, "pages", "page_id", "html").select("page_id", F.md5(F.substring("html", 1, 2000)).alias("digest"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users with gaps of six hours."""
    made = streams.sessions(_points(spark, sf), "6 hours")
    return made.select("user_id", F.unix_seconds("start").alias("start_s"), "events")


def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Daily metrics, by a stream over the events."""
    import uuid

    root = f"{shared_dir(spark)}/corpusmill/streams/{uuid.uuid4().hex}"
    schema = _points(spark, sf).schema
    source = streams.read_stream(spark, f"{sf.rstrip('/')}/event[s].parquet", schema)  # a pattern: the source takes folders or patterns
    table = streams.run_to_table(streams.windowed_metrics(source, "1 day"), f"{root}/table", f"{root}/checkpoint", "complete")
    return table.select(F.unix_seconds("start").alias("start_s"), "name", "count", F.round("sum", 4).alias("sum"), "min", "max")


QUERIES = {f.__name__: f for f in (inferred_clauses, vector_search, vector_search_filtered, keyword_search, hybrid_rrf, hybrid_weighted, graph_expansion, contexts, previews, text_search, filtered_keywords, orchestrated, metric_stats, audit_statistics, audit_tail, last_points, health, session_history, http_heads, user_sessions, stream_metrics)}


def _nearest(condition: str = "true") -> str:
    return f"""
  SELECT qid, id, cos, (row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id))::INT AS rank FROM (
    SELECT q.vec_id AS qid, c.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS cos
    FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND {condition}) QUALIFY rank <= 10"""


_VECTOR = f"SELECT qid, id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (cos + 1) / 2)) AS score, rank FROM ({_nearest()})"
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_KEYWORD = f"""
  WITH t AS (SELECT doc_id AS id, {_TERMS.format("text")} AS l FROM documents),
  p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(l) AS term FROM t) GROUP BY ALL),
  s AS (SELECT count(*) AS docs, avg(len(l)) AS mean FROM t),
  q AS (SELECT DISTINCT qid, unnest(l) AS term FROM (SELECT item_id * 100 AS qid, {_TERMS.format("text")} AS l FROM benchmark)),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  w AS (SELECT qid, p.id, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(t.l) / mean)) AS part
        FROM q JOIN p USING (term) JOIN f USING (term) JOIN t ON t.id = p.id, s),
  g AS (SELECT qid, id, round(sum(part), 6) AS score FROM w GROUP BY qid, id)
  SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM g QUALIFY rank <= 10"""
_HITS = f"WITH k AS ({_KEYWORD}), h AS (SELECT k.*, text FROM k JOIN documents ON doc_id = id)"
_AUDIT = "SELECT event_id, ts, event_type AS action, CASE WHEN user_id % 9 <> 0 THEN user_id END AS user_id, event_type <> 'error' AS success FROM events"

_NAMED = "CASE " + " ".join(f"WHEN list_contains(w, '{k}') THEN '{k}'" for k in ("text", "image", "video", "audio", "pdf")) + " WHEN contains(q, '视频') THEN 'video' WHEN contains(q, '图片') THEN 'image' END"

_CLAUSES = rf"""
WITH a AS (SELECT item_id, {list(_ASKS)}[item_id % 5 + 1] || text AS q FROM benchmark),
b AS (SELECT *, {sql_count("q", "[一-鿿]")} AS han, {sql_count("q", r"\p{L}")} AS letters, regexp_extract_all(lower(q), '[a-z_]+') AS w FROM a)
SELECT item_id, CASE WHEN letters = 0 OR han / letters::DOUBLE > 0.3 THEN 'zh' ELSE 'en' END AS lang, {_NAMED} AS media_type,
  CASE item_id % 5 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.6::DOUBLE END AS quality, item_id % 5 = 0 AS recent FROM b"""
_LETTERS = sql_letters("l")
_UNIT = "coalesce(nullif(sqrt(list_dot_product(v, v)), 0), 1)"
_CONDITIONAL = f"""
cl AS (SELECT item_id * 100 AS qid, * FROM ({_CLAUSES})),
qs AS (SELECT qid, q, t, lang, media_type, quality, recent FROM (SELECT item_id * 100 AS qid, {list(_ASKS)}[item_id % 5 + 1] || text AS q, replace(q, chr(10), '') AS t FROM benchmark) JOIN cl USING (qid)),
ds AS (SELECT doc_id AS id, text, lang, ['text', 'image', 'video', 'pdf'][doc_id % 4 + 1] AS media_type, (doc_id % 10) / 10::DOUBLE AS quality, doc_id % 14 <= 7 AS recent FROM documents),
fits AS (SELECT qid, id FROM qs JOIN ds ON qs.lang = ds.lang AND coalesce(qs.media_type = ds.media_type, qs.media_type IS NULL) AND coalesce(ds.quality >= qs.quality, qs.quality IS NULL) AND (NOT qs.recent OR ds.recent)),
qv AS (SELECT qid, v, {_UNIT} AS n FROM (SELECT qid, {_LETTERS} AS v FROM (SELECT qid, lower(t) AS l FROM qs))),
dv AS (SELECT id, v, {_UNIT} AS n FROM (SELECT id, {_LETTERS} AS v FROM (SELECT id, lower(text) AS l FROM ds WHERE length({sql_strip("text")}) > 0))),
vh AS (SELECT qid, id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (cos + 1) / 2)) AS score, rank FROM (
  SELECT qid, id, cos, (row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id))::INT AS rank FROM (
    SELECT qid, id, round(list_dot_product(qv.v, dv.v) / (qv.n * dv.n), 6) AS cos FROM fits JOIN qv USING (qid) JOIN dv USING (id)) QUALIFY rank <= 10)),
tt AS (SELECT id, {_TERMS.format("text")} AS l FROM ds),
pp AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(l) AS term FROM tt) GROUP BY ALL),
ss AS (SELECT count(*) AS docs, avg(len(l)) AS mean FROM tt),
qt AS (SELECT DISTINCT qid, unnest({_TERMS.format("t")}) AS term FROM qs),
ff AS (SELECT term, count(*) AS df FROM pp GROUP BY term),
ww AS (SELECT qt.qid, pp.id, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(tt.l) / mean)) AS part
       FROM qt JOIN pp USING (term) JOIN ff USING (term) JOIN tt ON tt.id = pp.id JOIN fits ON fits.qid = qt.qid AND fits.id = pp.id, ss),
kh AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM (SELECT qid, id, round(sum(part), 6) AS score FROM ww GROUP BY qid, id) QUALIFY rank <= 10)"""
_WORDS = lambda t: f"list_filter(list_distinct(string_split_regex(lower({t}), '{SP}+')), lambda w: w <> '')"

SQL = {
    "inferred_clauses": _CLAUSES,
    "text_search": f"WITH {_CONDITIONAL} SELECT * FROM vh WHERE score >= 0.97::DOUBLE",
    "filtered_keywords": f"""
WITH {_CONDITIONAL} SELECT qid, id, least(1.0::DOUBLE, score / 40) AS score, rank, md5(CASE WHEN id % 6 = 0 THEN '' ELSE text END) AS digest FROM kh JOIN ds USING (id) WHERE score / 40 >= 0.5""",
    "orchestrated": f"""
WITH {_CONDITIONAL},
fu AS (SELECT qid, id FROM (SELECT qid, id, round(coalesce(1 / (60 + vh.rank)::DOUBLE, 0) + coalesce(1 / (60 + kh.rank)::DOUBLE, 0), 9) AS rrf FROM vh FULL JOIN kh USING (qid, id))
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) <= 10),
ed AS ({_EDGES}), bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
ne AS (SELECT DISTINCT qid, dst AS id FROM fu JOIN bo ON fu.id = bo.src WHERE (qid, dst) NOT IN (SELECT (qid, id) FROM fu)),
al AS (SELECT qid, id FROM fu UNION ALL SELECT qid, id FROM (SELECT qid, id FROM ne QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 10)),
re AS (SELECT qid, id, q, coalesce(text, '') AS text, len(list_intersect({_WORDS("q")}, {_WORDS("coalesce(text, '')")})) / len({_WORDS("q")})::DOUBLE AS score FROM al JOIN ds USING (id) JOIN qs USING (qid)),
be AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM re QUALIFY rank <= 10),
ag AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 3) AS preview, string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 6) AS context, string_agg(id::VARCHAR, ',' ORDER BY rank) AS items, count(*) AS n FROM be GROUP BY qid)
SELECT qid, md5(coalesce(preview, '')) AS digest, CASE WHEN coalesce(context, '') = '' THEN 'No relevant content was found.' ELSE md5('Question: ' || q || chr(10) || chr(10) || 'Context:' || chr(10) || context) END AS content,
  coalesce(items, '') AS items, media_type, coalesce(n, 0) AS matched_count FROM qs LEFT JOIN ag USING (qid)""",
    "vector_search": _VECTOR,
    "vector_search_filtered": f"SELECT qid, id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - (2 - 2 * cos) / 2)) AS score, rank FROM ({_nearest('c.label = 1')}) WHERE score >= 0.3",
    "keyword_search": _KEYWORD,
    "hybrid_rrf": f"""
WITH v AS ({_VECTOR}), k AS ({_KEYWORD}),
b AS (SELECT qid, id, coalesce(v.score, k.score) AS score, round(coalesce(1 / (60 + v.rank)::DOUBLE, 0) + coalesce(1 / (60 + k.rank)::DOUBLE, 0), 9) AS rrf FROM v FULL JOIN k USING (qid, id))
SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id))::INT AS rank FROM b QUALIFY rank <= 10""",
    "hybrid_weighted": f"""
WITH v AS ({_VECTOR}), k AS ({_KEYWORD}),
a AS (SELECT qid, id, score * 0.7::DOUBLE AS part FROM v UNION ALL SELECT qid, id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, score)) * 0.3::DOUBLE FROM k),
b AS (SELECT qid, id, round(sum(part), 9) AS score FROM a GROUP BY qid, id)
SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM b QUALIFY rank <= 10""",
    "graph_expansion": f"""
WITH k AS ({_KEYWORD}), e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
n AS (SELECT DISTINCT qid, dst AS id FROM k JOIN b ON k.id = b.src WHERE (qid, dst) NOT IN (SELECT (qid, id) FROM k)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS i FROM n QUALIFY i <= 10),
m AS (SELECT qid, max(rank) AS most FROM k GROUP BY qid)
SELECT qid, id, score, rank FROM k UNION ALL SELECT qid, id, 0.0::DOUBLE, (most + i)::INT FROM r JOIN m USING (qid)""",
    "contexts": _HITS + """,
c AS (SELECT *, length(text) AS cost, sum(length(text)) OVER (PARTITION BY qid ORDER BY rank) AS total FROM h)
SELECT qid, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (total <= 6000), '')) AS digest, coalesce(max(total) FILTER (total <= 6000), 0)::BIGINT AS used_tokens,
  coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (total <= 6000), '') AS from_items, string_agg(id::VARCHAR, ',' ORDER BY rank) AS citations
FROM c WHERE total - cost <= 6000 GROUP BY qid""",
    "previews": _HITS + """
SELECT qid, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS digest, length(string_agg(text, chr(10) || chr(10) ORDER BY rank))::INT AS n FROM h WHERE rank <= 3 GROUP BY qid""",
    "metric_stats": """
SELECT event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, arg_max(value, (ts, event_id)) AS latest
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type""",
    "audit_statistics": f"""
WITH a AS (SELECT * FROM ({_AUDIT}) WHERE ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00')
SELECT 'all' AS kind, NULL AS key, count(*) AS total, round(coalesce(avg(success::INT), 0), 6) AS success_rate FROM a
UNION ALL SELECT 'action', action, count(*), round(avg(success::INT), 6) FROM a GROUP BY action
UNION ALL SELECT 'user', user_id::VARCHAR, count(*), round(avg(success::INT), 6) FROM a WHERE user_id IS NOT NULL GROUP BY user_id""",
    "audit_tail": f"SELECT event_id, action FROM ({_AUDIT}) WHERE action = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100",
    "last_points": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20",
    "health": """
WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(max(value), 6) AS p FROM events GROUP BY ALL), h AS (SELECT day, height::DOUBLE AS height, least(p, height) AS p FROM u, unnest([75, 88, 1000]) AS t(height))
SELECT day, height, CASE WHEN p > 90 THEN 'unhealthy' WHEN p > 80 THEN 'degraded' ELSE 'healthy' END AS status FROM h""",
    "session_history": """
WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM t GROUP BY conv_id""",
    "http_heads": "SELECT page_id, md5(substr(html, 1, 2000)) AS digest FROM pages",
    "user_sessions": """
WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS events FROM s GROUP BY user_id, n""",
    "stream_metrics": """
SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type AS name, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max
FROM events GROUP BY ALL""",
}
