"""Queries over the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import STOPWORDS
from corpusmill.functions import keywords, scoring, text
from corpusmill.functions.markdown import markdown_plain
from corpusmill.operators import segment
from corpusmill.operators.dedup import keep_first
from corpusmill.sources.files import media_type, srt_cues
from corpusmill.sources.tables import materialise, read_table

#: White space in RE2, and the same statements for SQL.
SP = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARKS = "".join(f"\\x{{{ord(c):x}}}" for c in text.VALID_MARKS)


def sql_count(column: str, pattern: str) -> str:
    """Number of matches, in SQL."""
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def sql_strip(column: str) -> str:
    """Without white space at either end, in SQL."""
    return f"regexp_replace(regexp_replace({column}, '^{SP}+', ''), '{SP}+$', '')"


def sql_clean(column: str) -> str:
    """``text.clean`` in SQL."""
    a = rf"regexp_replace({column}, '\r\n?', chr(10), 'g')"
    b = rf"regexp_replace({a}, '[ \t]+', ' ', 'g')"
    return sql_strip(rf"regexp_replace({b}, '\n{SP}*\n{SP}*\n+', chr(10) || chr(10), 'g')")


def sql_normalize(column: str) -> str:
    """``text.normalize`` in SQL, for texts that composition doesn't change."""
    kept = rf"regexp_replace({column}, '[\x00-\x08\x0b-\x1f\x7f-\xa0\xad\x{{1680}}\x{{2000}}-\x{{200f}}\x{{2028}}-\x{{202f}}\x{{205f}}-\x{{2064}}\x{{3000}}\x{{feff}}]', '', 'g')"
    return sql_strip(f"regexp_replace({kept}, '{SP}+', ' ', 'g')")


def sql_garbled(t: str) -> str:
    """``text.garbled_ratio`` in SQL."""
    return rf"CASE WHEN length({t}) = 0 THEN 1.0 ELSE ({sql_count(t, r'[\p{C}\p{Z}]')} - {sql_count(t, r'[ \n\t]')}) / length({t})::DOUBLE END"


def sql_valid(t: str) -> str:
    """``text.valid_ratio`` in SQL."""
    marks = MARKS.replace("'", "''")
    return rf"CASE WHEN length({t}) = 0 THEN 0.0 ELSE {sql_count(t, rf'[\p{{L}}\p{{N}}{SP[1:-1]}{marks}]')} / length({t})::DOUBLE END"


def sql_quality(t: str) -> str:
    """``text.quality_score`` in SQL."""
    size = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (length({t}) - 20) / 180.0::DOUBLE))"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.4::DOUBLE * (1 - ({sql_garbled(t)})) + 0.2::DOUBLE * ({sql_valid(t)}) + 0.2::DOUBLE * {size}) / 0.8::DOUBLE))"


def sql_letters(lowered: str) -> str:
    """How often each of the letters a to z occurs in a lower-cased text, in SQL."""
    return f"list_transform(range(97, 123), lambda i: (length({lowered}) - length(replace({lowered}, chr(i::INT), '')))::DOUBLE)"


LINES = "(SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
_SQL_GRAMS = "list_transform(range(1, greatest(length(line) - 1, 1)), lambda i: substr(line, i, 3))"


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of ``documents``."""
    return read_table(spark, sf, "documents", "doc_id", *columns)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document: doc_id, line_no, line."""
    return docs(spark, sf, "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def corpus_quality_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, normalise and score all documents; rows, distinct ids and mean quality of each language."""
    judged = text.bound(text.clean(F.col("text")), lambda t: F.struct(t.alias("t"), text.quality_score(t).alias("q")))
    # Exploding an array is where the optimiser stops copying an expression into each of its uses.
    good = docs(spark, sf, "text", "lang").select("lang", F.inline(F.filter(F.array(judged), lambda x: x["q"] >= 0.6)))
    scored = good.select("lang", text.chunk_id(text.normalize(F.col("t"))).alias("id"), "q")
    return scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.round(F.avg("q"), 6).alias("mean_quality"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts."""
    return docs(spark, sf, "text").select("doc_id", text.clean(F.col("text")).alias("text"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Content-addressed ids."""
    return docs(spark, sf, "text").select("doc_id", text.chunk_id(text.normalize(F.col("text"))).alias("id"), F.md5("text").alias("md5"))


def query_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's texts as queries."""
    return read_table(spark, sf, "benchmark", "item_id", "text").select("item_id", text.clean_query(F.concat(F.lit(" “"), "text", F.lit("”\n（x）！"))).alias("query"))


def character_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Gibberish, garbled, valid and repetition ratios of every line."""
    r = lambda c: F.round(c(F.col("line")), 9)
    return lines(spark, sf).select("doc_id", "line_no", r(text.gibberish_ratio).alias("gibberish"), r(text.garbled_ratio).alias("garbled"), r(text.valid_ratio).alias("valid"), r(text.character_repetition).alias("char_repetition"), r(text.ngram_repetition).alias("ngram_repetition"))


def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The quality score, its length part and the token estimate of every document."""
    t = F.col("text")
    return docs(spark, sf, "text").select("doc_id", F.round(text.quality_score(t), 9).alias("quality"), F.round(text.length_score(F.length(t)), 9).alias("length_score"), text.estimated_tokens(t).alias("tokens"))


def low_quality_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth, by hash, of the documents below a quality of 0.95: the sampled log, over more rows than its own settings (0.6, a hundredth) would give here."""
    scored = docs(spark, sf, "text").withColumn("quality", F.round(text.quality_score(F.col("text")), 9)).where("quality < 0.95")
    slot = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long") % 10
    return scored.where(slot == 0).select("doc_id", "quality")


def languages(spark: SparkSession, sf: str) -> DataFrame:
    """Detected language and the share of Han characters, of whole texts, with a Chinese sentence repeated ahead of every third."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("这是一个测试"), 40), F.col("text"))).otherwise(F.col("text"))
    return docs(spark, sf, "text").select("doc_id", text.detect_language(t).alias("lang"), F.round(text.chinese_ratio(t), 9).alias("han"))


def address_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents hold web addresses, phone numbers, mail addresses or blacklisted words."""
    t = F.col("text")
    like = lambda p: F.regexp_like(t, F.lit(p))
    return docs(spark, sf, "text").select("doc_id", like(text.URL).alias("url"), like(text.PHONE).alias("phone"), like(text.EMAIL).alias("email"), text.has_address(t).alias("any"), text.contains_any(t, ["Scum", "free", ""]).alias("blacklisted"))


def caption_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that pass the caption filter."""
    return lines(spark, sf).withColumn("line", F.trim("line")).where(text.keeps_caption(F.col("line"), 5, 120)).select("doc_id", "line_no")


def collapsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a repeated segment, and what is left of them."""
    made = lines(spark, sf).withColumn("collapsed", text.collapse_repeats(F.col("line")))
    return made.select("doc_id", "line_no", "collapsed")


def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal lines of the corpus, the first."""
    some = lines(spark, sf).where(F.length(F.trim("line")) > 0).select("doc_id", "line_no", F.md5("line").alias("digest"))
    return keep_first(some, ["digest"], ["doc_id", "line_no"])


def keyphrases(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent terms of every document."""
    return keywords.keyphrases(docs(spark, sf, "text").withColumn("lang", F.lit("en")), "doc_id", "text", "lang")


def keyphrase_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's keyphrases by the method that its language calls for."""
    found = keywords.phrases(F.col("text"), F.lit("en"))
    return docs(spark, sf, "text").select("doc_id", F.array_join(found, ",").alias("keyphrases"))


def markdown_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Each document within Markdown of its own, as plain text by its structure."""
    k = F.col("doc_id").cast("string")
    made = F.concat(F.lit("# Title *of* "), k, F.lit("\n\nSome **bold** and `code "), k, F.lit("` with [a link](http://h/"), k, F.lit(").\n> quoted\n\n- one\n- two\n\n```\n"), F.col("text"), F.lit("\n```\n"))
    return docs(spark, sf, "text").select("doc_id", F.md5(markdown_plain(made)).alias("digest"))


def cohesive_words(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of up to three letters that stand together more often than by chance: the candidates of a segmenter's words."""
    found = segment.runs(docs(spark, sf, "text").withColumn("text", F.lower("text")), "text", "[a-z]+")
    counts = materialise(segment.substrings(found, 3).where((F.col("n") >= 20) | (F.length("word") == 1)), "substrings")
    return segment.cohesive(counts, 4.0)


def text_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The ten terms of highest rank of every document."""
    found = keywords.text_rank(keywords.terms(F.col("text"), F.lit("en")))
    return docs(spark, sf, "text").select("doc_id", F.array_join(found, ",").alias("keyphrases"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dressed as Markdown, as plain text again."""
    t = F.concat(F.lit("# Title\n\n**"), F.regexp_replace("text", "[*_`#!\\[\\]()]", ""), F.lit("** and _it_ [a link](http://x) ![alt](u)\n```\ncode\n```\n`end`"))
    return docs(spark, sf, "text").select("doc_id", text.markdown_text(t).alias("text"))


def subtitles(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as SRT, parsed again."""
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    time = lambda n: F.format_string("00:%02d:%02d,500", F.floor(n / 60).cast("long") % 60, n.cast("long") % 60)
    body = F.regexp_replace(F.trim("text"), r"\s+", " ")
    block = F.concat(F.col("turn").cast("string"), F.lit("\n"), time(F.col("turn") * 7), F.lit(" --> "), time(F.col("turn") * 7 + 5), F.lit("\n"), body)
    files = turns.where(F.length(body) > 0).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("srt"))
    return srt_cues(files, "conv_id", "srt").withColumnRenamed("id", "conv_id")


def media_types(spark: SparkSession, sf: str) -> DataFrame:
    """Media types of invented file names and content types."""
    kinds = F.array(*map(F.lit, ("a.PDF", "b.docx", "c.csv", "d.md", "e.png", "f.mp4", "g", "h.txt", "i.wav", "j.xls")))
    types = F.array(*map(F.lit, ("", "text/plain", "image/png", "application/pdf", "text/csv", "audio/x", "application/msword")))
    made = docs(spark, sf).select("doc_id", F.get(kinds, (F.col("doc_id") % 10).cast("int")).alias("filename"), F.get(types, (F.col("doc_id") % 7).cast("int")).alias("content_type"))
    return made.select("doc_id", media_type(F.col("filename"), F.col("content_type")).alias("media_type"))


def distance_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from distances, for every metric."""
    v = F.col("value") / 100
    rows = read_table(spark, sf, "events", "event_id", "value")
    return rows.select("event_id", *(F.round(scoring.score_from_distance(v, m), 9).alias(m) for m in ("cosine_distance", "cosine_similarity", "l2", "inner_product", "other")))


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings scaled and brought to length 1 again: the length and first component."""
    v = scoring.l2_normalized(F.transform("embedding", lambda x: x * 3))
    rows = read_table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(F.sqrt(scoring.dot(F.col("v"), F.col("v"))), 6).alias("length"), F.round(F.get("v", F.lit(0)), 5).alias("first"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORD = r"[^\p{L}\p{N}\p{M}\p{Pc}]+"
_PHONE, _EMAIL, _URL = text.PHONE, text.EMAIL, text.URL
_ADDRESS = lambda c: f"(regexp_matches({c}, '{_URL}') OR regexp_matches({c}, '{_PHONE}') OR regexp_matches({c}, '{_EMAIL}'))"
_GIBBERISH = lambda c: rf"CASE WHEN length({c}) = 0 THEN 1.0 ELSE 1 - {sql_count(c, rf'[\p{{L}}\p{{N}}{SP[1:-1]}]')} / length({c})::DOUBLE END"
_NGRAM = "CASE WHEN length(line) < 3 THEN 0.0 ELSE (length(line) - 2 - len(list_distinct(" + _SQL_GRAMS + "))) / (length(line) - 2)::DOUBLE END"

_SEP = f"[{text.SEPARATORS}]"


def sql_collapse(t: str) -> str:
    """``text.collapse_repeats`` in SQL."""
    last = f"regexp_replace(p, '{_SEP}$', '')"
    split = f"list_transform(regexp_extract_all({t}, '[^{_SEP[1:-1]}]+{_SEP}?|{_SEP}'), lambda p: {{'s': {sql_strip(last)}, 'm': regexp_extract(p, '{_SEP}$')}})"
    full = f"list_filter({split}, lambda x: length(x.s) > 0)"
    kept = f"list_transform(list_filter({full}, lambda x, i: i = 1 OR ({full})[i - 1].s <> x.s), lambda x: x.s || x.m)"
    return f"coalesce(nullif(array_to_string({kept}, ''), ''), {t})"


_QUERY = f"regexp_replace(translate(replace(' “' || text || '”（x）！', chr(10), ''), '“”（）！', chr(34) || chr(34) || '()!'), '{SP}+', ' ', 'g')"

#: The lines that ``dedup.clean_items`` keeps, in SQL.
CLEANED = f"""
SELECT doc_id, line_no, md5(line) AS digest FROM (
  SELECT doc_id, line_no, before, {sql_collapse("before")} AS line FROM (SELECT doc_id, line_no, {sql_clean("line")} AS before FROM {LINES}))
WHERE before <> '' AND length(line) BETWEEN 5 AND 10000 AND NOT {_ADDRESS("line")} AND {_GIBBERISH("line")} <= 0.3 AND {_NGRAM} <= 0.5
QUALIFY row_number() OVER (PARTITION BY doc_id, md5(line) ORDER BY line_no) = 1"""

QUERIES = {f.__name__: f for f in (corpus_quality_by_lang, clean_text, chunk_ids, query_cleaning, character_ratios, quality_scores, low_quality_sample, languages, address_flags, caption_filter, collapsed_lines, first_lines, keyphrases, keyphrase_lists, cohesive_words, markdown_structure, text_rank, markdown, subtitles, media_types, distance_scores, unit_vectors)}

_KEYPHRASES = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{_WORD}'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS l FROM documents WHERE length({sql_strip("text")}) >= 20),
e AS (SELECT doc_id, i, l[i] AS term FROM w, unnest(range(1, len(l) + 1)) AS u(i)),
c AS (SELECT doc_id AS id, term, count(*) AS n, min(i) AS first FROM e GROUP BY ALL)
SELECT id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, first)::INT AS rank FROM c QUALIFY rank <= 10"""

SQL = {
    "corpus_quality_by_lang": f"""
WITH c AS (SELECT lang, {sql_clean("text")} AS t FROM documents),
s AS (SELECT lang, substr(sha1({sql_normalize("t")}), 1, 16) AS id, {sql_quality("t")} AS q FROM c)
SELECT lang, count(*) AS n, count(DISTINCT id) AS n_ids, round(avg(q), 6) AS mean_quality FROM s WHERE q >= 0.6 GROUP BY lang""",
    "clean_text": f"SELECT doc_id, {sql_clean('text')} AS text FROM documents",
    "chunk_ids": f"SELECT doc_id, substr(sha1({sql_normalize('text')}), 1, 16) AS id, md5(text) AS md5 FROM documents",
    "query_cleaning": f"SELECT item_id, {sql_strip(_QUERY)} AS query FROM benchmark",
    "character_ratios": f"""
SELECT doc_id, line_no, round({_GIBBERISH("line")}, 9) AS gibberish, round({sql_garbled("line")}, 9) AS garbled, round({sql_valid("line")}, 9) AS valid,
  round(CASE WHEN length(line) = 0 THEN 0.0 ELSE 1 - len(list_distinct(string_split(line, ''))) / length(line)::DOUBLE END, 9) AS char_repetition,
  round({_NGRAM}, 9) AS ngram_repetition FROM {LINES}""",
    "quality_scores": f"""
SELECT doc_id, round({sql_quality("text")}, 9) AS quality, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (length(text) - 20) / 180.0::DOUBLE)), 9) AS length_score,
  floor(length(text) / 1.6::DOUBLE)::BIGINT AS tokens FROM documents""",
    "low_quality_sample": f"""
SELECT doc_id, quality FROM (SELECT doc_id, text, round({sql_quality("text")}, 9) AS quality FROM documents)
WHERE quality < 0.95 AND ('0x' || substr(md5(text), 1, 6))::BIGINT % 10 = 0""",
    "languages": rf"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('这是一个测试', 40) || text ELSE text END AS t FROM documents),
r AS (SELECT doc_id, length({sql_strip("t")}) AS n, {sql_count("t", r"[\x{4e00}-\x{9fff}]")} AS han, {sql_count("t", r"\p{L}")} AS letters FROM t)
SELECT doc_id, CASE WHEN n < 10 OR letters = 0 THEN 'zh' WHEN han / letters::DOUBLE > 0.3 THEN 'zh' ELSE 'en' END AS lang,
  round(CASE WHEN letters > 0 THEN han / letters::DOUBLE END, 9) AS han FROM r""",
    "address_flags": f"""
SELECT doc_id, regexp_matches(text, '{_URL}') AS url, regexp_matches(text, '{_PHONE}') AS phone, regexp_matches(text, '{_EMAIL}') AS email,
  {_ADDRESS("text")} AS any, contains(lower(text), 'scum') OR contains(lower(text), 'free') AS blacklisted FROM documents""",
    "caption_filter": f"""
SELECT doc_id, line_no FROM (SELECT doc_id, line_no, trim(line, ' ') AS line FROM {LINES})
WHERE length(line) BETWEEN 5 AND 120 AND NOT {_ADDRESS("line")} AND {_GIBBERISH("line")} <= 0.3 AND {_NGRAM} <= 0.5""",
    "collapsed_lines": f"SELECT doc_id, line_no, {sql_collapse('line')} AS collapsed FROM {LINES}",
    "first_lines": f"""
SELECT doc_id, line_no, md5(line) AS digest FROM {LINES} WHERE length(trim(line, ' ')) > 0
QUALIFY row_number() OVER (PARTITION BY md5(line) ORDER BY doc_id, line_no) = 1""",
    "keyphrases": _KEYPHRASES,
    "markdown_structure": """
SELECT doc_id, md5(array_to_string(['Title ', 'of', ' ' || doc_id, '', 'Some ', 'bold', ' and ', 'code ' || doc_id, ' with ', 'a link', '.', '', 'quoted', '', 'one', '', 'two', '', text || chr(10)], chr(10))) AS digest FROM documents""",
    "cohesive_words": """
WITH r AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM documents) GROUP BY run),
c AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT substr(run, i, m) AS word, n FROM (SELECT run, n, m, unnest(range(1, len(run) - m + 2)) AS i FROM r, (VALUES (1), (2), (3)) AS s(m))) GROUP BY word),
k AS MATERIALIZED (SELECT * FROM c WHERE n >= 20 OR len(word) = 1),
l AS (SELECT sum(n)::BIGINT AS letters FROM k WHERE len(word) = 1),
p AS (SELECT word, n, unnest(range(1, len(word))) AS i FROM k WHERE len(word) > 1)
SELECT p.word, p.n FROM p JOIN k AS a ON a.word = substr(p.word, 1, i) JOIN k AS b ON b.word = substr(p.word, i + 1), l
GROUP BY p.word, p.n HAVING min(p.n::DOUBLE * letters / a.n / b.n) >= 4""",
    "keyphrase_lists": f"SELECT doc_id, coalesce(string_agg(term, ',' ORDER BY rank), '') AS keyphrases FROM documents LEFT JOIN ({_KEYPHRASES}) ON doc_id = id GROUP BY doc_id",
    "markdown": r"""
SELECT doc_id, 'Title' || chr(10) || chr(10) || regexp_replace(regexp_replace(text, '[*_`#!\[\]()]', '', 'g'), '(?m)^[ ]+#', '#', 'g') || ' and it a link !alt' || chr(10) || chr(10) || chr(10) || 'end' AS text FROM documents""",
    "subtitles": r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(trim(text, ' '), '[\t-\r ]+', ' ', 'g') AS body FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, body) - 1)::INT AS ord, ((turn * 7) // 60 % 60 * 60 + (turn * 7) % 60 + 0.5)::DOUBLE AS start_time,
  ((turn * 7 + 5) // 60 % 60 * 60 + (turn * 7 + 5) % 60 + 0.5)::DOUBLE AS end_time, body AS text FROM t WHERE length(body) > 0""",
    "media_types": """
WITH f AS (SELECT doc_id, ['a.PDF', 'b.docx', 'c.csv', 'd.md', 'e.png', 'f.mp4', 'g', 'h.txt', 'i.wav', 'j.xls'][doc_id % 10 + 1] AS f,
  ['', 'text/plain', 'image/png', 'application/pdf', 'text/csv', 'audio/x', 'application/msword'][doc_id % 7 + 1] AS c FROM documents)
SELECT doc_id, CASE c WHEN 'image/png' THEN 'image' WHEN 'audio/x' THEN 'audio' WHEN 'application/pdf' THEN 'pdf' WHEN 'application/msword' THEN 'word' WHEN 'text/csv' THEN 'excel'
  WHEN 'text/plain' THEN CASE f WHEN 'd.md' THEN 'markdown' WHEN 'c.csv' THEN 'excel' ELSE 'text' END
  ELSE CASE f WHEN 'a.PDF' THEN 'pdf' WHEN 'b.docx' THEN 'word' WHEN 'c.csv' THEN 'excel' WHEN 'd.md' THEN 'markdown' WHEN 'e.png' THEN 'image' WHEN 'f.mp4' THEN 'video' WHEN 'i.wav' THEN 'audio' WHEN 'j.xls' THEN 'excel' ELSE 'text' END END AS media_type FROM f""",
    "distance_scores": """
SELECT event_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - v / 2)), 9) AS cosine_distance, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v + 1) / 2)), 9) AS cosine_similarity,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, exp(-v))), 9) AS l2, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, v)), 9) AS inner_product, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - v)), 9) AS other
FROM (SELECT event_id, value / 100 AS v FROM events)""",
    "unit_vectors": """
SELECT vec_id, 1.0::DOUBLE AS length, round((v[1] * 3)::DOUBLE / (3 * sqrt(list_dot_product(v, v))), 5) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
}
