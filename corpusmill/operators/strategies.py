"""Chunking by media type: from the elements of documents of any kind to chunks, in one plan.

An element is a piece that an extractor yields: a page, paragraph, table, recognised region,
caption, cue, transcript or plain text. Each document is cut by its own size and overlap.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusmill.config import Chunking
from corpusmill.operators.chunking import recursive_chunks, split_parts, subtitle_chunks, table_text
from corpusmill.sources.tables import materialise

#: Chunk types of the elements that are cut into windows, by media type and kind of element.
WINDOWED = {("pdf", "page"): "pdf_page", ("pdf", "table"): "pdf_table", ("word", "paragraph"): "word_paragraph", ("word", "table"): "word_table", ("excel", "table"): "excel_sheet", ("image", "region"): "image_region", ("image", "caption"): "image_caption"}
#: Chunk types of running text, by media type; any other is plain text.
RUNNING = {"video": "video_transcript", "audio": "audio_transcript"}
#: Tables come after a document's other elements.
AFTER = 1_000_000
_OUT = ("doc_id", "chunk_type", "chunk_index", "text", "chunk_size", "total_chunks")


def chunk_params_of(media_type: Column, n_chars: Column, c: Chunking = Chunking()) -> tuple[Column, Column]:
    """``chunking.chunk_params`` of columns: chunk size and overlap of each document."""
    pick = lambda i: reduce(lambda when, e: when.when(media_type == e[0], e[1][i]), c.by_media, F.when(F.lit(False), 0)).otherwise(c.default[i])
    size, overlap = pick(0), pick(1)
    if not c.auto:
        return F.greatest(F.lit(50), size).cast("int"), F.greatest(F.lit(0), overlap).cast("int")
    goal = min(max(200, c.target), max(200, c.max_context // 4))
    wanted = int(goal * c.overlap_ratio)
    half = F.floor(overlap / 2)
    short = F.floor(n_chars / 1.6) < 1.2 * goal
    wanted = F.when(short, F.least(F.lit(wanted), F.greatest(F.lit(10), half))).otherwise(wanted)
    limit = lambda x, low, high: F.least(F.greatest(x, low), high)
    best = limit(F.lit(goal), F.greatest(F.lit(100), F.floor(size * 0.6)), F.greatest(2 * size, F.floor(size * 1.5)))
    return best.cast("int"), limit(wanted, half, F.greatest(2 * overlap, F.floor(overlap * 1.5))).cast("int")


@F.pandas_udf(ArrayType(StringType()))
def _recursive(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([recursive_chunks(t, s, o) for t, s, o in zip(text, size, overlap, strict=True)])


def _numbered(chunks: DataFrame, made: str) -> DataFrame:
    """A row for each element of the array column ``made`` (structs of text, chunk_size)."""
    each = chunks.select("doc_id", "chunk_type", F.size(made).alias("total_chunks"), F.posexplode(made).alias("chunk_index", "c"))
    return each.select("doc_id", "chunk_type", "chunk_index", F.col("c.text").alias("text"), F.col("c.chunk_size").alias("chunk_size"), "total_chunks")


def chunk_elements(elements: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Chunks of the elements (doc_id, media_type, kind, ord, text, data, start_time, end_time) of all documents.

    Returns doc_id, chunk_type, chunk_index, text, chunk_size, total_chunks. ``data`` (rows of cells)
    is a table's, times are a cue's. Pages, paragraphs, tables, regions and captions are cut into
    windows, tables last; an image's captions are joined by spaces, and its pieces of a longer text are
    of a type ending in _part. A video is cut by its cues if it has any. Everything else, and all of an
    unknown media type, is running text and cut at separators. Blank elements give no chunk.
    """
    media = F.lower("media_type")
    known = reduce(lambda when, e: when.when((media == e[0][0]) & (F.col("kind") == e[0][1]), e[1]), WINDOWED.items(), F.when(F.lit(False), ""))
    text = F.when(F.col("kind") == "table", table_text(F.col("data"))).otherwise(F.coalesce("text", F.lit("")))
    rows = elements.select("doc_id", media.alias("media"), "kind", F.when(F.col("kind") == "table", AFTER + F.col("ord")).otherwise(F.col("ord")).alias("ord"), text.alias("text"), "start_time", "end_time", known.alias("chunk_type"))
    rows = materialise(rows, "elements")  # all branches below read it: what made the elements runs once
    whole = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"), F.max((F.col("media") == "video") & (F.col("kind") == "cue")).alias("cued"))
    size, overlap = chunk_params_of(F.col("media"), F.col("n_chars"), c)
    rows = rows.join(whole, "doc_id").select(*rows.columns, "cued", size.alias("size"), overlap.alias("overlap"))

    joined = ["doc_id", "media", "chunk_type", "size", "overlap"]
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    captions = rows.where("chunk_type = 'image_caption'").groupBy(*joined).agg(F.min("ord").alias("ord"), in_order.alias("text"))
    parts = rows.where("chunk_type <> 'image_caption'").select(*joined, "ord", "text").unionByName(captions.withColumn("ord", F.col("ord") + AFTER))
    longer = (F.col("media") == "image") & (F.length("text") > F.col("size"))
    parts = parts.withColumn("chunk_type", F.when(longer, F.concat("chunk_type", F.lit("_part"))).otherwise(F.col("chunk_type")))
    windowed = split_parts(parts, F.col("size"), F.col("overlap")).select(*_OUT)

    cue = F.struct("ord", "text", "start_time", "end_time")
    cues = rows.where("chunk_type IS NULL AND cued AND kind = 'cue'").groupBy("doc_id", "size").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    packed = _numbered(cues.select("doc_id", F.lit("video_subtitle").alias("chunk_type"), subtitle_chunks(F.col("cues"), F.col("size")).alias("made")), "made")

    running = rows.where("chunk_type IS NULL AND NOT cued")
    kind = reduce(lambda when, e: when.when(F.col("media") == e[0], e[1]), RUNNING.items(), F.when(F.lit(False), "")).otherwise("text")
    running = running.groupBy("doc_id", "media", "size", "overlap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    cut = running.select("doc_id", kind.alias("chunk_type"), _recursive("text", "size", "overlap").alias("cut"))
    made = F.transform("cut", lambda t: F.struct(t.alias("text"), F.length(t).alias("chunk_size")))
    return windowed.unionByName(packed).unionByName(_numbered(cut.select("doc_id", "chunk_type", made.alias("made")), "made"))
