"""Chunking: parameters, windows, paragraphs and sentences, tables, regions and subtitles.

A part is a piece of a document with a place (``ord``) and a chunk type. Tables and regions are made
into parts here, those of other media types by the caller; ``split_parts`` makes chunks of them.
Sizes are in characters.
"""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.config import Chunking
from corpusmill.functions.text import bound, strip

#: Separators in order of preference, and what ends a sentence.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
SENTENCE_END = "[。！？；]"
#: Rows of recognised text that are closer than this, from one to the next, are one region.
REGION_GAP = 20


def chunk_params(media_type: str, n_chars: int, c: Chunking = Chunking()) -> tuple[int, int]:
    """Chunk size and overlap for a content of ``n_chars`` characters.

    With ``auto`` the target size, and an overlap in proportion to it, are limited by what the
    media type's table entry allows; short contents get at most half the entry's overlap.
    """
    size, overlap = dict(c.by_media).get(media_type, c.default)
    if not c.auto:
        return max(50, size), max(0, overlap)
    goal = min(max(200, c.target), max(200, c.max_context // 4))
    wanted = int(goal * c.overlap_ratio)
    if math.floor(n_chars / 1.6) < 1.2 * goal:
        wanted = min(wanted, max(10, overlap // 2))
    limit = lambda x, low, high: min(max(x, low), high)
    goal = limit(goal, max(100, int(0.6 * size)), max(2 * size, int(1.5 * size)))
    return goal, limit(wanted, overlap // 2, max(2 * overlap, int(1.5 * overlap)))


def windows(n: Column, size: Column, overlap: Column) -> Column:
    """Array of (start, end), from 0, of the windows over ``n`` characters.

    Windows start every ``size`` - ``overlap`` characters until one reaches the end; then one more covers the
    last ``overlap`` characters if it starts after the last window's start. A content up to
    ``size`` long that is split all the same gives such a pair as well; an empty one gives none.
    """
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int") * step).cast("int")
    starts = F.sequence(F.lit(0), last, step.cast("int"))
    starts = F.when(n - overlap > last, F.concat(starts, F.array((n - overlap).cast("int")))).otherwise(starts)
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.when(s == n - overlap, n).otherwise(F.least(s + size, n)).cast("int").alias("end")))
    return F.when(n > 0, made).otherwise(F.slice(made, 1, 0))


def split_parts(parts: DataFrame, size: int | Column, overlap: int | Column) -> DataFrame:
    """Chunks of ``parts`` (doc_id, ord, chunk_type, text, ...): the same columns with chunk_index, chunk_size, total_chunks.

    A part up to ``size`` long is one chunk, a longer one is cut into windows; blank parts give none.
    """
    size, overlap = (F.lit(x) if isinstance(x, int) else x for x in (size, overlap))
    n = F.length("text")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    spans = F.when(n <= size, whole).otherwise(windows(n, size, overlap))
    rows = parts.where(F.length(strip(F.col("text"))) > 0).select(*parts.columns, spans.alias("__spans"))
    # Parts are numbered before they are cut: each text moves once, whole.
    doc = Window.partitionBy("doc_id")
    made = F.size("__spans")
    before = F.coalesce(F.sum(made).over(doc.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", before.alias("__before"), F.sum(made).over(doc).alias("total_chunks"))
    rest = [c for c in parts.columns if c != "text"]
    each = rows.select(*rest, "total_chunks", "__before", F.posexplode(cut(F.col("text"), F.col("__spans"))).alias("__at", "text"))
    return each.select(*parts.columns, (F.col("__before") + F.col("__at")).cast("int").alias("chunk_index"), F.length("text").alias("chunk_size"), "total_chunks")


#: Characters of the blocks that long texts are taken apart into before they are cut.
BLOCK = 8192


def cut(text: Column, spans: Column) -> Column:
    """The substrings of ``text`` at ``spans`` (structs of start and end, from 0).

    A character's place in a text is found by counting; so a long text is taken apart into blocks once, and each
    span is cut out of the few that it lies in: work goes with the text's length, not with its square.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(parts: Column, w: Column) -> Column:
        first = F.floor(w["start"] / BLOCK).cast("int")
        many = F.greatest(F.floor((w["end"] - 1) / BLOCK).cast("int") - first + 1, F.lit(1))
        return F.substring(F.array_join(F.slice(parts, first + 1, many), ""), w["start"] - first * BLOCK + 1, w["end"] - w["start"])

    short = F.transform(spans, lambda w: F.substring(text, w["start"] + 1, w["end"] - w["start"]))
    long_ = bound(blocks, lambda parts: F.transform(spans, lambda w: piece(parts, w)))
    return F.when(F.length(text) <= BLOCK, short).otherwise(long_)


def _trim(tail: str) -> str:
    """What follows the first sentence end, or all of it."""
    m = re.search(SENTENCE_END, tail)
    return tail[m.end() :] if m else tail


def _force(text: str, size: int, overlap: int) -> list[str]:
    starts = [0]
    while starts[-1] + size < len(text):
        starts.append(starts[-1] + size - overlap)
    if len(text) - overlap > starts[-1]:
        return [text[s : s + size] for s in starts] + [text[len(text) - overlap :]]
    return [text[s : s + size] for s in starts]


def paragraph_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Paragraphs, long ones by sentences and long sentences by windows, each led by the end of the one before."""
    made: list[str] = []
    for paragraph in (text or "").split("\n\n"):
        paragraph = paragraph.strip()
        if len(paragraph) <= size:
            made += [paragraph] if paragraph else []
            continue
        held = ""
        for piece in re.split(f"({SENTENCE_END})", paragraph):
            if len(held) + len(piece) <= size:
                held += piece
                continue
            made += [held.strip()] if held.strip() else []
            held = piece if len(piece) <= size else ""
            if len(piece) > size:
                made += _force(piece, size, overlap)
        made += [held.strip()] if held.strip() else []
    out = made[:1]
    for before, chunk in zip(made, made[1:], strict=False):
        lead = _trim(before[-overlap:] if overlap else "") if len(before) > overlap else before
        out.append(chunk if not lead or chunk.startswith(lead) else lead + chunk)
    return out


def recursive_chunks(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, parted at the first separator that helps.

    Pieces are joined again while they fit; a chunk starts with the last pieces of the one
    before, up to ``overlap`` characters. A piece that is too long is parted by later separators.
    """
    text = text or ""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, later = separators[at], separators[at + 1 :]
    pieces = re.split(f"(?={re.escape(mark)})", text) if mark else [text[i : i + 1] for i in range(len(text))]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size:
            flush()
            held, length = [], 0
            out += recursive_chunks(piece, size, overlap, later or ("",))
            continue
        if length + len(piece) > size:
            flush()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    flush()
    return out


#: Texts that are cut at once in a worker.
TEXTS = 256


def _release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _chunker(cut, size: int, overlap: int):  # noqa: ANN001, ANN202
    @F.pandas_udf("array<string>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = []
            for at in range(0, len(texts), TEXTS):  # as Arrow, a chunk takes no more than its text
                made.append(pa.array([cut(t, size, overlap) for t in texts.iloc[at : at + TEXTS]], pa.list_(pa.string())))
            yield pd.Series(pa.chunked_array(made, pa.list_(pa.string())), dtype=pd.ArrowDtype(pa.list_(pa.string())))
            del made, texts
            _release()

    return each


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 76, recursive: bool = False) -> DataFrame:
    """Chunks of plain texts: doc_id, chunk_type, chunk_index, text, chunk_size, total_chunks."""
    cut, kind = (recursive_chunks, "text") if recursive else (paragraph_chunks, "text_simple")
    made = docs.select(F.col(id_col).alias("doc_id"), _chunker(cut, size, overlap)(F.col(text_col)).alias("chunks"))
    each = made.select("doc_id", F.lit(kind).alias("chunk_type"), F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text"))
    return each.select("doc_id", "chunk_type", "chunk_index", "text", F.length("text").alias("chunk_size"), "total_chunks")


def _cells(row: Column) -> Column:
    return F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))


def has_header(table: Column) -> Column:
    """Whether a table (array of rows of cells) has two rows or more and a first one of cells under 20 characters on average."""
    first = _cells(F.get(table, F.lit(0)))
    mean = F.aggregate(first, F.lit(0), lambda s, c: s + F.length(c)) / F.size(first)
    return (F.size(table) >= 2) & F.coalesce(mean < 20, F.lit(True))


def table_text(table: Column) -> Column:
    """A table as text: a line for each row, of name 是 cell pairs if it has a header, else of its cells."""
    head = _cells(F.get(table, F.lit(0)))

    def named(row: Column) -> Column:
        pairs = F.transform(head, lambda h, i: F.struct(h.alias("h"), F.coalesce(F.get(_cells(row), i), F.lit("")).alias("c")))
        return F.array_join(F.transform(F.filter(pairs, lambda p: (p["h"] != "") & (p["c"] != "")), lambda p: F.concat(p["h"], F.lit("是"), p["c"])), "，")

    plain = lambda row: F.array_join(F.filter(_cells(row), lambda c: c != ""), " ")
    lines = lambda rows, f: F.array_join(F.filter(F.transform(rows, f), lambda s: s != ""), "\n")
    return F.when(has_header(table), lines(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), named)).otherwise(lines(table, plain))


def table_parts(tables: DataFrame, chunk_type: str, ord_base: int = 1_000_000) -> DataFrame:
    """Parts of tables (doc_id, table_index, data): they come after a document's other parts."""
    return tables.select("doc_id", (F.lit(ord_base) + F.col("table_index")).alias("ord"), F.lit(chunk_type).alias("chunk_type"), table_text(F.col("data")).alias("text"))


def regions(items: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Recognised text items (doc_id, text, confidence, x, y) as parts of type image_region.

    In order of y and x, an item starts a region if it lies REGION_GAP or more from the one before. Each
    region has its bounds: min_x, max_x, min_y, max_y.
    """
    good = items.where(F.col("confidence") >= least_confidence)
    order = Window.partitionBy("doc_id").orderBy("y", "x", "text")
    gap = F.abs(F.col("y") - F.lag("y").over(order)) >= REGION_GAP
    numbered = good.withColumn("ord", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    joined = numbered.groupBy("doc_id", "ord").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"), *(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    return joined.select("doc_id", "ord", F.lit("image_region").alias("chunk_type"), "text", F.col("ord").alias("region_index"), "min_x", "max_x", "min_y", "max_y")


def subtitle_chunks(cues: Column, size: int = 600) -> Column:
    """Subtitle cues (array of text, start_time, end_time) packed in order: array of text, start_time, end_time, chunk_size.

    A cue joins the chunk, after a space, if their lengths fit ``size`` without the space.
    """
    item = "struct<text:string,start_time:double,end_time:double,chunk_size:int>"
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.array().cast(f"array<{item}>").alias("out"))

    def done(a: Column) -> Column:
        made = F.struct(strip(a["text"]).alias("text"), a["start"].alias("start_time"), a["end"].alias("end_time"), F.length(a["text"]).alias("chunk_size"))
        return F.when(a["text"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(made.cast(item))))

    def step(a: Column, c: Column) -> Column:
        text = F.coalesce(c["text"], F.lit(""))
        joins = F.length(a["text"]) + F.length(text) <= size
        empty = a["text"] == ""
        grown = F.when(empty, text).otherwise(F.concat(a["text"], F.lit(" "), text))
        start = F.when(joins & ~empty, a["start"]).otherwise(c["start_time"].cast("double"))
        return F.struct(F.when(joins, grown).otherwise(text).alias("text"), start.alias("start"), c["end_time"].cast("double").alias("end"), F.when(joins, a["out"]).otherwise(done(a)).alias("out"))

    return F.aggregate(cues, zero, step, done)
