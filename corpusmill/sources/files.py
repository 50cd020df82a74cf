"""File sources: listing, acceptance, media types, and extraction of text and tables.

``scan_files`` gives one row for each file; an extractor turns the rows of one media type into
rows of parts. Extraction runs in Arrow batches on the executors; a file that can't be read
gives a row with an ``error`` instead of ending the job.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from corpusmill.config import EXTENSIONS
from corpusmill.functions.text import markdown_text, srt_seconds, strip

#: Content types of office files.
WORD_TYPES = ("application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
EXCEL_TYPES = ("application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "text/csv")


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The files under ``path``: filename, length, content.

    A file's name is its path below ``path``, so that files of one name in different folders stay apart; below a pattern
    it is the whole path, and a single file's is its base name.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    full, base = F.col("path"), F.regexp_extract("path", r"([^/]+)\z", 1)
    name = F.when(full == root, base).when(F.startswith(full, F.lit(root.rstrip("/") + "/")), F.substring(full, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(full)
    return files.select(name.alias("filename"), "length", "content")


def extension(filename: Column) -> Column:
    """The part from the last dot on, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)\z", 1))


def classify(files: DataFrame, order: str, supported: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of ``files`` (filename, content_type, ...).

    Of accepted rows with the same name and content type, compared without case, the first by
    ``order`` stays. Rejected rows get a ``reason``.
    """
    ext = extension(F.coalesce("filename", F.lit("")))
    known = files.withColumn("__ext", ext)
    key = [F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("content_type", F.lit("")))]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    good = known.where(F.col("__ext").isin(*supported)).withColumn("__nth", nth).where("__nth = 1").drop("__nth", "__ext")
    bad = known.where(~F.col("__ext").isin(*supported))
    reason = F.concat(F.lit("unsupported extension: '"), F.when(F.col("__ext") == "", "N/A").otherwise(F.col("__ext")), F.lit("'"))
    return good, bad.withColumn("reason", reason).drop("__ext")


def require_accepted(accepted: DataFrame, supported: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``accepted`` itself; ValueError if it has no row."""
    if accepted.isEmpty():
        raise ValueError(f"no supported file; supported are {', '.join(supported)}")
    return accepted


def media_type(filename: Column, content_type: Column) -> Column:
    """image, video, audio, pdf, word, excel, markdown or text; content types come before extensions."""
    ct, ext = F.lower(F.coalesce(content_type, F.lit(""))), extension(filename)
    by_ext = F.when(ext.isin(".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"), "image").when(ext.isin(".mp4", ".avi", ".mov", ".mkv"), "video").when(ext.isin(".mp3", ".wav", ".flac"), "audio")
    by_ext = by_ext.when(ext == ".pdf", "pdf").when(ext.isin(".doc", ".docx"), "word").when(ext.isin(".xls", ".xlsx", ".csv"), "excel").when(ext == ".md", "markdown").otherwise("text")
    found = F.when(ct.startswith("image/"), "image").when(ct.startswith("video/"), "video").when(ct.startswith("audio/"), "audio").when(ct == "application/pdf", "pdf")
    found = found.when(ct.isin(*WORD_TYPES), "word").when(ct.isin(*EXCEL_TYPES), "excel")
    text = F.when(ext == ".md", "markdown").when(ext == ".csv", "excel").otherwise("text")
    return found.when(ct.startswith("text/"), text).otherwise(by_ext)


def _first_that_decodes(content: bytes, *encodings: str) -> str:
    for name in encodings:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


@F.pandas_udf(StringType())
def _decode(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: None if b is None else _first_that_decodes(b, "utf-8", "gb18030"))


def decode_text(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, which stays in the JVM, else GB 18030, else Latin-1."""
    valid = F.is_valid_utf8(content)
    return F.coalesce(F.when(valid, content.cast("string")), _decode(F.when(~valid, content)))


def csv_rows(content: bytes) -> list[list[str]]:
    """The rows of a CSV file without those of blank cells only."""
    rows = csv.reader(io.StringIO(_first_that_decodes(content, "utf-8-sig", "gbk"), newline=""))
    return [r for r in rows if any(c.strip() for c in r)]


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    number = 0
    for c in reference:
        if not c.isalpha():
            break
        number = number * 26 + ord(c.upper()) - 64
    return number - 1


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Name and rows of each sheet of a workbook; rows of blank cells only are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = targets.get(sheet.get(f"{_OFFICE}id"), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            rows = []
            for row in ElementTree.fromstring(book.read(path)).iter(f"{_SHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{_SHEET}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_SHEET}v")
                    raw = value.text or "" if value is not None else ""
                    cells[at] = shared[int(raw)] if c.get("t") == "s" and raw else text(c) if c.get("t") == "inlineStr" else raw
                rows.append(cells)
            width = max(map(len, rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in rows if any(x.strip() for x in r)]
            out.append((sheet.get("name", ""), rows))
        return out


def docx_content(content: bytes) -> tuple[list[tuple[str, int | None]], list[list[list[str]]]]:
    """Non-empty paragraphs (text, heading level) and tables of a word document."""
    with zipfile.ZipFile(io.BytesIO(content)) as doc:
        body = ElementTree.fromstring(doc.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    paragraphs, tables = [], []
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}p" and (found := text(e).strip()):
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = (style.get(f"{_WORD}val") or "").lower() if style is not None else ""
            digits = name.removeprefix("heading").strip()
            paragraphs.append((found, int(digits) if name.startswith("heading") and digits.isdigit() else None))
        elif e.tag == f"{_WORD}tbl":
            tables.append([[text(c).strip() for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")])
    return paragraphs, tables


def _sheets(name: str, content: bytes) -> Iterator[dict]:
    sheets = [("Sheet1", csv_rows(content))] if name.lower().endswith(".csv") else xlsx_sheets(content)
    for i, (sheet, rows) in enumerate(sheets, 1):
        yield {"kind": "table", "ord": i, "name": sheet, "data": rows}


def _document(name: str, content: bytes) -> Iterator[dict]:
    paragraphs, tables = docx_content(content)
    for i, (text, level) in enumerate(paragraphs, 1):
        yield {"kind": "paragraph", "ord": i, "text": text, "level": level}
    for i, rows in enumerate(tables, 1):
        yield {"kind": "table", "ord": i, "data": rows}


def _pdf(name: str, content: bytes) -> Iterator[dict]:
    import fitz  # an optional library; without it each file's row says so

    with fitz.open(stream=content, filetype="pdf") as doc:
        for i, page in enumerate(doc, 1):
            yield {"kind": "page", "ord": i, "text": page.get_text()}
        for i, (level, title, page) in enumerate(doc.get_toc(), 1):
            yield {"kind": "toc", "ord": i, "text": title, "level": level, "name": str(page)}


def _text(name: str, content: bytes) -> Iterator[dict]:
    yield {"kind": "text", "ord": 1, "text": _first_that_decodes(content, "utf-8", "gb18030")}


#: Extractors by media type; ``register`` adds others, such as models for images and sound.
EXTRACTORS: dict[str, Callable[[str, bytes], Iterator[dict]]] = {"excel": _sheets, "word": _document, "pdf": _pdf, "text": _text, "markdown": _text}
#: Media types whose files give an error without an extractor; those of any other type are read as text.
MODELLED = ("image", "video", "audio")
#: Parts, and bytes of the files that they come from, of one batch of results, about.
PART_ROWS, PART_BYTES = 1024, 4 << 20
_FIELDS = ("kind", "ord", "name", "text", "level", "data", "start_time", "end_time", "error")
_SCHEMA = "filename string, kind string, ord int, name string, text string, level int, data array<array<string>>, start_time double, end_time double, error string"


def register(kind: str, extractor: Callable[[str, bytes], Iterator[dict]]) -> None:
    """Use ``extractor`` for files of media type ``kind``: it yields dicts of the fields of a part."""
    EXTRACTORS[kind] = extractor


def _parts(extractors: dict[str, Callable], media: str, name: str, content: bytes | None) -> list[dict]:
    """The parts of one file; a row with an error if it can't be read."""
    extractor = extractors.get(media) or (None if media in MODELLED else _text)
    if extractor is None:
        return [{"error": f"no extractor for {media}"}]
    try:
        return list(extractor(name or "", bytes(content or b"")))
    except Exception as e:  # one bad file doesn't end the job
        return [{"error": f"{type(e).__name__}: {e}"[:500]}]


def _part_batches(batches: Iterator[pa.RecordBatch], extractors: dict[str, Callable], schema: StructType) -> Iterator[pa.RecordBatch]:
    """The parts of files (media_type, filename, content), those of many small files in one batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target, rows, held = to_arrow_schema(schema), [], 0
    for batch in batches:
        for scalars in zip(*map(batch.column, ("media_type", "filename", "content")), strict=True):
            media, name, content = (s.as_py() for s in scalars)
            for part in _parts(extractors, media, name, content):
                rows.append({"media_type": media, "filename": name} | {k: part.get(k) for k in _FIELDS})
            held += len(content or b"")
            if len(rows) >= PART_ROWS or held >= PART_BYTES:
                yield pa.RecordBatch.from_pylist(rows, target)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, target)


def extract(files: DataFrame, kind: str | None = None, markdown: Callable[[Column], Column] = markdown_text) -> DataFrame:
    """The parts of files (filename, content): pages, paragraphs, tables and what else an extractor yields.

    All files are of media type ``kind`` or, without it, each of that in its column ``media_type`` (null is text), in one
    scan; the result then has that column too. Text and Markdown are one part each, Markdown as plain text by
    ``markdown`` (patterns, or ``functions.markdown.markdown_plain``, which reads its structure); files of an
    unknown type are read as text, and those that a missing model would read give a row with an ``error``.
    """
    media = F.lower(F.coalesce("media_type", F.lit("text"))) if kind is None else F.lit(kind)
    extractors = dict(EXTRACTORS)  # what is registered now goes along to the executors

    schema = StructType.fromDDL(f"media_type string, {_SCHEMA}")
    parts = files.select(media.alias("media_type"), "filename", "content").mapInArrow(lambda batches: _part_batches(batches, extractors, schema), schema)
    plain = F.when((F.col("media_type") == "markdown") & (F.col("kind") == "text"), markdown(F.col("text"))).otherwise(F.col("text"))
    parts = parts.withColumn("text", plain)
    return parts if kind is None else parts.drop("media_type")


def elements(parts: DataFrame) -> DataFrame:
    """Parts (from ``extract`` without a kind) as the elements that ``operators.strategies`` cuts; the file name, empty if null, is the document's id.

    Outlines and errors are no elements.
    """
    rows = parts.where("error IS NULL AND kind <> 'toc'")
    return rows.select(F.coalesce("filename", F.lit("")).alias("doc_id"), "media_type", "kind", "ord", "text", "data", "start_time", "end_time")


def upload_items(accepted: DataFrame, dataset: str | None = None, source: str = "manual_upload") -> DataFrame:
    """Accepted files (filename, content_type, content) as raw samples: with media_type, source and dataset.

    A missing content type becomes application/octet-stream after the media type was told by the name.
    """
    media = media_type(F.coalesce("filename", F.lit("")), F.col("content_type"))
    kind = F.coalesce(F.when(F.col("content_type") != "", F.col("content_type")), F.lit("application/octet-stream"))
    return accepted.select("filename", kind.alias("content_type"), "content", media.alias("media_type"), F.lit(source).alias("source"), F.lit(dataset).cast("string").alias("dataset"))


def srt_cues(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The cues of SRT texts: id, ord, start_time, end_time, text.

    Blocks are parted by blank lines; one of under three lines or without an arrow in the second is
    no cue.
    """
    text = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    each = files.select(F.col(id_col).alias("id"), F.posexplode(F.split(strip(text), r"\n[ \t]*\n\s*")).alias("ord", "block"))
    lines = F.split(strip(F.col("block")), "\n")
    cues = each.withColumn("lines", lines).where((F.size("lines") >= 3) & F.contains(F.get("lines", F.lit(1)), F.lit("-->")))
    times = F.split(F.get("lines", F.lit(1)), "-->")
    at = lambda i: srt_seconds(strip(F.get(times, F.lit(i))))
    return cues.select("id", "ord", at(0).alias("start_time"), at(1).alias("end_time"), F.array_join(F.slice("lines", 3, F.size("lines") - 2), "\n").alias("text"))
