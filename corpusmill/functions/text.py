"""Text functions as Column expressions.

Character classes are those of Unicode: white space is ``SPACE`` (Java's own classes hold ASCII
only), letters and digits are the general categories L and N, and what isn't printable
is the categories C and Z but for the plain space.
"""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.config import Quality

#: White space, as characters, inside a class, and as a class that rules out most letters by two comparisons.
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CLASS = rf"[[^\x21-\x7e\xa1-\x{{167f}}]&&[{SPACE}]]"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Patterns of addresses that a text must not hold, and marks that count as valid.
URL, PHONE, EMAIL = r"(?i)https?://|www\\.", r"(\+?\d[\d\- ]{7,}\d)", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
VALID_MARKS = ",.;:!?，。；：！？()（）[]{}-_"
SEPARATORS = "，,。.；;！!？?、"
#: Marks and what they become in a query.
QUERY_MARKS = ("“”‘’—–－（），。：；！？【】《》", "\"\"''---(),.:;!?[]<>")


def _n(text: Column, pattern: str) -> Column:
    """Number of matches of ``pattern``."""
    return F.regexp_count(text, F.lit(pattern))


def _n_of(text: Column, kind: str) -> Column:
    """Number of characters of a class (its inside) that most characters belong to: what is left without all others."""
    return F.length(F.regexp_replace(text, f"[[^0-9A-Za-z ]&&[^{kind}]]+", ""))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def clean(text: Column) -> Column:
    """Line ends as LF, runs of spaces and tabs as one space, of blank lines as one; stripped. Null stays null."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, rf"\n{SPACE_CLASS}*\n{SPACE_CLASS}*\n+", "\n\n"))


#: Texts that are composed at once in a worker.
TEXTS = 256


def _composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility compositions of texts, null for those that it doesn't change; a batch is held as Arrow, and freed memory is given back."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for texts in batches:
        made = []
        for at in range(0, len(texts), TEXTS):
            part = (s.as_py() for s in texts.slice(at, TEXTS))
            made.append(pa.array([None if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in part], pa.string()))
        yield pa.concat_arrays(made) if made else pa.array([], pa.string())
        del made, texts
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)


@F.arrow_udf(StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _composed(batches)


def nfkc(text: Column) -> Column:
    """Compatibility composition; of ASCII texts, which it doesn't change, Python gets a null instead, and gives one for all others that it doesn't change."""
    other = F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)
    return F.coalesce(_nfkc(other), text)


def drop_unprintable(text: Column, keep: str = "") -> Column:
    """Without characters that aren't printable, except the space and those of ``keep`` (a regex class's inside)."""
    return F.regexp_replace(text, rf"[[\p{{C}}\p{{Z}}]&&[^ {keep}]]", "")


def collapse_spaces(text: Column) -> Column:
    """Each run of white space as one space; stripped."""
    return strip(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """The form whose hash identifies a chunk: composed, printable, single spaces."""
    return collapse_spaces(drop_unprintable(nfkc(text) if compose else text, r"\n\t"))


def clean_query(text: Column, compose: bool = True) -> Column:
    """A query: composed, printable (line breaks and tabs vanish), plain punctuation, single spaces."""
    t = drop_unprintable(nfkc(text) if compose else text)
    return collapse_spaces(F.translate(t, *QUERY_MARKS))


def chunk_id(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of a normalised text."""
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16)


def document_chunk_id(text: Column, doc_id: Column, filename: Column) -> Column:
    """The id of a chunk that names its document too: the document's id, or else file name, a colon, and ``chunk_id`` of the normalised text."""
    filled = lambda c: F.when(c != "", c)
    return F.concat(F.coalesce(filled(doc_id), filename, F.lit("")), F.lit(":"), chunk_id(normalize(text)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: a one-element array gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def characters(text: Column) -> Column:
    """The text's characters; empty for an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def ngram_repetition(text: Column, n: int = 3) -> Column:
    """Share of character n-grams that repeat an earlier one; 0 for texts shorter than n."""
    count = F.length(text) - n + 1
    grams = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))  # one pass, a match at each place
    return F.when(F.length(text) < n, F.lit(0.0)).otherwise((count - F.size(F.array_distinct(grams))) / count)


def character_repetition(text: Column) -> Column:
    """One minus the share of distinct characters; 0 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(characters(text))) / F.length(text))


def gibberish_ratio(text: Column) -> Column:
    """Share of characters that are no letters, digits or white space; 1 for an empty text."""
    good = _n_of(text, rf"\p{{L}}\p{{N}}{SPACE}")
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(1 - good / F.length(text))


def has_address(text: Column) -> Column:
    """Whether the text holds a web address, phone number or mail address."""
    return reduce(Column.__or__, (F.regexp_like(text, F.lit(p)) for p in (URL, PHONE, EMAIL)))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of ``words``, lower-cased; empty words don't count."""
    lower = F.lower(text)
    return reduce(Column.__or__, (F.contains(lower, F.lit(w.lower())) for w in words if w), F.lit(False))


def valid_ratio(text: Column) -> Column:
    """Share of letters, digits, white space and common marks; 0 for an empty text."""
    marks = "".join(f"\\x{{{ord(c):x}}}" for c in VALID_MARKS)
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(_n_of(text, rf"\p{{L}}\p{{N}}{SPACE}{marks}") / F.length(text))


def garbled_ratio(text: Column) -> Column:
    """Share of characters that aren't printable, without LF and tab; 1 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(_n(text, r"[[\p{C}\p{Z}]&&[^ \n\t]]") / F.length(text))


def length_score(n: Column, low: int = 20, high: int = 200) -> Column:
    """0 up to ``low``, 1 from ``high`` on, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - low) / float(high - low)))


def quality_score(text: Column, ocr: Column | None = None, q: Quality = Quality()) -> Column:
    """Weighted mean of the parts, in [0, 1]; ``ocr`` (a confidence, may be null) counts where given."""
    total = q.garbled * (1 - garbled_ratio(text)) + q.valid * valid_ratio(text) + q.length * length_score(F.length(text), q.min_len, q.sat_len)
    weight = F.lit(q.garbled + q.valid + q.length)
    if ocr is not None:
        total, weight = total + F.coalesce(q.ocr * ocr, F.lit(0.0)), weight + F.when(ocr.isNull(), 0.0).otherwise(q.ocr)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / weight))


def chinese_ratio(text: Column) -> Column:
    """Han characters among letters; null without letters."""
    return F.try_divide(_n(text, CJK).cast("double"), F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("double"))


def detect_language(text: Column, threshold: float = 0.3, least: int = 10, default: str = "zh") -> Column:
    """zh or en by the share of Han characters; ``default`` for under ``least`` characters or no letters."""
    short = F.length(strip(text)) < least
    ratio = chinese_ratio(text)
    return F.when(short | ratio.isNull(), default).when(ratio > threshold, "zh").otherwise("en")


def collapse_repeats(text: Column, separators: str = SEPARATORS) -> Column:
    """Drop segments equal to the last one kept, with the separator that ends them.

    Segments are trimmed and empty ones go with their separator; if nothing is left the
    text stays as it is.
    """
    marks = "".join(f"\\x{{{ord(c):x}}}" for c in separators)
    parts = F.regexp_extract_all(text, F.lit(rf"([^{marks}]*)([{marks}]|\z)"), F.lit(0))
    split = F.transform(parts, lambda p: F.struct(strip(F.regexp_replace(p, rf"[{marks}]\z", "")).alias("s"), F.regexp_extract(p, rf"[{marks}]\z", 0).alias("m")))
    full = F.filter(split, lambda p: F.length(p["s"]) > 0)
    # An equal segment directly after a dropped one equals the kept one too: comparing with the one before is enough.
    kept = lambda x: F.filter(x, lambda p, i: (i == 0) | (F.get(x, i - 1)["s"] != p["s"]))
    joined = bound(full, lambda x: F.array_join(F.transform(kept(x), lambda p: F.concat(p["s"], p["m"])), ""))
    return bound(joined, lambda j: F.when(j == "", text).otherwise(j))


def keeps_caption(text: Column, low: int = 5, high: int = 10000, blacklist: tuple[str, ...] = (), gibberish: float = 0.3, n: int = 3, repetition: float = 0.5) -> Column:
    """Whether a caption passes the length, blacklist, gibberish and n-gram filters, cheap ones first."""
    size = F.length(text)
    good = (size >= low) & (size <= high) & ~has_address(text) & (gibberish_ratio(text) <= gibberish)
    if blacklist:
        good = good & ~contains_any(text, list(blacklist))
    return good & (ngram_repetition(text, n) <= repetition) if n > 0 else good


class _Counted(dict):
    """1 for characters that are letters, digits or white space, else 0."""

    def __missing__(self, c: str) -> int:
        self[c] = made = int(unicodedata.category(c)[0] in "LN" or c in SPACES)
        return made


@cache
def _rules() -> tuple:
    """The patterns of ``clean``, ``collapse_repeats`` and ``keeps_caption`` for Python, as Java reads them; and counted characters."""
    space = f"[{re.escape(SPACES)}]"
    url = URL.removeprefix("(?i)")[:-1] + r"[^\n\r\x85\u2028\u2029]"  # what a point stands for in Java
    phone = PHONE.replace(r"\+?", "")  # the same texts hold it, and it begins with a digit
    # Each with what it can't do without, which is looked for first.
    address = (("://", re.compile(url, re.A | re.I)), ("\\", re.compile(url, re.A | re.I)), ("", re.compile(phone, re.A)), ("@", re.compile(EMAIL, re.A)))
    return re.compile(rf"\n{space}*\n{space}*\n+"), re.compile(f"([{re.escape(SEPARATORS)}])"), address, _Counted()


def judged_caption(text: str | None, strict: bool = False, low: int = 5, high: int = 10000, gibberish: float = 0.3, n: int = 3, repetition: float = 0.5) -> tuple[str, bool, bool]:
    """A text cleaned and without repeated segments, whether it isn't empty once cleaned, and whether it stays.

    The same as ``clean``, ``collapse_repeats`` and ``keeps_caption`` one after the other (``strict``: and collapsing changes nothing), by a
    tenth of their work: for texts in very great numbers.
    """
    blank, marks, address, counted = _rules()
    t = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[ \t]+", " ", t) if "  " in t or "\t" in t else t
    before = blank.sub("\n\n", t).strip(SPACES)
    parts, made, last = marks.split(before), [], None
    if len(parts) > 1:
        for at in range(0, len(parts), 2):
            segment = parts[at].strip(SPACES)
            if segment and segment != last:
                made += (segment, *parts[at + 1 : at + 2])
            last = segment or last
        fixed = "".join(made) or before
    else:
        fixed = before
    size = len(fixed)
    keep = bool(before) and low <= size <= high and (not strict or fixed == before) and not any(sign in fixed and p.search(fixed) for sign, p in address)
    if keep:
        rest = re.sub("[0-9A-Za-z ]+", "", fixed)
        keep = 1 - (size - len(rest) + sum(map(counted.__getitem__, rest))) / size <= gibberish
    if keep and 0 < n <= size:
        grams = size - n + 1
        # Most texts hold enough different ones in their first two thirds.
        keep = any((grams - len(set(zip(*(fixed[i : i + some] for i in range(n)))))) / grams <= repetition for some in (grams * 2 // 3, grams))
    return fixed, bool(before), keep


#: What the marks of Markdown become, in this order.
MARKDOWN = (
    (r"```[\s\S]*?```", "\n"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^\s*#+\s*", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
)


def markdown_text(text: Column) -> Column:
    """Markdown as plain text, rule by rule; the rule for links comes before the one for images."""
    return reduce(lambda t, s: F.regexp_replace(t, *s), MARKDOWN, text)


def estimated_tokens(text: Column) -> Column:
    """Characters over 1.6, rounded down."""
    return F.floor(F.length(text) / 1.6)


def srt_seconds(time: Column) -> Column:
    """Seconds of an SRT time (hours:minutes:seconds,milliseconds); 0 if malformed."""
    parts = F.split(F.regexp_replace(time, ",", "."), ":")
    at = lambda i: strip(F.get(parts, F.lit(i))).try_cast("double")
    return F.when(F.size(parts) == 3, F.coalesce(at(0) * 3600 + at(1) * 60 + at(2), F.lit(0.0))).otherwise(F.lit(0.0))
