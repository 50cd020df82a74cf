"""Markdown to plain text by its structure: containers and leaves of a text, then what stands inside each leaf.

``parts`` walks a text as CommonMark reads it and returns what it shows, piece by piece: runs of text, code as it
stands, and an empty piece after each heading and paragraph. Marks, link targets and HTML are left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))??(?:(?:^|[ \t]+)#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])( +|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_TAG = r"(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)"
#: Names of elements that begin a block of HTML.
_BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
#: Beginnings of blocks of HTML, and their ends (None: a blank line); the last can't interrupt a paragraph.
_HTML = tuple((re.compile(a, re.I), b and re.compile(b, re.I)) for a, b in ((r" {0,3}<(?:script|pre|style|textarea)(?=\s|>|$)", r"</(?:script|pre|style|textarea)>"), (r" {0,3}<!--", "-->"), (r" {0,3}<\?", r"\?>"), (r" {0,3}<![A-Z]", ">"), (r" {0,3}<!\[CDATA\[", r"\]\]>"), (rf" {{0,3}}</?(?:{_BLOCK_TAGS})(?=\s|/?>|$)", None), (rf" {{0,3}}{_TAG}\s*$", None)))
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)*\S(?:[^\[\]\\]|\\.)*)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]*(?<=\s)(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
_TARGET = re.compile(r"\(\s*(?:<(?:[^<>\n\\]|\\.)*>|(?:[^\s()<\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*)?(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S)
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_INLINE_HTML = re.compile(rf"{_TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Containers within each other, beyond which marks are text.
DEEPEST = 64
_ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _begins(line: str, beside: bool = False) -> bool:
    """Whether a block begins with a line that could go on with a paragraph; some items do only ``beside`` the paragraph's container."""
    if _FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or any(a.match(line) for a, _ in _HTML[:-1]):
        return True
    item = _ITEM.match(line)
    return bool(item) and (beside or (item[3] in (None, "1") and line[item.end() :].strip() != ""))


class _Inner:
    """The lines of a container while they are gathered, and whether a paragraph is open at their end."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.fence: str | None = None
        self.open = False

    def add(self, line: str, lazy: bool = False) -> None:
        self.lines.append(line)
        if lazy:
            return  # it went on with the paragraph, which stays open
        bare = line
        while m := _QUOTE.match(bare) or (not _RULE.match(bare) and _ITEM.match(bare)):
            bare = bare[m.end() :]
        fence = _FENCE.match(bare)
        if self.fence:
            self.fence = None if bare.strip().startswith(self.fence) and not bare.strip(" " + self.fence[0]) else self.fence
            self.open = False
        elif fence:
            self.fence, self.open = fence[1], False
        else:
            self.open = bool(bare.strip()) and not _begins(bare) and (self.open or not bare.startswith("    "))

    def goes_on(self, line: str) -> bool:
        """Whether ``line``, outside of the container's marks, goes on with that paragraph."""
        return self.open and bool(line.strip()) and not _begins(line, beside=True)


def _leaves(lines: list[str], known: dict[str, bool], depth: int = 0) -> Iterator[tuple[str, str]]:
    """The leaves (kind, content) of a container's lines, in order; labels of link definitions go to ``known``."""
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        start = i
        if not line.strip():
            i += 1
        elif line.startswith("    "):
            while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                i += 1
            yield "code", "\n".join(x[4:] for x in lines[start:i]).rstrip("\n ") + "\n"
        elif m := _FENCE.match(line):
            mark, deep = m[1], len(line) - len(line.lstrip(" "))
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            i = next((j for j in range(i + 1, n) if end.match(lines[j])), n)
            yield "code", "".join(re.sub(f"^ {{0,{deep}}}", "", x) + "\n" for x in lines[start + 1 : i])
            i += 1
        elif m := _HEADING.match(line):
            yield "heading", (m[1] or "").strip()
            i += 1
        elif _RULE.match(line):
            i += 1
        elif depth < DEEPEST and _QUOTE.match(line):
            inner = _Inner()
            while i < n and ((m := _QUOTE.match(lines[i])) or inner.goes_on(lines[i])):
                inner.add(lines[i][m.end() :] if m else lines[i], lazy=not m)
                i += 1
            yield from _leaves(inner.lines, known, depth + 1)
        elif m := _ITEM.match(line):
            bare = not line[m.end() :].strip()
            wide = len(m[1]) + len(m[2]) + (1 if bare or len(m[4]) > 4 else len(m[4]))
            inner = _Inner()
            inner.add(line[wide:])
            i += 1
            while i < n and ((own := not lines[i][:wide].strip()) or inner.goes_on(lines[i])):
                if bare and len(inner.lines) == 1 and not lines[i].strip():
                    break
                if own and lines[i].strip() and not lines[i].startswith(" " * wide):
                    break
                inner.add(lines[i][wide:] if own else lines[i], lazy=not own)
                i += 1
            yield from _leaves(inner.lines, known, depth + 1)
        elif ends := next(((b,) for a, b in _HTML if a.match(line)), None):
            while i < n and not (ends[0].search(lines[i]) if ends[0] else not lines[i].strip()):
                i += 1
            i += 1
        else:
            kind, i = "paragraph", i + 1
            while i < n and lines[i].strip() and not (kind := "heading" if _UNDERLINE.match(lines[i]) else kind) == "heading" and (lines[i].startswith("    ") or not _begins(lines[i])):
                i += 1
            text = "\n".join(x.strip(" \t") if j == i - 1 else x.lstrip(" \t") for j, x in enumerate(lines[start:i], start))
            while m := _DEFINITION.match(text):
                known[_label(m[1])] = True
                text = text[m.end() :]
            i += kind == "heading" and bool(text)
            if text:
                yield kind, text


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _is_mark(c: str) -> bool:
    return c in _ASCII_MARKS or unicodedata.category(c)[0] in "PS"


class _Run:
    """A run of * or _: how many are left, and what others made of it."""

    def __init__(self, char: str, count: int, opens: bool, closes: bool):
        self.char, self.count, self.left, self.opens, self.closes = char, count, count, opens, closes
        self.before: list[str | None] = []  # what closing emphasis leaves before the rest, and opening emphasis after it
        self.after: list[str | None] = []


def _emphasise(tokens: list) -> None:
    """Pair the runs among ``tokens``."""
    runs = [t for t in tokens if isinstance(t, _Run)]
    open_: list[_Run] = []
    for run in runs:
        while run.closes and run.left:
            fits = lambda o: o.char == run.char and o.left and not ((o.closes or run.opens) and (o.count + run.count) % 3 == 0 and (o.count % 3 or run.count % 3))  # noqa: B023, E731
            at = next((k for k in range(len(open_) - 1, -1, -1) if fits(open_[k])), None)
            if at is None:
                break
            used = 2 if open_[at].left > 1 and run.left > 1 else 1
            open_[at].left -= used
            run.left -= used
            # Strong emphasis leaves an empty text outside its marks.
            open_[at].after[:0] = ["", None] if used == 2 else [None]
            run.before += [None, ""] if used == 2 else [None]
            del open_[at + 1 :]
            if not open_[at].left:
                open_.pop()
        if run.opens and run.left:
            open_.append(run)


def _texts(text: str, known: dict[str, bool]) -> list[str]:
    """The runs of text and the code inside a leaf."""
    tokens: list = []  # strings, None where a text ends, ("code", text), _Run, and ["[", position, active] where a link may begin
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and (text[i + 1] in _ASCII_MARKS or text[i + 1] == "\n"):
            tokens.append(text[i + 1] if text[i + 1] != "\n" else None)
            i += 2
        elif c == "`":
            run = re.compile("`+").match(text, i)[0]
            end = re.compile(rf"(?<!`){run}(?!`)").search(text, i + len(run))
            if end:
                code = text[i + len(run) : end.start()].replace("\n", " ")
                tokens.append(("code", code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code))
            else:
                tokens.append(run)
            i = end.end() if end else i + len(run)
        elif c == "<" and (m := _AUTO.match(text, i)):
            tokens += [None, m[1], None]
            i = m.end()
        elif c == "<" and (m := _INLINE_HTML.match(text, i)):
            tokens.append(None)
            i = m.end()
        elif c == "&" and (m := _ENTITY.match(text, i)):
            tokens.append(html.unescape(m[0]))
            i = m.end()
        elif c in "*_":
            j = re.compile(re.escape(c) + "+").match(text, i).end()
            a, b = text[i - 1] if i else " ", text[j] if j < n else " "
            left = not b.isspace() and (not _is_mark(b) or a.isspace() or _is_mark(a))
            right = not a.isspace() and (not _is_mark(a) or b.isspace() or _is_mark(b))
            word = c == "_"
            tokens.append(_Run(c, j - i, left and (not word or not right or _is_mark(a)), right and (not word or not left or _is_mark(b))))
            i = j
        elif c == "[" or (c == "!" and text[i + 1 : i + 2] == "["):
            mark = "[" if c == "[" else "!["
            i += len(mark)
            tokens.append([mark, i, True])
        elif c == "]":
            i += 1
            at = next((k for k in range(len(tokens) - 1, -1, -1) if isinstance(tokens[k], list)), None)
            if at is None:
                tokens.append("]")
                continue
            mark, start, active = tokens[at]
            m = _TARGET.match(text, i) if active else None
            if active and not m:
                m = _LABEL.match(text, i)
                inner = text[start : i - 1]
                label = m[1] if m and m[1].strip() else inner
                if _label(label) not in known:
                    m = None if m and m[1].strip() or _label(inner) not in known else re.compile("").match(text, i)
                elif not m:
                    m = re.compile("").match(text, i)
            if not m:
                tokens[at] = mark
                tokens.append("]")
                continue
            inside = tokens[at + 1 :]
            _emphasise(inside)
            tokens[at:] = [None, *_flat(inside), None]
            if mark == "[":  # no link within a link
                for t in tokens:
                    if isinstance(t, list) and t[0] == "[":
                        t[2] = False
            i = m.end()
        elif c == "\n":
            if tokens and isinstance(tokens[-1], str):
                tokens[-1] = tokens[-1].rstrip(" ")
            tokens.append(None)
            i += 1
        else:
            j = re.compile(r"[\\`<&*_\[\]!\n]").search(text, i + 1)
            tokens.append(text[i : j.start() if j else n])
            i = j.start() if j else n
    _emphasise(tokens)
    out: list[str] = []
    held: list[str] | None = None
    for t in [*_flat(tokens), None]:
        if isinstance(t, str):
            held = [*(held or []), t]
            continue
        if held is not None:
            out.append("".join(held))
        held = None
        if t is not None and t[1]:
            out.append(t[1])
    return out


def _flat(tokens: list) -> Iterator:
    """Tokens with what became of runs and of brackets that began no link."""
    for t in tokens:
        if isinstance(t, _Run):
            yield from t.before
            if t.left:
                yield t.char * t.left
            yield from t.after
        else:
            yield t[0] if isinstance(t, list) else t


def parts(text: str) -> list[str]:
    """The pieces of a Markdown text."""
    lines = [re.sub(r"^[ \t]*", lambda m: m[0].expandtabs(4), x) for x in re.split(r"\r\n?|\n", text.replace("\0", "�"))]
    known: dict[str, bool] = {}
    out: list[str] = []
    for kind, content in list(_leaves(lines, known)):
        if kind == "code":
            out += [content] if content else []
        else:
            out += [*_texts(content, known), ""]
    return out


def markdown_plain(text: Column) -> Column:
    """Markdown as plain text by its structure, pieces parted by line breaks; null for null."""

    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else "\n".join(parts(t)))

    return each(text)
