"""Predicates on metadata: inferred from a query, compiled to Columns or rendered as filter strings.

A predicate is a dict. A field maps to a value (equality) or to operators ($eq $ne $gt $gte
$lt $lte $in $contains); $and and $or map to lists of predicates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.config import LANG_ALIASES, MEDIA_KEYWORDS, MEDIA_TYPES, METADATA_FIELDS, STOPWORDS
from corpusmill.functions.text import CJK, chinese_ratio

Where = dict[str, Any]
_HAN = re.compile(r"[一-鿿]+")
#: How a query asks for a least quality; both patterns mean at least.
AT_LEAST = (r"(?:质量|quality)\s*(?:>=|大于等于|至少)\s*([0-9.]+)", r"(?:质量|quality)\s*(?:>|大于)\s*([0-9.]+)")
_COMPARE: dict[str, tuple[str, Callable[[Column, Any], Column]]] = {
    "$eq": ("=", lambda c, v: c == v),
    "$ne": ("!=", lambda c, v: c != v),
    "$gt": (">", lambda c, v: c > v),
    "$gte": (">=", lambda c, v: c >= v),
    "$lt": ("<", lambda c, v: c < v),
    "$lte": ("<=", lambda c, v: c <= v),
}


def expand_aliases(aliases: dict[str, str]) -> dict[str, str]:
    """One lower-cased entry for each of the comma-separated names in a key."""
    return {name.strip().lower(): value for names, value in aliases.items() for name in names.split(",") if name.strip()}


@dataclass(frozen=True)
class Context:
    """What the parsers of queries know."""

    fields: tuple[str, ...] = tuple(name for name, _ in METADATA_FIELDS)
    lang_aliases: dict[str, str] = field(default_factory=lambda: expand_aliases(LANG_ALIASES))
    media_keywords: dict[str, str] = field(default_factory=lambda: expand_aliases(MEDIA_KEYWORDS))
    media_types: frozenset[str] = frozenset(MEDIA_TYPES)
    chinese_threshold: float = 0.3
    fallback_lang: str = "zh"
    stopwords: tuple[str, ...] = STOPWORDS
    now: datetime | None = None


def match_alias(query: str, aliases: dict[str, str]) -> str | None:
    """The value of the alias that the query names.

    ASCII aliases are named by an equal run of letters and underscores, and the first of them in
    their own order counts. Else it is an alias within a run of Han characters: of the earliest
    such run the first in order.
    """
    words = frozenset(re.findall(r"[a-z_]+", query.lower()))
    plain = [a for a in aliases if a.isascii() and a.lower() in words]
    if plain:
        return aliases[plain[0]]
    runs = [m.start() for m in _HAN.finditer(query)]
    held = [(bisect_right(runs, query.find(a)), n, a) for n, a in enumerate(aliases) if _HAN.fullmatch(a) and a in query]
    return aliases[min(held)[2]] if held else None


def alias_value(query: Column, aliases: dict[str, str]) -> Column:
    """``match_alias`` of a column of queries."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z_]+"), F.lit(0))
    runs = F.regexp_extract_all(query, F.lit(CJK + "+"), F.lit(0))
    plain = [F.when(F.array_contains(words, a.lower()), v) for a, v in aliases.items() if a.isascii()]
    within = lambda run: F.coalesce(*(F.when(F.contains(run, F.lit(a)), v) for a, v in aliases.items() if _HAN.fullmatch(a)), F.lit(None).cast("string"))
    return F.coalesce(*plain, F.get(F.filter(F.transform(runs, within), lambda v: v.isNotNull()), F.lit(0)))


def infer_lang(query: str, ctx: Context) -> str:
    """zh if over the threshold of the letters are Han, the fallback without letters, else en."""
    letters = sum(c.isalpha() for c in query)
    if not letters:
        return ctx.fallback_lang
    return "zh" if sum(map(len, _HAN.findall(query))) / letters > ctx.chinese_threshold else "en"


def query_terms(query: str, lang: str, k: int, stopwords: tuple[str, ...] = STOPWORDS) -> list[str]:
    """The query's most frequent terms, by the rules of ``functions.keywords.terms``."""
    words = [w for w in re.split(r"\W+", query.lower()) if len(w) > 2] if lang == "en" else [w for w in query.split() if len(w) > 1]
    count: dict[str, int] = {}
    for w in words:
        if w not in stopwords:
            count[w] = count.get(w, 0) + 1
    return sorted(count, key=lambda w: -count[w])[: max(1, k)]


def _lang(query: str, ctx: Context) -> Where | None:
    return {"lang": {"$eq": infer_lang(query, ctx)}}


def _media(query: str, ctx: Context) -> Where | None:
    found = match_alias(query, ctx.media_keywords)
    return {"media_type": {"$eq": found}} if found in ctx.media_types else None


def _quality(query: str, ctx: Context) -> Where | None:
    found = [m[1] for p in AT_LEAST if (m := re.search(p, query, re.I))]
    if any(n.count(".") > 1 or n == "." for n in found[:1]):
        return None  # not a number
    values = [float(n) for n in found if n.count(".") < 2 and n != "."]
    return next(({"quality_score": {"$gte": v}} for v in values if 0 <= v <= 1), None)


def _created(query: str, ctx: Context) -> Where | None:
    days = 7 if "近一周" in query else 30 if "近一月" in query or "近一个月" in query else None
    if days is None or ctx.now is None:
        return None
    return {"created_at": {"$gte": (ctx.now - timedelta(days=days)).isoformat()}}


def _terms(name: str) -> Callable[[str, Context], Where | None]:
    def parse(query: str, ctx: Context) -> Where | None:
        found = query_terms(query, infer_lang(query, ctx), 3, ctx.stopwords)
        return {name: {"$in": found}} if found else None

    return parse


class Registry:
    """Parsers of query text, by metadata field."""

    def __init__(self, parsers: dict[str, Callable[[str, Context], Where | None]] | None = None):
        self.parsers = dict(parsers or {})

    def register(self, name: str, parser: Callable[[str, Context], Where | None]) -> None:
        """Use ``parser`` for field ``name``."""
        self.parsers[name] = parser

    def parse(self, name: str, query: str, ctx: Context) -> Where | None:
        """The clause for field ``name``; none if it isn't among the context's fields or has no parser."""
        parser = self.parsers.get(name)
        return parser(query, ctx) if parser and name in ctx.fields else None


def clause_columns(query: Column, ctx: Context) -> dict[str, Column]:
    """For a column of queries, what each field's clause compares with, null without a clause: the batch form of ``default_registry(terms=False)``."""
    share = chinese_ratio(query)
    lang = F.when(share.isNull(), ctx.fallback_lang).when(share > ctx.chinese_threshold, "zh").otherwise("en")
    media = alias_value(query, ctx.media_keywords)
    number = [F.regexp_extract(query, f"(?i){p}", 1) for p in AT_LEAST]
    fits = lambda n: F.when(n.try_cast("double").between(0, 1), n.try_cast("double"))
    bad = (number[0] != "") & number[0].try_cast("double").isNull()
    days = F.when(F.contains(query, F.lit("近一周")), 7).when(F.contains(query, F.lit("近一月")) | F.contains(query, F.lit("近一个月")), 30)
    since = F.lit(ctx.now).cast("timestamp") - F.make_interval(days=days) if ctx.now else F.lit(None).cast("timestamp")
    blank = F.trim(query) == ""
    found = {"lang": lang, "media_type": F.when(media.isin(*ctx.media_types), media), "quality_score": F.when(~bad, F.coalesce(*map(fits, number))), "created_at": since}
    return {name: F.when(~blank, value) for name, value in found.items() if name in ctx.fields}


def default_registry(terms: bool = True) -> Registry:
    """Parsers for six fields; those for tags and keyphrases only with ``terms``, as they rarely match."""
    found = {"lang": _lang, "media_type": _media, "quality_score": _quality, "created_at": _created}
    return Registry(found | ({"tags": _terms("tags"), "keyphrases": _terms("keyphrases")} if terms else {}))


def infer_where(query: str, ctx: Context, registry: Registry | None = None) -> Where | None:
    """The conjunction of all fields' clauses; a single one stands alone, none gives None."""
    registry = registry or default_registry()
    clauses = [c for name in ctx.fields if (c := registry.parse(name, query, ctx))]
    return None if not query.strip() or not clauses else clauses[0] if len(clauses) == 1 else {"$and": clauses}


def restrict(where: Where | None, fields: tuple[str, ...]) -> Where | None:
    """Without clauses on fields that aren't allowed, and without predicates of several keys."""
    if not where or len(where) != 1:
        return None
    (key, value), *_ = where.items()
    if key not in ("$and", "$or"):
        return where if key in fields else None
    kept = [c for c in (restrict(w, fields) for w in value) if c]
    return None if not kept else kept[0] if len(kept) == 1 else {key: kept}


def compile_where(where: Where | None, arrays: frozenset[str] = frozenset({"tags", "keyphrases"})) -> Column:
    """The predicate as a Column; None is always true. On array fields $in means overlap."""
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            join = Column.__and__ if key == "$and" else Column.__or__
            parts.append(reduce(join, (compile_where(w, arrays) for w in value), F.lit(key == "$and")) if value else F.lit(True))
            continue
        for op, v in value.items() if isinstance(value, dict) else [("$eq", value)]:
            column = F.col(key)
            if op in _COMPARE:
                parts.append(_COMPARE[op][1](column, v))
            elif op == "$in":
                parts.append(F.arrays_overlap(column, F.array(*map(F.lit, v))) if key in arrays else column.isin(*v))
            elif op == "$contains":
                parts.append(F.array_contains(column, v) if key in arrays else F.contains(column, F.lit(v)))
            else:
                raise ValueError(f"unknown operator {op}")
    return reduce(Column.__and__, parts)


def _literal(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    return "'" + str(value).replace("'", "\\'") + "'"


def filter_strings(where: Where | None) -> list[str] | None:
    """The predicate as filter strings that all must hold; an $or is one string in parentheses."""
    out: list[str] = []
    for key, value in (where or {}).items():
        if key == "$and":
            out += [s for w in value for s in filter_strings(w) or ()]
        elif key == "$or":
            sides = [strings for w in value if (strings := filter_strings(w))]
            if sides:
                out.append("(" + " OR ".join(s[0] if len(s) == 1 else f"({' AND '.join(s)})" for s in sides) + ")")
        else:
            for op, v in value.items() if isinstance(value, dict) else [("$eq", value)]:
                if op in _COMPARE:
                    out.append(f"{key} {_COMPARE[op][0]} {_literal(v)}")
                elif op == "$contains" or (op == "$in" and v):
                    out.append(f"{key} IN [{', '.join(map(_literal, v if op == '$in' else [v]))}]")
    return out or None


def filter_column(found: dict[str, Column]) -> Column:
    """The batch form of ``filter_strings`` for ``clause_columns``: one string, its parts joined by AND; empty without a clause."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    forms = {
        "lang": lambda c: F.concat(F.lit("lang = "), quoted(c)),
        "media_type": lambda c: F.concat(F.lit("media_type = "), quoted(c)),
        "quality_score": lambda c: F.concat(F.lit("quality_score >= "), c.cast("string")),
        "created_at": lambda c: F.concat(F.lit("created_at >= "), quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))),
    }
    return F.concat_ws(" AND ", *(forms[name](value) for name, value in found.items()))
