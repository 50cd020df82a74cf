"""URL filters: a weighted vocabulary found by Aho-Corasick, and host-and-path rules.

One pass of the automaton over a lower-cased url finds every term; an occurrence counts if
neither neighbour is an ASCII letter or digit. A term of weight 1 or more is strict and a
single hit rejects the url; of the others (soft), ``min_soft`` distinct ones must occur. A term and the same
with an s at its end, both of the vocabulary and of one kind, are one term in two forms.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.arrow import map_texts
from corpusmill.sources.tables import read_table

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

STRICT = ("bitcoin-doubler", "camgirl", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "jackpot", "malware", "phishing", "poker", "porn", "porno", "roulette", "spam", "viagra", "cialis", "warez", "xxx")
SOFT = ("ad", "ads", "adult", "banner", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "cracked", "deal", "deals", "discount", "farm", "free", "gambling", "keygen", "loan", "loans", "lottery", "meds", "nude", "payday", "pharmacy", "pill", "pills", "popup", "prize", "promo", "sex", "sexy", "slot", "slots", "torrent", "track", "tracker", "win", "winner")
VOCABULARY = {**{t: 1.0 for t in STRICT}, **{t: 0.5 for t in SOFT}}
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty for null or a url without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    rest = rest[: min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    made.make_automaton()
    return made


@lru_cache(maxsize=8)
def _by_host(rules: tuple[Rule, ...]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules (path, rule, verdict) by host, longest path first."""
    made: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        made.setdefault(host, []).append((path, host + path, verdict))
    for found in made.values():
        found.sort(key=lambda r: -len(r[0]))
    return made


def fitting_rule(host: str, path: str, rules: tuple[Rule, ...]) -> tuple[str, str] | None:
    """The longest rule that fits, as (rule, verdict)."""
    by_host, best, at = _by_host(rules), None, 0
    while True:  # the host itself, then its parents
        for start, rule, verdict in by_host.get(host[at:], ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break
        if not (dot := host.find(".", at) + 1):
            return best
        at = dot


def term_of(form: str, vocabulary: dict[str, float]) -> str:
    """The term that a form stands for: without its last s if that is in the vocabulary too and as strict, else itself."""
    bare = form.removesuffix("s")
    return bare if bare in vocabulary and (vocabulary[bare] >= 1) == (vocabulary[form] >= 1) else form


def hits(url: str | None, vocabulary: dict[str, float]) -> set[str]:
    """The terms of which a form occurs in the url between boundaries."""
    if not url or not vocabulary:
        return set()
    text, found = url.translate(_LOWER), set()
    for end, term in _automaton(tuple(sorted(vocabulary))).iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found.add(term_of(term, vocabulary))
    return found


def judge(urls: Iterable[str | None], rules: tuple[Rule, ...], vocabulary: dict[str, float], min_soft: int) -> dict[str, list]:
    """host, path, rule, verdict, n_strict, n_soft and score of each url."""
    rows = []
    for url in urls:
        host, path = host_and_path(url)
        found = hits(url, vocabulary)
        strict = sum(vocabulary[t] >= 1 for t in found)
        soft = len(found) - strict
        own = "block" if strict or soft >= min_soft else "allow"
        rule, verdict = fitting_rule(host, path, rules) or (None, own)
        rows.append((host, path, rule, verdict, strict, soft, float(sum(vocabulary[t] for t in found))))
    return dict(zip(("host", "path", "rule", "verdict", "n_strict", "n_soft", "score"), map(list, zip(*rows, strict=True)), strict=True))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: dict[str, float] = VOCABULARY, min_soft: int = 2) -> DataFrame:
    """Judge the url of every row of ``pages``.

    Returns page_id, host, path, rule, verdict (a fitting rule's, else the vocabulary's: block
    or allow), n_strict and n_soft (distinct terms found), score (their weights together). A null or
    empty url has empty host and path and is allowed; the whole url is searched, whatever its
    length. Each row is judged by itself, so repeated rows repeat their verdict; an empty table
    gives an empty result. Other columns of ``pages`` are not read.
    """
    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"CAST(`{url_col}` AS string) AS url")
    schema = "host string, path string, rule string, verdict string, n_strict int, n_soft int, score double"
    return map_texts(rows, "url", lambda urls: judge(urls, rules, vocabulary, min_soft), schema)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(read_table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _sql() -> str:
    def count(kind: tuple[str, ...]) -> str:
        forms: dict[str, list[str]] = {}
        for t in kind:
            forms.setdefault(t[:-1] if t.endswith("s") and t[:-1] in kind else t, []).append(t)
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9])({'|'.join(f)})([^a-z0-9]|$)')::INT" for f in forms.values())

    fits = lambda host, path: f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda what: " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h + p)}'" for v, h, p in longest)
    return f"""
WITH a AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, ({count(STRICT)})::INT AS n_strict, ({count(SOFT)})::INT AS n_soft FROM b
)
SELECT page_id, host, path, CASE {pick(lambda v, r: r)} ELSE NULL END AS rule,
       CASE {pick(lambda v, r: v)} WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM c
"""


QUERIES = {"op1_url_filter": op1_url_filter}
SQL = {"op1_url_filter": _sql()}
