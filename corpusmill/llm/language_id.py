"""Language identification by cross-parsing entropy.

Of each labelled language a bounded number of rows is kept, and the suffix automaton of their text
accepts exactly its substrings. A document is parsed against each automaton: a phrase is
the longest match from where the last one ended, and a byte that the sample doesn't hold is a
phrase of its own. The language that needs the fewest phrases wins. A phrase costs the same in every language, the
logarithm of the longest sample's length, so that what no sample holds doesn't fall to the language with the least text.

Blocks of ``BLOCK`` bytes, of one document or of several, advance in step through the automata's
tables, one byte of each and all languages at a time. At first each block is parsed as if a
phrase began with it; then every block that the one before leaves in another state is parsed
again from that state, until no state changes. As greedy parses from different places soon
meet, few blocks are parsed more than twice, and the phrases are those of a parse from end to end.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.arrow import filter_texts, held, map_texts
from corpusmill.llm.split import held_out
from corpusmill.sources.tables import read_table

BLOCK, LANES = 256, 4096
#: The labelled sample of a language: so many rows at most, taken whole, the shortest of those with so many letters first.
ROWS, LETTERS = 24, 512
#: Bytes of all languages' samples together; beyond, each language has fewer rows, but one at least.
ALL_SAMPLES = 1 << 18
#: A text that costs more bits a byte than the byte itself, but for so many phrases, is in no learned language.
RAW_BITS, FREE_PHRASES = 8.0, 3
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BREAK = 1 << 30


class Samples(NamedTuple):
    """Normalised sample of each language, in order of language."""

    langs: tuple[str, ...]
    texts: tuple[bytes, ...]


def _byte_table() -> bytes:
    """ASCII that isn't a letter becomes a space."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


_TABLE = _byte_table()
_SPACES = re.compile(rb"  +")


def normalise(text: str) -> bytes:
    """Lower case, UTF-8, each run of other ASCII than letters as one space."""
    return _SPACES.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(_TABLE))


def has_letter(text: str) -> bool:
    """Whether any character of ``text`` is a letter."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    goto: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return goto


class Parser:
    """The automata of all languages in one table.

    A cell holds the next state's row, with ``_BREAK`` added where the byte begins a phrase.
    At the root every byte does; one that the sample doesn't hold leads back there. Byte class
    0 pads.
    """

    def __init__(self, samples: Samples):
        used = sorted(set(b"".join(samples.texts)))
        self.classes = np.full(256, 1, np.uint8)  # 1: in no sample
        self.classes[used] = np.arange(2, 2 + len(used), dtype=np.uint8)
        width = self.width = 2 + len(used)
        tables, self.roots, rows = [], [], 0
        for text in samples.texts:
            goto = suffix_automaton(text)
            base = rows * width
            fresh = np.full(width, base, np.int32)
            for c, t in goto[0].items():
                fresh[self.classes[c]] = base + t * width
            table = np.broadcast_to(fresh + np.int32(_BREAK), (len(goto), width)).copy()
            table[:, 0] = base + np.arange(len(goto)) * width
            at = [(s, self.classes[c], t) for s, row in enumerate(goto) if s for c, t in row.items()]
            s, c, t = np.array(at, np.int32).reshape(-1, 3).T
            table[s, c] = base + t * width
            tables.append(table)
            self.roots.append(base)
            rows += len(goto)
        self.table = np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(0, np.int32)
        # a place in the longest sample, but no less than a byte as it is: what few bytes can't express isn't cheap
        self.bits = math.log2(max([256, *map(len, samples.texts)]))

    def _blocks(self, lanes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after, and phrases begun in, each row of ``lanes`` (blocks of byte classes) that is entered in the states ``row``."""
        steps, row = np.ascontiguousarray(lanes.T), row.copy()
        count, cell, brk = np.zeros_like(row), np.empty_like(row), np.empty_like(row)
        for step in steps:
            np.add(row, step, out=cell)
            self.table.take(cell, out=row, mode="clip")
            np.right_shift(row, 30, out=brk)
            np.add(count, brk, out=count)
            np.bitwise_and(row, _BREAK - 1, out=row)
        return row, count

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language."""
        n_blocks = np.array([-(-len(t) // BLOCK) for t in texts], int)
        joined = b"".join(t.ljust(n * BLOCK, b"\xff") for t, n in zip(texts, n_blocks, strict=True))
        classes = self.classes[np.frombuffer(joined, np.uint8)].reshape(-1, BLOCK)
        ends = np.cumsum(n_blocks)
        for end, n, t in zip(ends, n_blocks, texts, strict=True):
            if n and (pad := n * BLOCK - len(t)):
                classes[end - 1, BLOCK - pad :] = 0
        root = np.array(self.roots, np.int32)[:, None]
        entry = np.repeat(root, len(classes), 1)
        after, count = np.empty_like(entry), np.empty_like(entry)
        first = np.zeros(len(classes), bool)
        first[(ends - n_blocks)[n_blocks > 0]] = True
        todo = np.arange(len(classes))
        while len(todo):
            for at in (todo[i : i + LANES] for i in range(0, len(todo), LANES)):
                after[:, at], count[:, at] = self._blocks(classes[at], entry[:, at])
            now = np.where(first, root, np.roll(after, 1, 1))
            todo = np.flatnonzero((now != entry).any(0))
            entry = now
        total = np.concatenate([np.zeros((len(self.roots), 1)), np.cumsum(count, 1)], 1)
        return (total[:, ends] - total[:, ends - n_blocks]).T


def _costs(texts: list[str], samples: Samples) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text (rows) in each language, and the texts' bytes."""
    parser = held(("parser", samples), lambda: Parser(samples))
    clean = [normalise(t) for t in texts]
    return parser.phrases(clean) * parser.bits, np.array([max(len(c), 1) for c in clean])


def predict(texts: list[str | None], samples: Samples, sharpness: float = 8.0) -> dict[str, list]:
    """lang_pred, score and known of each text: known is whether it costs less than its bytes as they are."""
    langs, scores, known = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if samples.langs else []
    if at:
        bits, size = _costs([texts[i] for i in at], samples)
        rate = bits / size[:, None]
        weight = np.exp(-sharpness * (rate - rate.min(1, keepdims=True)))
        free = FREE_PHRASES * math.log2(max(map(len, samples.texts)) + 256)
        by_size = np.argsort([-len(t) for t in samples.texts], kind="stable")
        for i, best, score, cheap in zip(at, by_size[rate[:, by_size].argmin(1)], weight.max(1) / weight.sum(1), bits.min(1) <= RAW_BITS * size + free, strict=True):
            langs[i], scores[i], known[i] = samples.langs[best], float(score), bool(cheap)
    return {"lang_pred": langs, "score": scores, "known": known}


def _rows_each(lengths: list[list[int]]) -> int:
    """How many rows of a language are kept: ROWS, or fewer where all together exceed ``ALL_SAMPLES``."""
    return next((n for n in range(ROWS, 1, -1) if sum(sum(one[:n]) for one in lengths) <= ALL_SAMPLES), 1)


def draw_samples(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Samples:
    """The text of ``rows`` rows of each language at most, the same on every run.

    The ids' hashes are dealt into ``rows`` slots, and of each slot and language one row is chosen and taken whole:
    that with the most letters (``LETTERS`` and more count as equal), of these the shortest, then that of
    the smallest hash. How much text one language has doesn't shorten another's sample, but for what all have
    together (``ALL_SAMPLES``). Rows with a null id, text or language, and those without a letter, are passed over.
    """
    hashed, text = F.xxhash64(F.col(id_col)), F.col(text_col).cast("string")
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    rank = F.struct((LETTERS - F.least(letters, F.lit(LETTERS))).alias("missing"), F.length(text).alias("chars"), hashed.alias("hash"))
    some = labelled.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.regexp_like(text, F.lit(r"\p{L}")))
    lang = F.col(lang_col).cast("string").alias("lang")
    slots = some.groupBy(lang, F.pmod(hashed, F.lit(rows)).alias("slot")).agg(F.min(rank).alias("rank"))
    chosen = {(r["lang"], *r["rank"]) for r in slots.collect()}  # rows times languages at most
    if not chosen:
        return Samples((), ())
    found = some.where(hashed.isin([c[-1] for c in chosen])).groupBy(lang, rank.alias("rank")).agg(F.min(text).alias("text"))
    by_lang: dict[str, dict[int, bytes]] = {}
    for r in found.collect():
        if (r["lang"], *r["rank"]) in chosen:
            by_lang.setdefault(r["lang"], {})[r["rank"]["hash"]] = normalise(r["text"])
    drawn = {lang: [t for _, t in sorted(texts.items())] for lang, texts in sorted(by_lang.items())}
    n = _rows_each([[len(t) for t in texts] for texts in drawn.values()])
    return Samples(tuple(drawn), tuple(b" ".join(texts[:n]) for texts in drawn.values()))


def identify(docs: DataFrame, samples: Samples, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Predict the language of the whole text of every row of ``docs``.

    Returns doc_id, ``keep``, lang_pred (a language of ``samples``; und if the text is null or holds no
    letter, or there are no samples) and score (0 to 1, the winner's share; 0 for und). Ties
    go to the language with the longest sample, of these to the first in order. Each row is judged by itself; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text"))

    def step(texts: list[str | None]) -> dict[str, list]:
        found = predict(texts, samples)
        return {"lang_pred": found["lang_pred"], "score": found["score"]}

    return map_texts(rows, "__text", step, "lang_pred string, score double")


def keep_identified(docs: DataFrame, samples: Samples, text_col: str = "text", languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in one of ``languages``.

    ``languages`` are by default all those of ``samples``. Rejected are texts that are null or hold
    no letter (und), those predicted to be in another language, and those in no learned one:
    that cost more bits a byte than ``RAW_BITS``, a few phrases not counted. Without
    samples nothing is predicted: then, unless ``languages`` are named, every text with a letter is kept.
    """
    wanted = frozenset(samples.langs if languages is None else languages)
    untold = languages is None and not samples.langs

    def keep(texts: list[str | None]) -> list[bool]:
        if untold:
            return [has_letter(t or "") for t in texts]
        found = predict(texts, samples)
        return [lang in wanted and known for lang, known in zip(found["lang_pred"], found["known"], strict=True)]

    return filter_texts(docs, text_col, keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    samples = draw_samples(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, samples, keep=(held_out("doc_id", 4, 2).alias("held_out"),))


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
