"""Words of texts that don't part them: a unigram lattice whose vocabulary is learned from the corpus.

Candidates are the substrings of runs of letters that occur often enough, counted over all texts. Their
probabilities come from expectation and maximisation: each distinct run, with the number of its
occurrences, spreads over all ways to part it, by how likely each is; tasks sum what every word gets, and
only these sums move. A text is then parted in the likeliest way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import materialise

#: Runs of Chinese characters, as a pattern.
HAN = "[一-鿿]+"
#: Longest word, least number of occurrences of a candidate, rounds, and words of more than one letter at most; these and the single letters are all that the driver holds.
LONGEST, LEAST, ROUNDS, MOST_WORDS = 4, 5, 4, 50_000
#: How much more often than by chance a word's parts stand side by side.
COHESION = 10.0


@dataclass(frozen=True)
class Segmenter:
    """Probabilities of words; a letter that has none counts as rare."""

    chances: dict[str, float]
    longest: int = LONGEST
    rare: float = 1e-9

    def _chance(self, word: str) -> float:
        return self.chances.get(word, self.rare if len(word) == 1 else 0.0)

    def expected(self, run: str, times: float, sums: dict[str, float]) -> None:
        """Add to ``sums`` how often each word occurs in ``times`` such runs, over all ways to part it.

        ``rise[i]`` is how much likelier the first i letters are than the first i - 1; being ratios, they neither vanish nor overflow.
        """
        n, rise = len(run), [1.0] * (len(run) + 1)
        for i in range(1, n + 1):
            total, before = 0.0, 1.0
            for size in range(1, min(self.longest, i) + 1):
                before *= rise[i - size + 1] if size > 1 else 1.0
                total += self._chance(run[i - size : i]) / before
            rise[i] = total
        edge = [0.0] * n + [float(times)]  # how often a word ends at i
        for i in range(n, 0, -1):
            within = 1.0
            for size in range(1, min(self.longest, i) + 1):
                within *= rise[i - size + 1]
                if chance := self._chance(word := run[i - size : i]):
                    share = edge[i] * chance / within
                    edge[i - size] += share
                    sums[word] = sums.get(word, 0.0) + share

    def words(self, run: str) -> list[str]:
        """The run parted in the likeliest way; of equally likely ones the one with the longer last word."""
        score, last = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for i in range(1, len(run) + 1):
            for size in range(min(self.longest, i), 0, -1):
                if (chance := self._chance(run[i - size : i])) and (now := score[i - size] + math.log(chance)) > score[i]:
                    score[i], last[i] = now, size
        out, at = [], len(run)
        while at:
            out.append(run[at - last[at] : at])
            at -= last[at]
        return out[::-1]

    def column(self, text: Column, letters: str = HAN) -> Column:
        """The words of a text: those of its runs of ``letters``, and between these what white space parts; null for null."""
        import re

        inside = re.compile(letters)

        @F.pandas_udf("array<string>")
        def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in texts:
                yield part.map(lambda t: None if t is None else self._parted(t, inside))

        return each(text)

    def _parted(self, text: str, inside) -> list[str]:
        out, at = [], 0
        for m in inside.finditer(text):
            out += text[at : m.start()].split()
            out += self.words(m[0])
            at = m.end()
        return out + text[at:].split()


def runs(docs: DataFrame, text_col: str, letters: str = HAN) -> DataFrame:
    """Distinct runs of ``letters`` in all texts: run, n."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(letters), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def substrings(found: DataFrame, longest: int) -> DataFrame:
    """How often each substring of up to ``longest`` letters occurs in the runs (run, n): word, n."""
    rows = found.select(F.split("run", "").alias("c"), "n")
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("c")))
    words = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size("c") - s + 1), lambda i: F.array_join(F.slice("c", i, s), ""))))
    return rows.select("n", F.explode(words).alias("word")).groupBy("word").agg(F.sum("n").alias("n"))


def cohesive(counts: DataFrame, least: float) -> DataFrame:
    """The words of several letters (word, n) that occur at least ``least`` times as often as their parts would side by side by chance, however cut."""
    letters = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    cuts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, k)").alias("left"), F.expr("substring(word, k + 1)").alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")), side)
    apart = F.col("n").cast("double") * letters / F.col("n_left") / F.col("n_right")
    return cuts.groupBy("word", "n").agg(F.min(apart).alias("least")).where(F.col("least") >= least).select("word", "n")


def _round(found: DataFrame, now: Segmenter) -> dict[str, float]:
    """What each word of the lattice is expected to occur, over all runs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, float] = {}
        for batch in batches:
            for run, n in zip(batch.column("run").to_pylist(), batch.column("n").to_pylist(), strict=True):
                now.expected(run, n, sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(sums.values(), pa.float64())], names=["word", "n"])

    made = found.mapInArrow(each, "word string, n double").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in made.collect()}  # at most the vocabulary


def learn(docs: DataFrame, text_col: str, letters: str = HAN, longest: int = LONGEST, least: int = LEAST, rounds: int = ROUNDS, most_words: int = MOST_WORDS, cohesion: float = COHESION) -> Segmenter:
    """A segmenter for the runs of ``letters`` in all texts.

    A word of more than one letter occurs ``least`` times or more, ``cohesion`` times as often as its parts do by chance
    (``cohesive``), and is expected at least half of ``least`` times; of more than
    ``most_words`` candidates those stay that cover most letters. Null texts are passed over; without any run every letter is a word.
    """
    found = materialise(runs(docs, text_col, letters), "runs")
    counts = materialise(substrings(found, longest).where((F.col("n") >= least) | (F.length("word") == 1)), "substrings")
    size = F.length("word")
    longer = cohesive(counts, cohesion).orderBy((F.col("n") * size).desc(), "word").limit(most_words)
    held = {r.word: float(r.n) for r in longer.unionByName(counts.where(size == 1)).collect()}
    for i in range(rounds + 1):
        total = sum(held.values()) or 1.0
        now = Segmenter({w: n / total for w, n in held.items()}, longest, rare=0.5 / (total + 1))
        if i < rounds:
            sums = _round(found, now)
            held = {w: max(n, 1e-3) for w, n in sums.items() if len(w) == 1 or n >= least / 2}
    return now
