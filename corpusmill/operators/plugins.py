"""Strategies, assessors and loaders that users register by name, run as table functions on the workers.

A factory makes what it stands for where it is used: a strategy has ``cut(text, size, overlap)``, which yields chunks, an assessor
``score(text)``. Factories go along with the plan; a worker makes each when it first meets its name and keeps the
last few, so that heavy ones don't pile up. One that can't be made or fails gives a row with an error.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Made instances that a worker keeps for one plan, unless a registry says otherwise.
MOST_HELD = 4


class Held:
    """The instances used last, at most ``most``; others are closed, if they can be, and made anew when they are needed."""

    def __init__(self, factories: dict[str, Callable[[], Any]], most: int = MOST_HELD):
        self.factories, self.most, self.made = factories, most, OrderedDict()

    def get(self, name: str) -> Any:
        """The instance of that name; KeyError if none is registered."""
        if name in self.made:
            self.made.move_to_end(name)
        else:
            self.made[name] = self.factories[name]()
            while len(self.made) > self.most:
                _, old = self.made.popitem(last=False)
                getattr(old, "close", lambda: None)()
        return self.made[name]


class Registry:
    """Factories by name, of one kind: strategies or assessors. Names count without case."""

    def __init__(self, most_held: int = MOST_HELD):
        self.factories: dict[str, Callable[[], Any]] = {}
        self.most_held = most_held

    def register(self, name: str, factory: Callable[[], Any]) -> None:
        """Add a factory; a later one of the same name takes its place."""
        self.factories[name.lower()] = factory

    def names(self) -> tuple[str, ...]:
        """All names, sorted."""
        return tuple(sorted(self.factories))


def _error(e: Exception) -> str:
    return f"no such name: {e.args[0]}" if isinstance(e, KeyError) and e.args else f"{type(e).__name__}: {e}"[:500]


def cut_by(strategies: Registry, docs: DataFrame) -> DataFrame:
    """Chunks of ``docs`` (doc_id, strategy, text, size, overlap), each cut by the strategy it names: doc_id, chunk_index, text, error.

    A strategy that isn't there, can't be made or fails gives one row with an error after the chunks it yielded. A null text is empty;
    blank chunks are left out.
    """
    factories, most = dict(strategies.factories), strategies.most_held

    @F.udtf(returnType="chunk_index int, text string, error string")
    class Cut:
        def __init__(self) -> None:
            self.held = Held(factories, most)

        def eval(self, name: str, text: str, size: int, overlap: int) -> Iterator[tuple]:
            at = 0
            try:
                for chunk in self.held.get((name or "").lower()).cut(text or "", size, overlap):
                    if chunk and chunk.strip():
                        yield at, chunk, None
                        at += 1
            except Exception as e:  # one bad text or strategy doesn't end the job
                yield at, None, _error(e)

    rows = docs.select("doc_id", "strategy", "text", F.col("size").cast("int").alias("size"), F.col("overlap").cast("int").alias("overlap"))
    made = rows.lateralJoin(Cut(*(F.col(c).outer() for c in ("strategy", "text", "size", "overlap"))).toDF("chunk_index", "chunk", "error"))
    return made.select("doc_id", "chunk_index", F.col("chunk").alias("text"), "error")


def assess_by(assessors: Registry, docs: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Scores of ``docs`` (id, text) by each of the assessors ``names`` (all by default): id, assessor, score, error.

    An assessor that fails on a text gives a row with an error and no score.
    """
    chosen = [n.lower() for n in (names if names is not None else assessors.names())]
    factories, most = dict(assessors.factories), assessors.most_held

    @F.udtf(returnType="assessor string, score double, error string")
    class Assess:
        def __init__(self) -> None:
            self.held = Held(factories, most)

        def eval(self, text: str) -> Iterator[tuple]:
            for name in chosen:
                try:
                    yield name, float(self.held.get(name).score(text or "")), None
                except Exception as e:
                    yield name, None, _error(e)

    return docs.select("id", "text").lateralJoin(Assess(F.col("text").outer())).select("id", "assessor", "score", "error")
