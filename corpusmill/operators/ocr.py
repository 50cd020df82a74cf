"""Recognition of text in images by a chain of engines.

Each image goes to the first engine; one on which an engine fails, finds nothing or is too unsure goes on to the next. What
was found last by the surest engine stays, with the engine's name and what the others reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An engine takes images (bytes) and returns for each its regions: text, confidence (0 to 1), x, y.
Engine = Callable[[list[bytes]], list[list[tuple[str, float, float, float]]]]

_REGION = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("x", pa.float64()), ("y", pa.float64())])
_TYPES = {"engine": pa.string(), "regions": pa.list_(_REGION), "errors": pa.list_(pa.string())}
#: Images that an engine gets at once.
IMAGES = 16


def _each_by_itself(engine: Engine, images: list[bytes]) -> list[list | Exception]:
    """What the engine finds in each image, or why it fails; one bad image doesn't spoil the others."""
    try:
        return list(engine(images))
    except Exception as whole:
        if len(images) == 1:
            return [whole]
        return [_each_by_itself(engine, [i])[0] for i in images]


def _chain(images: list[bytes | None], engines: Sequence[tuple[str, Engine]], least: float) -> list[dict]:
    best = [{"engine": None, "regions": [], "errors": []} for _ in images]
    sure, todo = [-1.0] * len(images), [i for i, b in enumerate(images) if b]
    for name, engine in engines:
        if not todo:
            break
        left = []
        for i, found in zip(todo, _each_by_itself(engine, [bytes(images[i]) for i in todo]), strict=True):
            if isinstance(found, Exception):
                best[i]["errors"].append(f"{name}: {type(found).__name__}: {found}"[:500])
                left.append(i)
                continue
            regions = [dict(zip(("text", "confidence", "x", "y"), r, strict=True)) for r in found if r[0].strip()]
            mean = sum(r["confidence"] for r in regions) / len(regions) if regions else -1.0
            if mean > sure[i]:
                sure[i] = mean
                best[i] |= {"engine": name, "regions": regions}
            if mean < least or not regions:
                best[i]["errors"].append(f"{name}: {'nothing found' if not regions else f'confidence {mean:.3f}'}")
                left.append(i)
        todo = left
    return best


def recognise(images: DataFrame, engines: Sequence[tuple[str, Engine]], least: float = 0.5, content_col: str = "content") -> DataFrame:
    """The columns of ``images`` but the content, and engine, regions (text, confidence, x, y) and errors of each.

    ``engines`` (name, engine) are tried in order, in one pass; each gets only those images on which all before it failed, found nothing, or
    came to a mean confidence under ``least``. If none does better, the surest find stays. A null or empty
    content has no regions and no engine. Engines are shipped to the workers as they are.
    """
    kept = [f for f in images.schema.fields if f.name not in (content_col, *_TYPES)]
    rows = images.select(*(F.col(f"`{f.name}`") for f in kept), F.col(content_col).cast("binary").alias("__content"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, IMAGES) for at in range(0, batch.num_rows, IMAGES)):
                made = _chain(part.column("__content").to_pylist(), engines, least)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(pa.array([m[n] for m in made], t) for n, t in _TYPES.items())], names=[*(f.name for f in kept), *_TYPES])

    out = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "engine string", "regions array<struct<text:string, confidence:double, x:double, y:double>>", "errors array<string>"]
    return rows.mapInArrow(each, ", ".join(out))
