"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over a document's UTF-8 bytes. Their responses are max-pooled over
chunks of ``CHUNK`` bytes that overlap by half and cover the whole document; a squashed
response says how strongly a chunk shows a filter's pattern. The mean and the maximum over chunks
of each filter's squashed response are combined by a logistic unit into one probability.

A filter over one-hot bytes is a sum of table rows, one for each of its bytes; for scoring
the rows of two neighbouring bytes are added up beforehand, so a response is a sum of two.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.arrow import held, map_texts
from corpusmill.llm.split import held_out
from corpusmill.sources.tables import read_table

WIDTH, FILTERS = 4, 16
CHUNK, STRIDE = 512, 256
#: Blocks of ``STRIDE`` bytes convolved at once, for scoring and for learning.
SPAN, FIT_SPAN = 32, 512
#: The labelled sample: so many rows at most, taken whole.
SAMPLE_ROWS = 2000


class Model(NamedTuple):
    """Filters by byte of the window (WIDTH, 256, FILTERS), their biases, the last unit's weights and bias."""

    filters: np.ndarray
    biases: np.ndarray
    weights: np.ndarray
    bias: float


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as zero-padded blocks of STRIDE bytes, at least one each, and their numbers of blocks.

    WIDTH zeros or more follow each text. The last windows of its last block would reach into
    the next text; ``_own_windows`` leaves them out.
    """
    n = np.array([(len(t) + WIDTH - 1) // STRIDE + 1 for t in texts])
    joined = b"".join(t.ljust(k * STRIDE, b"\0") for t, k in zip(texts, n, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, STRIDE), n


def _own_windows(x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Responses (block, place, filter) without those of windows that leave their text's ``last`` block."""
    x[last, STRIDE - WIDTH + 1 :] = -np.inf
    return x


def _pool(block_max: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum in each chunk (a block and the next one of its text); the block it came from; first chunk of each text."""
    last = np.cumsum(n) - 1
    following = np.arange(1, len(block_max) + 1)
    following[last] = last  # a text's last chunk is its last block
    later = block_max[following] > block_max
    return np.where(later, block_max[following], block_max), np.where(later, following[:, None], np.arange(len(block_max))[:, None]), last - n + 1


def _combine(chunks: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text from its chunks' squashed responses: means, then maxima; and the squashed responses."""
    shown = np.tanh(np.maximum(chunks, 0))
    mean = np.add.reduceat(shown, first, axis=0) / n[:, None]
    return np.concatenate([mean, np.maximum.reduceat(shown, first, axis=0)], 1), shown


class Scorer:
    """A model folded for scoring."""

    def __init__(self, model: Model):
        self.model = model
        pairs = model.filters.astype(np.float32)
        self.pairs = [(pairs[k][:, None] + pairs[k + 1][None]).reshape(1 << 16, -1) for k in range(0, WIDTH, 2)]
        self.pairs[0] = self.pairs[0] + model.biases.astype(np.float32)

    def _block_max(self, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
        flat = np.concatenate([blocks.ravel(), np.zeros(WIDTH, np.uint8)])
        pair = (flat[:-1].astype(np.uint16) << 8) | flat[1:]
        out = np.empty((len(blocks), self.pairs[0].shape[1]), np.float32)
        for i in range(0, len(blocks), SPAN):
            a, b = i * STRIDE, min(i + SPAN, len(blocks)) * STRIDE
            x = self.pairs[0].take(pair[a:b], axis=0)
            for k, table in enumerate(self.pairs[1:], 1):
                x += table.take(pair[a + 2 * k : b + 2 * k], axis=0)
            own = last[np.searchsorted(last, i) : np.searchsorted(last, i + SPAN)] - i
            x, half = _own_windows(x.reshape(-1, STRIDE, x.shape[1]), own), STRIDE // 2
            while half:
                x = np.maximum(x[:, :half], x[:, half : 2 * half])
                half //= 2
            out[i : i + SPAN] = x[:, 0]
        return out

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each text."""
        if not texts:
            return np.zeros(0)
        blocks, n = blocks_of(texts)
        chunks, _, first = _pool(self._block_max(blocks, np.cumsum(n) - 1), n)
        features, _ = _combine(chunks, first, n)
        return 1 / (1 + np.exp(-(features @ self.model.weights + self.model.bias)))


def _responses(flat: np.ndarray, filters: np.ndarray, biases: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each block of ``flat``, and its place in the block; a bounded number of blocks at once."""
    count = (len(flat) - WIDTH) // STRIDE
    most, where = np.empty((count, FILTERS)), np.empty((count, FILTERS), int)
    for i in range(0, count, FIT_SPAN):
        a, b = i * STRIDE, min(i + FIT_SPAN, count) * STRIDE
        x = biases + sum(filters[k][flat[a + k : b + k]] for k in range(WIDTH))
        own = last[np.searchsorted(last, i) : np.searchsorted(last, i + FIT_SPAN)] - i
        x = _own_windows(x.reshape(-1, STRIDE, FILTERS), own)
        where[i : i + FIT_SPAN] = x.argmax(1)
        most[i : i + FIT_SPAN] = np.take_along_axis(x, where[i : i + FIT_SPAN, None], 1)[:, 0]
    return most, where


def gradients(model: list[np.ndarray], texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean logistic loss of ``texts``, and its gradient by filters, their biases, the last unit's weights and bias.

    A maximum passes its gradient to the window that reached it.
    """
    filters, biases, w, b = model
    blocks, n = blocks_of(texts)
    flat = np.concatenate([blocks.ravel(), np.zeros(WIDTH, np.uint8)])
    most, where = _responses(flat, filters, biases, np.cumsum(n) - 1)
    chunks, source, first = _pool(most, n)
    features, shown = _combine(chunks, first, n)
    out = features @ w + b
    p = 1 / (1 + np.exp(-out))
    loss = float((weight * (np.logaddexp(0, out) - y * out)).mean())
    d = (p - y) * weight / len(y)
    d_features = d[:, None] * w
    text_of = np.repeat(np.arange(len(y)), n)
    d_shown = (d_features[:, :FILTERS] / n[:, None])[text_of]
    top = shown == features[:, FILTERS:][text_of]
    d_shown += top * d_features[:, FILTERS:][text_of] / np.add.reduceat(top, first, axis=0)[text_of]
    d_chunks = d_shown * (1 - shown**2) * (chunks > 0)
    place = source * STRIDE + np.take_along_axis(where, source, 0)
    g_filters = np.zeros_like(filters)
    of = np.broadcast_to(np.arange(FILTERS), place.shape)
    for k in range(WIDTH):
        np.add.at(g_filters[k], (flat[place + k], of), d_chunks)
    return loss, [g_filters, d_chunks.sum(0), features.T @ d, np.array([d.sum()])]


def fit(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 64, least_steps: int = 300, rate: float = 0.02, seed: int = 5) -> Model:
    """Learn all weights by Adam on the logistic loss, both classes weighing the same.

    There are ``epochs`` rounds over the rows, more where few rows would make under ``least_steps``. Without
    any label, or with labels of one kind only, every text gets probability 1/2 or that label.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    model = [rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1)]
    if len(y) == 0 or y.min() == y.max():
        return Model(model[0], model[1], np.zeros(2 * FILTERS), 0.0 if len(y) == 0 else 20.0 * (2 * y[0] - 1))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moments = [(np.zeros_like(m), np.zeros_like(m)) for m in model]
    step, order = 0, np.arange(len(y))
    batches = -(-len(y) // batch)
    epochs = max(epochs, -(-least_steps // batches))
    total = epochs * batches
    for _ in range(epochs):
        rng.shuffle(order)
        for at in (order[i : i + batch] for i in range(0, len(order), batch)):
            _, grads = gradients(model, [texts[i] for i in at], y[at], weight[at])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for m, g, (m1, m2) in zip(model, grads, moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                m -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(model[0], model[1], model[2], float(model[3][0]))


def encode(text: str | None) -> bytes:
    """A text's UTF-8 bytes; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a bounded sample of the labelled rows, the same on every run.

    Of the labelled ids whose rows have a text, the ``rows`` of smallest hash are taken, with their whole texts, however
    long. Null ids, labels and texts are passed over before; an id labelled more than once has its largest
    label, one of several texts the smallest. ``docs`` without a labelled row give no sample.
    """
    hashed = F.xxhash64(F.col("id"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    chosen = known.join(texts.select("id"), "id", "left_semi").orderBy(hashed, "id").limit(rows)
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    drawn = sorted(found.collect(), key=lambda r: r["id"])  # ``rows`` ids at most
    return fit([encode(r["text"]) for r in drawn], [r["label"] for r in drawn])


def _scorer(key: bytes) -> Scorer:
    import pickle

    return held(("scorer", key), lambda: Scorer(pickle.loads(key)))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Score the whole text of every row of ``docs``: doc_id, ``keep``, score (0 to 1) and predicted (1 if score >= 0.5).

    A null text counts as empty, and an empty one gets the score of a document without any
    pattern. Each row is judged by itself; an empty table gives an empty result.
    """
    import pickle

    key = pickle.dumps(Model(*(np.asarray(m, np.float32) if isinstance(m, np.ndarray) else m for m in model)))

    def step(texts: list[str | None]) -> dict[str, list]:
        score = _scorer(key)([encode(t) for t in texts])
        return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text"))
    return map_texts(rows, "__text", step, "score double, predicted int")


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit_on(docs, labels.where(~held_out("doc_id", 3, 1)))
    return score_quality(docs, model, keep=(held_out("doc_id", 3, 1).alias("held_out"),))


QUERIES = {"op2_quality_cnn": op2_quality_cnn}
SQL: dict[str, str] = {}
