"""Vector codes against a plain version."""

import math

import numpy as np
import pytest

from corpusmill.llm import vector_codes


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """By definition, from (id, vector, label) of one length."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][1])
    cut = lambda v, p: v[p * dim // parts : (p + 1) * dim // parts]
    least = {}
    for i, v, _ in kept:
        least[i] = min(least.get(i, v), v)
    first = sorted(least, key=lambda i: (i is None, i))[:entries]
    books = [[cut(least[i], p) for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    coded = [(i, "".join(f"{e:02x}" for _, e in f), err, by_label[lab]) for (i, _, lab), f, err in zip(kept, found, errors, strict=True)]
    return sorted(coded, key=str), books


def run(df, **how):
    coded, books = vector_codes.compress(df, **how)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=str), books


SCHEMA = "vec_id long, embedding array<float>, label int, code int, dim string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SCHEMA)


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (n, dim)).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize(("n", "dim", "how"), [(150, 8, {}), (120, 10, {"entries": 7}), (60, 8, {"entries": 3, "rounds": 1, "scale": 4}), (40, 3, {"parts": 2, "entries": 40, "scale": 2})])
def test_plain(spark, n, dim, how):
    rows = [(i * 3 % n, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors(n, dim, n, 0.1))]
    got, books = run(frame(spark, rows).repartition(3), **how)
    want, want_books = plain(rows, **how)
    assert got == want and books[dim] == want_books


def test_odd(spark):
    good = [[0.5, -0.25, 0.1, 0.0], [0.5, -0.25, 0.1, 0.0], [0.25, 1.0, -1.0, 0.5]]
    rows = [(1, good[0], 1), (1, good[1], 1), (1, good[2], None), (None, good[2], None), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [float("nan")] * 4, 1), (5, [float("inf"), 0.0, 0.0, 0.0], 2), (6, [-0.001] * 4, 2)]
    got, books = run(frame(spark, rows))
    want, want_books = plain(rows)
    assert got == want and books[4] == want_books
    assert run(frame(spark, rows[4:8])) == ([], {}) and run(frame(spark, [])) == ([], {})
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, rows), entries=257)


def test_lengths_have_their_own_codebooks(spark):
    short, long_ = [(i, v, 1) for i, v in enumerate(vectors(20, 4, 1))], [(i, v, 2) for i, v in enumerate(vectors(20, 6, 2))]
    got, books = run(frame(spark, [*short, *long_, (99, [], 3)]), entries=5)
    assert got == sorted([*plain(short, entries=5)[0], *plain(long_, entries=5)[0], (99, "00000000", 0, 0)], key=str)
    assert books[4] == plain(short, entries=5)[1] and books[6] == plain(long_, entries=5)[1]


def test_large_components(spark):
    rows = [(i, [float(np.float32(x * 1e4)) for x in v], 1) for i, v in enumerate(vectors(12, 4, 3))]
    assert run(frame(spark, rows), entries=4)[0] == plain(rows, entries=4)[0]
    with pytest.raises(Exception, match="64 bits"):
        run(frame(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)]))


@pytest.mark.parametrize("kind", [float, np.int64])
def test_search_from_any_start(kind):
    rng = np.random.default_rng(5)
    for spread in (3, 1000):  # many ties, then few
        x, entries = rng.integers(-spread, spread, (400, 4)).astype(kind), rng.integers(-spread, spread, (90, 4)).astype(kind)
        book = vector_codes.Codebook(entries)
        squares = ((x[:, None] - entries) ** 2).sum(2)
        for before in (book.start(x), rng.integers(0, 90, 400), np.zeros(400, int), squares.argmin(1)):
            code, square = book.nearest(x, before)
            assert (code == squares.argmin(1)).all() and (square == squares.min(1)).all()


def test_sums_begin_anew_before_they_pass_64_bits():
    assign = vector_codes.Assigner({4: [[[0], [5]] for _ in range(4)]}, 4)
    assign(np.array([[1, 2, 3, 4], [6, 6, 6, 6]]), None)
    assert not assign.full()
    rows = assign.flush()
    assert [(r["part"], r["entry"], r["n"], r["total"]) for r in rows] == [(0, 0, 1, [1]), (0, 1, 1, [6]), (1, 0, 1, [2]), (1, 1, 1, [6]), (2, 1, 2, [9]), (3, 1, 2, [10])]
    assert assign.flush() == []
