"""What near-duplicate detection shuffles, and its ways beyond the bounds of broadcasts."""

import random

from corpusmill.llm import near_dup
from tests.llm.common import near_components


def written(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def some_docs(rng, n):
    return [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(60))) for i in range(n)]


def test_signatures_of_unlike_texts_are_not_shuffled(spark):
    docs = some_docs(random.Random(7), 2000)
    docs += [(5000 + i, t.rsplit(" ", 1)[0] + f" x{i}") for i, (_, t) in enumerate(docs[:5])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    frame.count()
    before = written(spark)
    rows = near_dup.near_duplicates(frame).collect()
    assert written(spark) - before < 2 * 4 * near_dup.SLOTS * len(docs)  # less than two signatures each: 32 band keys, fingerprints and digests; no signature
    assert {r.doc_id: r.component_id for r in rows} == {d: d - 5000 if d >= 5000 else d for d, _ in docs}


def test_beyond_the_bounds_of_broadcasts(spark, monkeypatch):
    rng = random.Random(8)
    docs = some_docs(rng, 40)
    docs += [(100 + i, " ".join(w if rng.random() > 0.02 else "x" for w in docs[i % 10][1].split())) for i in range(40)]
    want = near_components(docs)
    rows = docs + rng.sample(docs, 20) + docs[:3]  # rows that share an id and a text
    for name in ("FEW_IDS", "FEW_GROUPS"):
        monkeypatch.setattr(near_dup, name, 0)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
