"""The pipeline stage by stage against plain versions."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import language_id, source_mix
from corpusmill.sources.tables import materialise, read_table
from tests.helpers import SMALL
from tests.llm.common import near_components, odd_docs


def test_stages(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "source_mix", "best_fit_packing"]

    before = docs.collect()
    one = materialise(stages["language_id"](spark, docs, SMALL))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in before if language_id.has_letter(r.text or "")}

    two = materialise(stages["exact_dedup"](spark, one, SMALL))
    best = {}
    for r in one.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(best.values())

    three = materialise(stages["near_dedup"](spark, two, SMALL))
    groups = near_components([(r.doc_id, r.text) for r in two.collect()])
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {d for d, (_, c) in groups.items() if c == d}

    four = materialise(stages["source_mix"](spark, three, SMALL))
    copies = {r.doc_id: r.copies for r in source_mix.mix_sources(three).collect()}
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == Counter({d: n for d, n in copies.items() if n})

    five = stages["best_fit_packing"](spark, four, SMALL).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == Counter(r.doc_id for r in four.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_documents(spark):
    docs = odd_docs(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.columns == docs.columns
            docs = materialise(out)
    assert out.count() > 0
    empty = odd_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_language_stage_rejects_other_languages(spark):
    docs = read_table(spark, SMALL, "documents")
    first = docs.where("length(text) > 100").first().asDict()
    other = ["Я помню чудное мгновенье передо мной явилась ты как мимолётное виденье как гений чистой красоты", "这是一个关于语言识别的比较长的测试文本，它不属于任何已经学过的语言，应当被拒绝。", "これは日本語で書かれた、学習されていない言語の文章ですから、残りません。"]
    mixed = docs.union(spark.createDataFrame([tuple((first | {"doc_id": 10**6 + i, "text": t, "lang": None}).values()) for i, t in enumerate(other)], docs.schema))
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, mixed, SMALL)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if language_id.has_letter(r.text or "")}


def test_language_stage_without_labels(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(r.text for r in docs.collect() if language_id.has_letter(r.text or ""))
    none = language_id.Samples((), ())
    assert language_id.keep_identified(docs, none, languages=("en",)).count() == 0
