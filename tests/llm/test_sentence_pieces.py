"""Encoding and decoding against the library."""

import hashlib

import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from corpusmill.llm import registry, sentence_pieces
from corpusmill.sources.tables import read_table
from tests.helpers import SMALL
from tests.llm.common import LONG, ODD, odd_docs

PROTO = sentencepiece_model_pb2.ModelProto()
with open(sentence_pieces.model_path(), "rb") as f:
    PROTO.ParseFromString(f.read())


def variant(rule="", squeeze=False, prefix=True, byte_fallback=True):
    """The public model with other rules of normalisation, and with or without byte pieces."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.CopyFrom(PROTO)
    if rule:
        made = sentencepiece_model_pb2.ModelProto()
        made.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    if not byte_fallback:
        proto.trainer_spec.byte_fallback = False
        kept = [p for p in proto.pieces if p.type != sentence_pieces.BYTE]
        del proto.pieces[:]
        proto.pieces.extend(kept)
    return proto.SerializeToString()


VARIANTS = [variant(), variant("nmt_nfkc", squeeze=True), variant("nmt_nfkc_cf"), variant(squeeze=True, prefix=False), variant("nfkc", byte_fallback=False), variant(prefix=False)]
PAIRS = [(sentence_pieces.Model(v), spm.SentencePieceProcessor(model_proto=v)) for v in VARIANTS]
TEXTS = [
    "", " ", "  ", "Hello world", " two  spaces   here ", "▁sign▁ ▁▁x", "ﬁne Ａ　ｂ ① ½ é ㍿", "你好 😀\U00010ffff", "a\nb\tc\r\n", "x" * 300, "ab" * 200 + " " * 40 + "end", "\x00\x01", "한국어 각", "naïve Straße ÉÀ",
    "    indented\n\n\n        code()", "1234567890 3.14", "<s> <unk> <0x41> </s>", "﻿​­", "ạ́́", "ة ﷺ", " 　 mixed   ",
]


def check(model, library, text):
    raw = text.encode()
    (ids, starts, ends), = model.encode([raw])
    assert ids.tolist() == library.encode(text)
    pieces = library.encode(text, return_type="proto").pieces
    assert [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)] == [(p.begin, p.end) for p in pieces]
    assert model.decode(ids.tolist()).decode() == library.decode(library.encode(text))


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_library(i):
    for text in [*TEXTS, *(t for _, t, *_ in ODD if t and t is not LONG)]:
        check(*PAIRS[i], text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n　ﬁéthe0"), st.characters(exclude_categories=["Cs"])), max_size=90), st.integers(0, len(PAIRS) - 1))
def test_library_on_any_text(text, i):
    check(*PAIRS[i], text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.sampled_from([28705, 259, 231, 190, 163])), max_size=12))
def test_decoding_of_any_ids(ids):
    model, library = PAIRS[0]
    assert model.decode(ids).decode() == library.decode(ids)
    squeezing, its = PAIRS[3]
    assert squeezing.decode(ids).decode() == its.decode(ids)


def test_bytes_that_are_no_text():
    model, library = PAIRS[0]
    raw = b"ab\xff\xe4\xb8 c\xed\xa0\x80\xf0\x9f\x98"
    assert model.encode([raw])[0][0].tolist() == library.encode(raw)


def test_small_cache(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 2)
    model, library = sentence_pieces.Model(VARIANTS[0]), PAIRS[0][1]
    for _ in range(2):
        check(model, library, "one two three one two four one " + "x" * 100)
    assert model.encode([]) == []
    many = model.encode([b"one two", b"", b"one two", b"two"])
    assert [m[0].tolist() for m in many] == [library.encode(t) for t in ("one two", "", "one two", "two")]


def test_other_models_are_refused():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(VARIANTS[0])
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        sentence_pieces.Model(proto.SerializeToString())


def test_odd_documents(spark):
    library, docs = PAIRS[0][1], odd_docs(spark)
    coded = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    assert len(coded) == len(ODD)
    got = sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in coded)
    want = [(d or -1, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t, *_ in ODD]
    assert got == sorted(want)
    at_once = sentence_pieces.encode(docs, decoded=True).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in at_once) == got
    assert sentence_pieces.decode(sentence_pieces.encode(docs.limit(0))).count() == 0
    nulls = spark.createDataFrame([(None, 1, "x"), ([450], 2, "y")], "ids array<int>, doc_id int, decoded string")
    assert sorted((r.doc_id, r.decoded) for r in sentence_pieces.decode(nulls).collect()) == [(1, ""), (2, library.decode([450]))]


def test_query(spark):
    library = PAIRS[0][1]
    text = {r.doc_id: r.text or "" for r in read_table(spark, SMALL, "documents", "doc_id", "text").collect()}
    rows = registry.QUERIES["op11_sentence_pieces"](spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r.doc_id])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
