"""Each operator on odd documents, against SQL or against a plain version."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import components, exact_dup, html_text, language_id, license_scan, near_dup, packing, quality_cnn, registry, source_mix, url_filter, vector_topk
from corpusmill.sources.tables import read_table
from tests.helpers import SMALL, assert_matches
from tests.llm.common import LONG, ODD, ascii_lower, near_components, odd_docs


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    assert_matches(registry.QUERIES[name](spark, SMALL), registry.SQL[name])


# 1. URL filters


def test_urls(spark):
    urls = ["http://CASINO.example.org/x?y#z", "https://a.net/", "https://a.net", "http://b.example.net/en/1", "http://example.com/de/?q", "http://x.org/fr/cheap-pills", "no scheme", None, "", "http://h/cheap/cheap", "http://h/cheap-pills", "http://h/casinos1", "a://" + "x" * 100_000, "://"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id int, url string, host int")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    want = [("casino.example.org", "/x", None, "block"), ("a.net", "/", "net/", "block"), ("a.net", "", None, "allow"), ("b.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/cheap-pills", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "/cheap/cheap", None, "allow"), ("h", "/cheap-pills", None, "block"), ("h", "/casinos1", None, "allow"), ("x" * 100_000, "", None, "allow"), ("", "", None, "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_forms_of_a_term_are_one_hit(spark):
    urls = ["http://h/deal/deals", "http://h/deals/ads", "http://h/casino-casinos", "http://h/ads-ad-ads", "http://h/deal/deals/promo"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft, r.score) for r in url_filter.filter_urls(df).collect()}
    assert got == {0: ("allow", 0, 1, 0.5), 1: ("block", 0, 2, 1.0), 2: ("block", 1, 0, 1.0), 3: ("allow", 0, 1, 0.5), 4: ("block", 0, 2, 1.0)}


# 2. Quality network


def test_quality(spark):
    good, bad = ["the cat sat on the mat and it was good %d" % i for i in range(60)], ["BUY!!$$$ now$$$ free$$$ %d" % i for i in range(60)]
    model = quality_cnn.fit([t.encode() for t in good + bad], [1] * 60 + [0] * 60, epochs=15)
    docs = odd_docs(spark)
    rows = quality_cnn.score_quality(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    scorer = quality_cnn.Scorer(model)
    assert scorer([b"the dog sat on a rug", b"FREE$$$ buy$$$ !!"]).round().tolist() == [1, 0]
    assert scorer([]).shape == (0,)
    assert quality_cnn.score_quality(docs.limit(0), model).count() == 0


def test_quality_scorer_is_the_network():
    rng = np.random.default_rng(1)
    model = quality_cnn.Model(rng.normal(size=(4, 256, 16)), rng.normal(size=16), rng.normal(size=32), 0.3)
    texts = [b"", b"abc", bytes(rng.integers(1, 256, 2000, dtype=np.uint8)), b"x" * 511, b"y" * 253, b"z" * 252]
    for text, got in zip(texts, quality_cnn.Scorer(model)(texts), strict=True):
        n = ((len(text) + 3) // 256 + 1) * 256
        padded = text + bytes(n - len(text))
        x = np.array([model.biases + sum(model.filters[k][padded[i + k]] for k in range(4)) for i in range(n - 3)])
        chunks = np.array([x[s : s + 512].max(0) for s in range(0, n, 256)])
        shown = np.tanh(np.maximum(chunks, 0))
        p = 1 / (1 + np.exp(-(np.concatenate([shown.mean(0), shown.max(0)]) @ model.weights + model.bias)))
        assert got == pytest.approx(p, abs=1e-4)


def test_quality_held_out(spark):
    rows = registry.QUERIES["op2_quality_cnn"](spark, SMALL).collect()
    label = {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in known]) > 0.9


def test_quality_without_labels():
    assert quality_cnn.Scorer(quality_cnn.fit([], []))([b"x"])[0] == 0.5
    assert quality_cnn.Scorer(quality_cnn.fit([b"x"], [1]))([b"y"])[0] > 0.99


# 3. Mixing


def test_mix_odd(spark):
    rows = source_mix.mix_sources(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
    sizes = {r.source: r.source_size for r in rows}
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(min(1.5, 2) * sum(sizes.values()))
    assert source_mix.mix_sources(odd_docs(spark).limit(0)).count() == 0


def test_mix_reaches_targets_and_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 211), f"s{i % 3}" if i % 2 else "hot") for i in range(3000)], "doc_id long, text string, source string")
    rows = source_mix.mix_sources(docs).collect()
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=3 * 211)
    again = source_mix.mix_sources(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    copies = {r.doc_id: r.copies for r in rows}
    made = source_mix.repeat_rows(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in made} == {d: c for d, c in copies.items() if c}


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in source_mix.targets(sizes).collect()}
    left, cap, weight = 1.5 * 2010, {"a": 20, "b": 2000, "c": 2000, None: 0}, {"a": 5, "b": 2, "c": 1, None: 5}
    done = {}
    while True:  # reshare as stated
        free = [s for s in cap if s not in done]
        share = {s: (left - sum(done.values())) * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            break
        done |= {s: cap[s] for s in over}
    assert got == pytest.approx(done | share)


# 4. License scans


def plain_licenses(text):
    words = license_scan.words(text)
    found = [(i, label) for phrase, label in ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc")) for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    texts = [t for _, t, _, _ in ODD] + ["Licensed UNDER the MIT license, under the mit license; CC-BY-NC cc by nc by nc", "apache license, version 2.0", "apache license version 20", "the mit license", "GNU General Public License v3", "mit " * 50_000 + "under the mit license"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[len(ODD) + 4].labels == "gpl" and got[0].labels == ""
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc x".split()), max_size=40))
def test_licenses_find_every_place(words):
    text = " ".join(words)
    got = license_scan.scan([text], license_scan.TEMPLATES, 3)
    assert tuple(got[k][0] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_licenses(text)


def plain_labels(text):
    """labels and score by definition: every place of every key phrase, every word of its template within two of its place."""
    file, templates = license_scan.words(text), license_scan.TEMPLATES
    wholes = [license_scan.words(t.text or t.key) for t in templates]
    idf = {w: np.log(1 + len(wholes) / sum(w in whole for whole in wholes)) for whole in wholes for w in whole}
    labels, score = set(), 0.0
    for t, whole in zip(templates, wholes, strict=True):
        key = license_scan.words(t.key)
        lead = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for at in range(len(file) - len(key) + 1):
            if file[at : at + len(key)] == key:
                met = sum(idf[w] for i, w in enumerate(whole) if any(file[k] == w for k in range(max(0, at - lead + i - 2), min(len(file), max(0, at - lead + i + 3)))))
                share = met / sum(idf[w] for w in whole) if t.text else 1.0
                if t.base or share >= t.share:
                    labels.add(t.label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_license_labels_match_definition(data):
    parts = []
    for _ in range(data.draw(st.integers(0, 4))):
        t = data.draw(st.sampled_from(license_scan.TEMPLATES))
        words = (t.text or t.key).split()
        for _ in range(data.draw(st.integers(0, 12))):  # edits
            i = data.draw(st.integers(0, len(words) - 1))
            words[i : i + 1] = data.draw(st.sampled_from([[], ["x"], [words[i], "y"]])) or ["z"]
        a = data.draw(st.integers(0, len(words) // 2))
        parts.append(" ".join(words[a:]))
    text = " some words ".join(parts)
    got = license_scan.scan([text], license_scan.TEMPLATES, 3)
    labels, score = plain_labels(text)
    assert got["labels"] == [labels] and got["score"][0] == pytest.approx(min(1.0, score))


def test_license_texts():
    texts = [license_scan.MIT, license_scan.ISC, license_scan.BSD, license_scan.ZLIB, license_scan.GPL, license_scan.MIT[:60], "a word of the permission"]
    assert license_scan.scan(texts, license_scan.TEMPLATES, 3)["labels"] == ["mit", "isc", "bsd", "zlib", "gpl", "", ""]


# 5. Language ID


def plain_phrases(text, sample):
    """Longest matches from end to end, by substring search; a byte that occurs nowhere is a phrase."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_cross_parsing_matches_substring_search():
    rng = random.Random(3)
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7)))
    samples = language_id.Samples(("x", "y"), tuple(" ".join(word(a) for _ in range(600)).encode() for a in ("abcde", "cdefg")))
    texts = [" ".join(word("abcdefgh") for _ in range(n)).encode() for n in (1, 5, 80, 300, 900)] + [b"a", b"", b"\xc3\xa9", b"h" * 600]
    texts += [samples.texts[0], samples.texts[1][300:1500], b"h" + samples.texts[0][5:1200] + b"hh" + samples.texts[1] + b"h", samples.texts[0][100:900] * 3]  # phrases of many blocks
    got = language_id.Parser(samples).phrases(texts)
    assert got.tolist() == [[plain_phrases(t, s) for s in samples.texts] for t in texts]
    assert [language_id.Parser(samples).phrases([t]).tolist()[0] for t in texts] == got.tolist()


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=900), st.binary(min_size=1, max_size=700), st.integers(1, 3))
def test_cross_parsing_of_any_bytes(text, sample, bits):
    few = lambda b: bytes(x & (1 << bits) - 1 for x in b)
    samples = language_id.Samples(("x",), (few(sample),))
    assert language_id.Parser(samples).phrases([few(text), few(sample + text)]).tolist() == [[plain_phrases(few(t), few(sample))] for t in (text, sample + text)]


def test_language_odd(spark):
    samples = language_id.Samples(("en", "fr"), (b"the quick brown fox and the lazy dog", b"le renard brun et le chien des rues"))
    rows = language_id.identify(odd_docs(spark), samples, keep=(F.col("size"),)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.lang_pred for r in rows}
    assert by_id[1] == "en" and by_id[3] == by_id[4] == by_id[6] == "und"
    kept = language_id.keep_identified(odd_docs(spark), samples)
    assert kept.columns == odd_docs(spark).columns and {3, 4, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language_id.predict(["abc"], language_id.Samples((), ())) == {"lang_pred": ["und"], "score": [0.0], "known": [False]}
    assert language_id.draw_samples(odd_docs(spark).limit(0)) == language_id.Samples((), ())


def test_language_sample_of_a_tiny_language(spark):
    docs = read_table(spark, SMALL, "documents").where("length(text) > 200 AND doc_id % 2 = 0").select("doc_id", "text", "lang")
    alone = language_id.draw_samples(docs)
    made = [(10**6, "ok", "tiny"), *((10**6 + i, t, "thin") for i, t in enumerate(["Zvorimal quexta brindole?", *[None, "", " 12 \n"] * 200], 1)), (2 * 10**6, "7 " * 5000 + "Plumbik trefo", "late")]
    mixed = language_id.draw_samples(docs.union(spark.createDataFrame(made, docs.schema)))
    got = dict(zip(mixed.langs, mixed.texts, strict=True))
    assert {k: got[k] for k in alone.langs} == dict(zip(alone.langs, alone.texts, strict=True))
    assert got["tiny"] == b"ok" and b"quexta" in got["thin"] and b"plumbik" in got["late"]
    texts = [r.text for r in docs.limit(50).collect()]
    assert language_id.predict(texts, mixed)["lang_pred"] == language_id.predict(texts, alone)["lang_pred"]
    assert language_id.predict(["zvorimal quexta brindole", "plumbik trefo"], mixed)["lang_pred"] == ["thin", "late"]


def test_language_sample_is_of_whole_rows(spark):
    texts = [" ".join([f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzuvwx'[i // 100]}word"] * (100 if i % 2 else 1000)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    samples = language_id.draw_samples(docs)
    assert sum(samples.texts[0].count(t.encode()) for t in set(texts[1::2])) == language_id.ROWS


def test_language_sample_rows():
    assert language_id._rows_each([[2] * 24, [1000] * 24]) == language_id.ROWS
    assert language_id._rows_each([[1000] * 24] * 40) == 6
    assert language_id._rows_each([[1000] * 24] * 4000) == 1


def test_language_unknown_texts():
    rng = random.Random(2)
    english = "the quick brown fox jumps over the lazy dog and runs away from all of them to be alone with what it has found there " * 4
    samples = language_id.Samples(("en",), (language_id.normalise(english),))
    foreign = ["Я помню чудное мгновенье передо мной явилась ты как мимолётное виденье", "这是一个关于语言识别的比较长的测试文本，它不属于任何已经学过的语言。", "".join(rng.choice("zqxjkvwp") for _ in range(300))]
    assert language_id.predict(foreign, samples)["known"] == [False] * 3
    assert language_id.predict(["the dog", "a", "over there and then all of it was found", "The Lazy FOX!!! 123 456 789"], samples)["known"] == [True] * 4


def test_language_held_out(spark):
    rows = registry.QUERIES["op5_language_id"](spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in read_table(spark, SMALL, "documents").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.95


# 6. Packing


def test_packing_odd(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    docs = odd_docs(spark)
    rows = packing.pack(docs).collect()
    pieces = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc_id, text, _, _ in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(-1 if doc_id is None else doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert pieces == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = _tokenizers.setdefault(path, Tokenizer.from_file(path))
    tokenizer.encode_special_tokens = True
    got = packing.encoder(path)(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tokenizer.encode(text, add_special_tokens=False).ids


_tokenizers: dict = {}


def plain_best_fit(lengths, capacity, open_bins):
    """Bin and offset of each length, by looking through all open bins."""
    free, out, made = [], [], 0  # (room, bin), the last one closed or used first
    for n in lengths:
        fitting = [b for b in free if b[0] >= n]
        if fitting:
            room = min(r for r, _ in fitting)
            bin_ = next(b for b in reversed(free) if b[0] == room)
            free.remove(bin_)
        else:
            if len(free) >= open_bins:
                room = min(r for r, _ in free)
                free.remove(next(b for b in reversed(free) if b[0] == room))
            bin_, made = (capacity, made), made + 1
        out.append((bin_[1], capacity - bin_[0]))
        if bin_[0] > n:
            free.append((bin_[0] - n, bin_[1]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_packer_is_best_fit(lengths, open_bins):
    packer = packing.Packer(20, open_bins)
    assert [packer.place(n) for n in lengths] == plain_best_fit(lengths, 20, open_bins)


def test_encoder_of_any_vocabulary(tmp_path):
    import json

    from tokenizers import Tokenizer

    text = "Some words, and  more\n\n words <|endoftext|> naïve 你好 😀 1234 \u2028 it's"
    file = json.loads(open(packing.tokenizer_path(), encoding="utf-8").read())
    assert packing.ranked_vocabulary(file, lambda t: [t]) is not None
    file["model"]["merges"][300:302] = file["model"]["merges"][301:299:-1]  # ids don't follow the merges
    assert packing.ranked_vocabulary(file, lambda t: [t]) is None
    (tmp_path / "t.json").write_text(json.dumps(file), encoding="utf-8")
    tokenizer = Tokenizer.from_file(str(tmp_path / "t.json"))
    tokenizer.encode_special_tokens = True
    got = packing.make_encoder(str(tmp_path / "t.json"))(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    for r in read_table(spark, SMALL, "documents").collect():
        got = packing.encoder(packing.tokenizer_path())(r.text or "")
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_packer_fills():
    rng = random.Random(1)
    lengths = [min(2048, int(rng.expovariate(1 / 600)) + 1) for _ in range(5000)]
    packer = packing.Packer(open_bins=256)
    used = {}
    for n in lengths:
        b, offset = packer.place(n)
        assert offset == used.get(b, 0) and offset + n <= 2048
        used[b] = offset + n
    assert len(used) < 1.05 * sum(lengths) / 2048


# 7. Near duplicates


def test_near_odd(spark):
    docs = odd_docs(spark)
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    want = near_components([(d, t) for d, t, _, _ in ODD if d is not None])
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, None, 5, 6, 7, 8, 10}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_ids_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:58] + ["x"])), (3, " ".join(other[:58] + ["y"])), (3, " \t"), (4, " ".join(words[:57] + ["z"])), (5, "lone text"), (5, "another one"), (5, "lone text"), (6, "Lone  TEXT"), (7, None), (8, "  ")]
    sets = near_components_of_rows(rows)
    for n in (1, 5):
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "text")).collect()
        assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(d, sets[d], sets[d] == d) for d, _ in rows} and len(got) == len(rows)
    assert sets == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8}


def near_components_of_rows(rows):
    """Smallest reachable id of each id, where an id may have several texts."""
    found = near_components([(i, t) for i, (_, t) in enumerate(rows)])
    sets = components.UnionFind()
    for i, (d, _) in enumerate(rows):
        sets.join(("id", d), ("row", i))
        sets.join(("row", i), ("row", found[i][1]))
    members = {}
    for d, _ in rows:
        members.setdefault(sets.find(("id", d)), []).append(d)
    return {d: min(members[sets.find(("id", d))]) for d, _ in rows}


def test_near_hot_lead(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SPREAD", 8)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    docs = [(i, " ".join(base[:k] + [f"u{i}"] + base[k + 1 :])) for i in range(200) for k in [rng.randrange(120)]]
    docs += [(1000 + i, "  ".join(base).upper() + " " * i) for i in range(60)]
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_components(docs)


def test_near_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SMALL, "documents").collect()]
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    for i in range(150):  # a chain of edits: neighbours are near, ends aren't
        base[rng.randrange(120)] = f"n{i}"
        docs.append((10_000 + i, " ".join(base)))
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_components(docs)


def plain_superminhash(elements):
    best = [None] * near_dup.SLOTS
    for e in elements:
        order = list(range(near_dup.SLOTS))
        for j in range(near_dup.SLOTS):
            value, k = near_dup._draws(np.array([e], np.uint64), j)
            order[j], order[int(k[0])] = order[int(k[0])], order[j]
            v = int(value[0])
            if best[order[j]] is None or v < best[order[j]]:
                best[order[j]] = v
    return [((v & 0xFFFFFFFF) ^ ((v >> 32) * 0x9E3779B1)) & 0xFFFFFFFF for v in best]


def test_superminhash_by_rounds_is_the_sequential_one():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 30, 300, 1500)]
    got = near_dup.signatures(sets)
    assert got.tolist() == [plain_superminhash(s) for s in sets]


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500)]
    sets = components.UnionFind()
    for a, b in links:
        sets.join(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x in list(sets.up) if (r := sets.find(x)) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8. Exact duplicates


def test_exact_odd(spark):
    docs = odd_docs(spark)
    rows = exact_dup.exact_duplicates(docs).collect()
    groups = {}
    for d, t, _, _ in ODD:
        groups.setdefault(t or "", []).append(d)
    assert len(rows) == len(ODD)
    keep = {max(ids, key=lambda d: -1 if d is None else d): len(ids) for ids in groups.values()}
    assert sorted((r.keep_id, r.group_size) for r in rows if r.kept and r.keep_id is not None) == sorted((k, n) for k, n in keep.items() if k is not None)
    assert sum(r.kept for r in rows) == len(groups)
    left = exact_dup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dup.exact_duplicates(docs.limit(0)).count() == 0 and exact_dup.drop_exact_duplicates(docs.limit(0)).count() == 0


# 9. HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site name, and a long line about it.</p></header>
<nav><a href=x>Home</a></nav><div id="cookie-notice"><p>We use cookies to improve your experience on this site. By continuing you agree.</p></div>
<article><h1>A   title</h1><p>First &amp; long paragraph,<br>with a <b>bold</b> word &lt;here&gt; a < b.<div class="ad"><p>Buy the best thing that you have ever seen, now and cheap.</p></div><p>Short.</p><ul><li>one</li></ul>
<section class="comments"><p>I liked this article a lot, thanks for writing it down!</p></section></article><aside><p>Sidebar text, which is rather long. Really.</p></aside>
<form><label>Mail</label><p>Enter your mail address here to get our news every week.</p></form><script>var t="</p>";</script><footer>&copy; x</footer>"""


def test_html(spark):
    pages = [PAGE, "", None, "<p>cut off <b", "<!-- open", "<script>x", "plain words without any mark at all, but with an end.", "<article><p>" + LONG + "</p></article>"]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(pages)], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert got[0].text == "A title\nFirst & long paragraph, with a bold word <here> a < b.\nShort.\none"
    assert [got[i].text for i in (1, 2, 4, 5)] == ["", "", "", ""]
    assert got[6].text == pages[6] and got[7].text == LONG and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("before, after", [
    ('<article class="post type-post tag-login category-social tag-privacy-alert">', "</article>"),
    ('<article id="share" class="promoted">', "</article>"),
    ('<main class="with-comments"><article class="post tag-login">', "</article></main>"),
    ('<div class="content has-sidebar"><article>', "</article></div>"),
    ('<div class="with-comments">', "</div>"),
    ('<div id="widget"><main>', "</main></div>"),
    ('<main><div class="social"><article>', "</article></div></main>"),
])
def test_html_names_of_articles(before, after):
    words = "Thirty words of a story that goes on for a while and then comes to its end, as stories do, with a full stop after the very last of these words here."
    away = '<div class="sidebar-left"><p>Buy the best thing that you have ever seen, now and cheap.</p></div><div class="comments"><article class="comment"><p>Nice one, thanks for it.</p></article></div>'
    assert html_text.main_text(f"<body>{before}<p>{words}</p>{after}</body>") == words
    assert html_text.main_text(f"<body><article><p>{words}</p></article>{away}</body>") == words
    assert html_text.main_text(f"<body><article><p>{words}</p><article class='comment'><p>Nice one, thanks.</p></article></article></body>") == words


def test_html_keeps_formulas_and_fallbacks():
    a, b = "The first paragraph of a page, with a few more words than that.", "And a second one, which comes after it and has words too."
    page = lambda inner: html_text.main_text(f"<article><p>{a}</p>{inner}<p>{b}</p></article>")
    assert page("<p>Now let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold here.</p>") == f"{a}\nNow let x=1 hold here.\n{b}"
    assert "A chart of sales by year." in page("<p>See <object data=x>A chart of sales by year.</object> for the long run of them.</p>")
    for name in ("math", "object", "canvas", "audio", "video", "svg", "select", "datalist"):
        text = page(f"<div><{name}></div>")  # not closed
        assert text.startswith(a) and text.endswith(b)
        text = page(f"<{name}>")
        assert text.startswith(a) and text.endswith(b)
        assert page(f"<{name} class=x></{name}>") == f"{a}\n{b}"
    text = page("<p>Choose one <select><option>Red<option>Green</select> of these colours, please.</p>")
    assert "Choose one" in text and "of these colours, please." in text and "Green" not in text
    assert page("<select><optgroup><option>Red</optgroup><option>Green") == f"{a}\n{b}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=7), st.data())
def test_minimum_cut(scores, data):
    n = len(scores)
    edges = [(i, j, float(data.draw(st.integers(0, 3)))) for i in range(n) for j in range(i + 1, n)]
    cost = lambda side: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])
    best = min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))
    assert cost(html_text.minimum_cut([float(s) for s in scores], edges)) == pytest.approx(best)


def test_html_cut_mends_the_classifier():
    rng = random.Random(77)
    wrong = by_classifier = changed = total = 0
    for _ in range(200):
        html, label = html_text.made_page(rng)
        blocks = html_text.blocks_of(html)
        odds, kept = html_text.label_blocks(blocks, html_text.learn())
        for b, x, k in zip(blocks, odds, kept, strict=True):
            total += 1
            wrong += k != label[b.text]
            by_classifier += (x > 0) != label[b.text]
            changed += (x > 0) != k
    assert wrong < 0.06 * total and wrong < by_classifier and changed > 0.005 * total


def test_html_learned_edges_and_weights():
    learned = html_text.learn(50)
    assert learned == html_text.learn.__wrapped__(50) and min(learned.edges) >= 0 and learned.edges[0] > learned.edges[3]


def test_html_without_article():
    a = "The first paragraph of a page that has no article element, with a good number of words in it, and that mentions cookies."
    b = "A second paragraph, which goes on for a while as well, so that it can't be taken for a menu or anything like that."
    menu = "<div><a href=x>Home</a></div><div><a href=y>About us</a></div>"
    assert html_text.main_text(f"<body>{menu}<div><p>{a}</p><p>Short one.</p><p>{b}</p></div><div class='footer'>All rights reserved</div></body>") == f"{a}\nShort one.\n{b}"
    assert html_text.main_text(f"<body><div><div>{a}</div><div>No end here</div><div>{b}</div></div></body>") == f"{a}\nNo end here\n{b}"
    assert html_text.main_text(f"<body><article class='cookie-notice'><p>{a}</p><p>{b}</p></article></body>") == f"{a}\n{b}"


def test_html_on_table(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in read_table(spark, SMALL, "pages").collect()}
    for r in registry.QUERIES["op9_html_text"](spark, SMALL).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)


# 10. Top-k


def plain_top(rows, every, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = set(), set()
    for i, v in good:
        if i % every == 0 and i not in asked:
            asked.add(i)
            found = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v)))[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    return out


def test_topk_odd(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(300)]
    rows += [(50, None), (51, [1.0, None, 0, 0, 0, 0]), (52, [float("nan")] * 6), (None, [1.0] * 6), (53, []), (2050, [1.0, 2.0]), (2051, [3.0, 1.0]), (2100, [1e6] * 6), (2101, [float("inf")] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 50 or v is None]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {tuple(r) for r in vector_topk.top_k(df, shard_rows=64, block_rows=4).collect()}
    assert got == plain_top(rows, 50, 5)
    assert vector_topk.top_k(df.limit(0)).count() == 0


def test_topk_of_repeated_query_ids(spark):
    rng = random.Random(5)
    rows = [(i % 60, [float(np.float32(rng.uniform(-1, 1))) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_top(sorted(rows, key=lambda r: r[1]), 50, 5)  # the smallest vector of an id asks
    for parts in (1, 5):
        assert {tuple(r) for r in vector_topk.top_k(df.repartition(parts), shard_rows=16).collect()} == want


# All


def test_words_are_lowered_in_ascii_only():
    assert license_scan.words("ÀB") == ["Àb".encode()] and ascii_lower("ÀB") == "Àb"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    key = "pages" if name.startswith("op9") else "documents"
    n = read_table(spark, SMALL, key).count()
    assert registry.QUERIES[name](spark, SMALL).count() >= n


def test_texts_that_no_sample_holds_do_not_go_to_the_shortest_sample(spark):
    docs = read_table(spark, SMALL, "documents").where("length(text) > 200").select("doc_id", "text", "lang")
    made = [(10**6, "ok hey", "aa"), (10**6 + 1, "ok hey", "xx")]
    mixed = language_id.draw_samples(docs.union(spark.createDataFrame(made, docs.schema)))
    foreign = ["Я помню чудное мгновенье", "Όλοι οι άνθρωποι", "これは日本語の文です", "Zażółć gęślą jaźń", "x", "Qwrtz plmk vbnxz"]
    assert not {"aa", "xx"} & set(language_id.predict(foreign, mixed)["lang_pred"])
    assert language_id.predict(["ok hey"], mixed)["lang_pred"] == ["aa"]


def test_language_samples_of_long_rows_are_whole(spark):
    rows = [(i, f"{'word%s ' % chr(97 + i)}" * 700, "en") for i in range(3)]
    samples = language_id.draw_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=1)
    assert len(samples.texts[0]) == len(language_id.normalise(rows[0][1]))


def test_quality_sample_is_of_usable_rows_whole(spark):
    """Long texts count whole, and rows without a text take no place in the sample."""
    good, bad = "the cat sat on the mat and it was good " * 500, "BUY!!$$$ now$$$ free$$$ " * 800
    rows = [(i, None if i % 3 else (good if i % 2 else bad), 1) for i in range(300)] + [(None, good, 1), (3, good + "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality_cnn.fit_on(docs, labels, rows=40)
    assert quality_cnn.Scorer(model)([good.encode(), bad.encode()]).round().tolist() == [1, 0]
    assert quality_cnn.Scorer(quality_cnn.fit_on(docs.where("text IS NULL"), labels))([b"x"])[0] == 0.5


def test_quality_gradients():
    """Against differences of the loss, over texts of several chunks."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (3, 300, 1400)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.6, 0.7])
    model = [rng.normal(0, 0.3, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)), rng.normal(0, 0.1, quality_cnn.FILTERS), rng.normal(0, 0.3, 2 * quality_cnn.FILTERS), np.zeros(1)]
    loss, grads = quality_cnn.gradients(model, texts, y, weight)
    for m, g in zip(model, grads, strict=True):
        for at in sorted({int(np.abs(g).argmax()), *rng.integers(0, m.size, 5).tolist()}):
            kept, step = m.flat[at], 1e-5
            m.flat[at] = kept + step
            more = quality_cnn.gradients(model, texts, y, weight)[0]
            m.flat[at] = kept - step
            less = quality_cnn.gradients(model, texts, y, weight)[0]
            m.flat[at] = kept
            assert g.flat[at] == pytest.approx((more - less) / (2 * step), abs=1e-6)


def test_quality_blocks_are_convolved_a_few_at_a_time(monkeypatch):
    texts, labels = [b"ab" * 900, b"cd" * 700, b"a", b""] * 3, [1, 0, 1, 0] * 3
    whole = quality_cnn.fit(texts, labels, least_steps=3, epochs=2)
    monkeypatch.setattr(quality_cnn, "FIT_SPAN", 2)
    parts = quality_cnn.fit(texts, labels, least_steps=3, epochs=2)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


STORY = "This is a paragraph of thirty-two words that goes on for quite a while, as paragraphs of articles do, and that ends, after some more of the words, with a full stop."


@pytest.mark.parametrize(("page", "lines"), [
    ("<article><h1>Head</h1><p class='byline'>By Ann Lee</p><p>{}</p></article>", ["Head", "By Ann Lee", STORY]),
    ("<article><h1>Head</h1><h2>Sub head</h2><p class='byline'>By Ann Lee</p><p>{}</p></article>", ["Head", "Sub head", "By Ann Lee", STORY]),
    ("<article><p>{}</p><ul><li><a>First source</a></li><li><a>Second source</a></li></ul><p>{}</p></article>", [STORY, "First source", "Second source", STORY]),
    ("<article><table><tr><td>1</td><td>2.5</td></tr><tr><td>3</td><td>4</td></tr></table><p>{}</p></article>", ["1", "2.5", "3", "4", STORY]),
    ("<article><p>{}</p><div class='search-history'><p>{}</p></div></article>", [STORY, STORY]),
    ("<article><p>{}</p><section id='form-of-the-river'><p>{}</p></section></article>", [STORY, STORY]),
    ("<div class='related-work'><h1>Related work</h1><p>{}</p><p>{}</p></div>", ["Related work", STORY, STORY]),
    ("<div id='notice'><h1>Notice</h1><p>{}</p><p>{}</p></div>", ["Notice", STORY, STORY]),
    ("<html><head><title>Open<body><article><h1>Head</h1><p>{}</p></article>", ["Head", STORY]),
    ("<article><p>{}</p><noscript><p>{}</p></noscript></article>", [STORY, STORY]),
    ("<article><h1>Head</h1><div class='ad'>Buy now and cheap.</div><p>{}</p></article>", ["Head", STORY]),
    ("<article><p>{}</p><div class='ad-box'><p>{}</p></div><div class='comment-list'><p>{}</p></div></article>", [STORY]),
])
def test_html_of_articles(page, lines):
    assert html_text.main_text(page.replace("{}", STORY)) == "\n".join(lines)


@pytest.mark.parametrize(("text", "labels"), [
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("Creative Commons Attribution, and Creative Commons Attribution NonCommercial", "cc-by,cc-by-nc"),
    ("All rights reserved", ""),
    ("Copyright X. All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.", "proprietary"),
    ("not gnu general public license compatible", ""),
    ("this isn't it; GNU General Public License", "gpl"),
    ("not under the MIT license", "mit"),
])
def test_license_phrases_in_their_surroundings(text, labels):
    assert license_scan.scan([text], license_scan.TEMPLATES, 3)["labels"] == [labels]


def test_top_k_goes_to_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    vectors = [(i, (centres[i % 30] / np.linalg.norm(centres[i % 30]) + rng.normal(0, 0.02, 12)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vector_topk.top_k(df, shard_rows=50).collect()} == plain_top(vectors, 50, 5)
    rows = df.selectExpr("vec_id AS id", "embedding AS vec", "vec_id AS row")
    _, cells = vector_topk._deal(rows, 1500, 50, 256)
    assert len(cells[12][0]) >= 15
    # The kth score of the best cell leaves few of the others.
    asks = df.where("vec_id % 50 = 0").selectExpr("size(embedding) AS dim", "vec_id AS ask", "embedding AS vec", "60000L AS score", "0L AS kth")
    went = sum(vector_topk._route(asks, cells, turn, 5, 256).count() for turn in range(3))
    assert 30 <= went < 0.3 * 30 * len(cells[12][0])
