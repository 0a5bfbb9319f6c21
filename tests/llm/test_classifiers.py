"""Language identification and quality: slow versions of the scores, held-out accuracy, odd rows."""

import math
import random
import unicodedata
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import langid, quality
from driftspark.llm import queries as llm
from driftspark.llm.common import held_out

SMALL = "/root/testdata/sf0.01"


def slow_bits(training, text, order):
    """Code length by direct recursion over counted contexts."""
    stream = b"".join(langid.BEFORE + t for t in training)
    follow = {}
    for n in range(order + 1):
        for i in range(n, len(stream)):
            follow.setdefault(stream[i - n : i], Counter())[stream[i]] += 1

    def cost(ctx, s):
        seen = follow.get(ctx)
        lower = (lambda: cost(ctx[1:], s)) if ctx else (lambda: 8.0)
        if not seen:
            return lower()
        total, d = sum(seen.values()), len(seen)
        return -math.log2(seen[s] / (total + d)) if s in seen else -math.log2(d / (total + d)) + lower()

    data, n = langid.BEFORE + text, len(langid.BEFORE)
    return sum(cost(data[i - order : i], data[i]) for i in range(n, len(data)))


@pytest.mark.parametrize("order,chunk", [(5, 1 << 18), (5, 7), (2, 11)])
def test_code_lengths(order, chunk, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(langid, "BEFORE", b"\n" * order)
    rng = random.Random(8)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    sample = [("x", make("abc é", 80)) for _ in range(3)] + [("y", make("bcd. ", 80)) for _ in range(3)] + [("y", b"")]
    model = langid.train(sample, order)
    scorer = langid.Scorer(model)
    texts = [make("abcdé .", n) for n in (0, 1, 2, 3, 40, 0, 7)] + ["日本 zz".encode(), b""]
    got = scorer.bits(texts)
    for t, row in zip(texts, got, strict=True):
        for lang, bits in zip(model.languages, row, strict=True):
            assert bits == pytest.approx(slow_bits([x for k, x in sample if k == lang], t, order), rel=1e-4, abs=1e-3)


def test_models_of_a_bounded_size():
    rng = random.Random(4)
    make = lambda first, n: "".join(chr(first + rng.randrange(3000)) for _ in range(n)).encode()
    sample = [(lang, make(0x4E00 + 3000 * i, 500)) for i, lang in enumerate("xyz") for _ in range(8)]
    whole = langid.train(sample)
    same = langid.bounded(sample, langid.size_of(whole))
    assert all(np.array_equal(a, b) for a, b in zip(same.costs + same.escapes, whole.costs + whole.escapes, strict=True))
    small = langid.bounded(sample, langid.size_of(whole) // 3)
    assert langid.size_of(small) <= langid.size_of(whole) // 3 and small.languages == ["x", "y", "z"]
    texts = [make(0x4E00 + 3000 * i, 40) for i in range(3)]
    assert langid.predict(langid.Scorer(small).bits(texts))[0].tolist() == [0, 1, 2]
    assert langid.size_of(langid.bounded(sample, 0)) < 10_000 and langid.bounded([], 0).languages == []


def test_numbers_of_codes():
    rng = np.random.default_rng(5)
    for found in (rng.integers(0, 1 << 48, 20_000), np.arange(300), np.zeros(0, np.int64), np.array([0])):
        found = np.unique(found)
        wanted = np.concatenate([found, rng.integers(0, 1 << 48, 500), [0, 7]])
        at = {c: i + 1 for i, c in enumerate(found.tolist())}
        assert langid.Numbers(found).find(wanted).tolist() == [at.get(c, 0) for c in wanted.tolist()]


def test_languages_of_odd_rows(spark):
    rows = [(i, w, lang, "x") for i, (w, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 4)]
    odd = [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12 !!", None, "x"), (103, "und die", None, "x"), (103, "und die", None, "x"), (None, "the and", None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(langid.training_sample(docs, F.lit(True)))
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect() if r.doc_id is None or r.doc_id >= 100]
    assert sorted(map(str, got)) == sorted(map(str, [(100, "und"), (101, "und"), (102, "und"), (103, "de"), (103, "de"), (None, "en")]))
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.train(langid.training_sample(docs, F.lit(False)))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert len(langid.training_sample(docs, F.lit(True), n=2)) == 4


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(langid.training_sample(docs, ~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).join(docs, "doc_id").filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_votes_equal_brute_force():
    rng = np.random.default_rng(9)
    rows, labels = rng.random((60, quality.TERMS + 1)).astype(np.float32), rng.integers(0, 2, 60)
    model, asked = quality.train(rows, labels), rng.random((700, quality.TERMS + 1)).astype(np.float32)
    latent = asked @ model.projection
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    cos = latent @ model.vectors.T
    want = []
    for c in cos:
        near = sorted(range(60), key=lambda i: -c[i])[: quality.NEIGHBOURS]
        w = [max(0.0, float(c[i])) ** quality.SHARPNESS for i in near]
        want.append(sum(a * labels[i] for a, i in zip(w, near, strict=True)) / sum(w) if sum(w) else model.prior)
    assert quality.score(model, asked) == pytest.approx(np.array(want), abs=1e-4)


def slow_row(text):
    """Features of a text by counting strings, column by column."""
    mixed = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64 >> 40) % quality.TERMS
    words = text.split()
    shape = lambda w: "".join(k for k, _ in groupby("a" if c.isalpha() and not c.isupper() else "A" if c.isalpha() else "0" if c.isnumeric() else c for c in w))
    plain = ["".join(c for c in w if c.isalnum() or unicodedata.category(c) == "Nd").lower() for w in words]
    crc = [zlib.crc32(w.encode()) if w else None for w in plain]
    blank = "".join(" " if not c.isalnum() else c for c in f" {text} ").lower()
    while "  " in blank:
        blank = blank.replace("  ", " ")
    kinds = (
        [zlib.crc32(shape(w).encode()) % quality.TERMS for w in words],
        [mixed(c) for c in crc if c is not None],
        [mixed(a << 31 ^ b) for a, b in zip(crc, crc[1:]) if a is not None and b is not None],
        [mixed(ord(x) << 42 | ord(y) << 21 | ord(z)) for x, y, z in zip(blank, blank[1:], blank[2:]) if [x, y, z].count(" ") <= 1],
    )
    out = np.zeros(quality.COLUMNS)
    for i, found in enumerate(kinds):
        for column, n in Counter(found).items():
            out[i * quality.TERMS + column] = quality.SHARE[i] * math.sqrt(n / len(found))
    out[quality.REPEAT] = math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1))
    return out


def test_features_equal_a_slow_version():
    rng = random.Random(12)
    texts = ["", " ", "a", "...", "Straße straße, STRASSE!!", "é É 日本語 日本 42 x42-y -- --"] + ["".join(rng.choice("abAB é.-1 日 \n_") for _ in range(rng.randrange(80))) for _ in range(200)]
    got = quality.features(texts, quality._Terms())
    assert got.shape == (len(texts), quality.COLUMNS)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx(slow_row(t), abs=1e-6), t
    assert quality.features([], quality._Terms()).shape == (0, quality.COLUMNS)


def test_axes_of_many_rows_are_those_of_few():
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((1500, 40)) * np.geomspace(1, 1e-3, 40) @ np.linalg.qr(rng.standard_normal((200, 40)))[0].T).astype(np.float32)
    exact = np.linalg.svd(x, full_matrices=False)[2][:10]
    assert np.abs(exact @ quality._axes(x)[:, :10]) == pytest.approx(np.eye(10), abs=2e-2)


def test_training_never_holds_all_columns_of_all_rows():
    import tracemalloc

    rng = np.random.default_rng(8)
    n = 3000
    at = [np.unique(rng.integers(0, quality.COLUMNS, 60)).astype(np.int16) for _ in range(n)]
    rows = quality.Rows([a.tobytes() for a in at], [rng.random(len(a)).astype(np.float32).tobytes() for a in at])
    labels = rng.integers(0, 2, n)
    tracemalloc.start()
    model = quality.train(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * quality.COLUMNS * 4  # one float for each
    few = quality.Rows(rows.at[:300], rows.x[:300])
    one, other = quality.train(few, labels[:300]), quality.train(few[0:300], labels[:300])
    assert quality.score(one, rows[300:400]) == pytest.approx(quality.score(other, rows[300:400]), abs=1e-5)
    assert len(model.vectors) == n and quality.score(model, rows[:50]).std() > 0


def test_noise_scores_apart_from_prose(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    plain, both = (quality.train(*quality.labelled_rows(docs, labels, ~held_out(F.col("doc_id")), with_noise=w)) for w in (False, True))
    assert len(both.labels) > len(plain.labels) and both.prior == pytest.approx(plain.prior)
    held = docs.join(labels.filter("quality = 1"), "doc_id").filter(held_out(F.col("doc_id"))).select("doc_id", "text").collect()
    texts = [r.text for r in held if len(r.text.split()) >= quality.NOISE_WORDS]
    terms = quality._Terms()
    prose = quality.score(both, quality.features(texts, terms))
    noise = quality.score(both, quality.features([quality.noise(t, 5) for t in texts], terms))
    assert (prose > 0.5).mean() > 0.97 and (noise < 0.5).mean() > 0.95 and (noise >= 0.3).mean() > 0.95
    assert sorted(quality.noise("Ab-Cde 12 x", 1).lower()) == sorted("ab-cde 12 x") and quality.noise("", 1) == ""
    one, two = quality.score(both, quality.features(["the cat sat on the mat and looked at the dog in the garden", "zzq xkv qqw vv xxz qpw zzx kkq wvx qqz xxv zzv kqq"], terms))
    assert one > two


def test_equally_near_neighbours_share_the_votes():
    rows = np.zeros((20, quality.TERMS + 1), np.float32)
    rows[:, 0] = 1
    rows[:3, 1], rows[3:, 2] = 1, 0.5  # three alike, seventeen alike
    labels = np.array([1, 1, 1] + [1] * 4 + [0] * 13)
    asked = rows[[0, 5]]
    shuffled = np.random.default_rng(3).permutation(20)
    one, two = (quality.score(quality.train(rows[o], labels[o]), asked) for o in (np.arange(20), shuffled))
    assert one == pytest.approx(two, abs=1e-5) and one[1] == pytest.approx(4 / 17, abs=1e-3)


def test_labels_count_by_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (2, None), (3, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 7), (None, 1)] + [(i, 1) for i in range(100, 400)], "doc_id long, quality int")
    rows, found = quality.labelled_rows(docs, labels, F.lit(True), n=2)
    assert sorted(found) == [0, 1] and len(rows) == 2
    assert len(quality.labelled_rows(docs, labels, F.lit(True), n=1)[0]) == 1


def test_quality_accuracy_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(*quality.labelled_rows(docs, labels, ~held_out(F.col("doc_id"))))
    found = quality.classify(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    assert found.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a" * 9999, "x")], "doc_id long, text string, score string")
    scores = quality.classify(odd, model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    assert quality.classify(odd.limit(0), model).count() == 0
    few = quality.labelled_rows(docs, labels, F.lit(True), n=10)
    assert len(few[0]) <= 10
    nothing = quality.train(*quality.labelled_rows(docs, labels.limit(0), F.lit(True)))
    assert {r.score for r in quality.classify(odd, nothing).collect()} == {0.5}


def test_long_documents_are_learnt_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE_CHARS", 20)
    rows = [(1, "aa", "a short text"), (2, "aa", "a" * 50), (3, "bb", "b" * 20 + "c" * 20 + "é" * 5), (6, "cc", None), (7, "dd", ""), (None, "ee", "e" * 25), (None, "ee", "e" * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = Counter(langid.training_sample(docs, F.lit(True)))
    assert got == Counter({("aa", b"a short text"): 1, ("aa", b"a" * 20): 2, ("aa", b"a" * 10): 1, ("bb", b"b" * 20): 1, ("bb", b"c" * 20): 1, ("bb", "é".encode() * 5): 1, ("dd", b""): 1, ("ee", b"e" * 20): 1, ("ee", b"e" * 5): 1})
    long = spark.createDataFrame([(i, lang, " ".join([word] * 9000)) for i, (lang, word) in enumerate([("de", "und"), ("en", "and"), ("fr", "avec")])], "doc_id long, lang string, text string")
    found = langid.training_sample(long, F.lit(True), n=7)
    assert Counter(lang for lang, _ in found) == {"de": 7, "en": 7, "fr": 7}
    asked = spark.createDataFrame([(1, "and and"), (2, "und und"), (3, "avec avec")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(asked, langid.train(found)).orderBy("doc_id").collect()] == ["en", "de", "fr"]
    monkeypatch.setattr(langid, "MODEL_PIECES", 9 * 3)
    assert len(langid.training_sample(long, F.lit(True))) == 9


def test_the_driver_gets_the_model_only(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    allowed = ~held_out(F.col("doc_id"))
    want = quality.train(*quality.labelled_rows(docs, labels, allowed, with_noise=True))

    def not_here(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(quality, "labelled_rows", not_here)
    got = llm.quality_model(docs, labels)
    assert got.prior == want.prior and (got.labels == want.labels).all()
    texts = [r.text for r in docs.select("text").limit(200).collect()]
    rows = quality.features([t or "" for t in texts], quality._Terms())
    assert quality.score(got, rows) == pytest.approx(quality.score(want, rows), abs=1e-5)
    none = llm.quality_model(docs, labels.limit(0))
    assert none.prior == 0.5 and not len(none.vectors)
