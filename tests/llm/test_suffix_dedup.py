"""Suffix arrays and substring de-duplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from driftspark.llm import suffix_dedup as sd


@pytest.mark.parametrize("letters,n", [("ab", 300), ("abc", 500), ("a", 60), ("abcdefgh", 400), ("zyxa", 1), ("ba", 2)])
def test_suffix_array(letters, n):
    rng = random.Random(n)
    for _ in range(5):
        data = "".join(rng.choice(letters) for _ in range(n)).encode()
        got = sd.suffix_array(np.frombuffer(data, np.uint8), n + 1).tolist()
        assert got == sorted(range(n), key=lambda i: data[i:])


def test_depth_is_enough():
    rng = random.Random(12)
    block = bytes(rng.choice(b"ab") for _ in range(400))
    data = np.frombuffer(block + b"x" + block + b"y" + block, np.uint8)
    sa = sd.suffix_array(data, 100)
    raw = data.tobytes()
    assert [raw[i : i + 100] for i in sa.tolist()] == sorted(raw[i : i + 100] for i in range(len(raw)))
    same = sd.reaches(data, sa, 100)
    want = [False] + [len(raw[a : a + 100]) == 100 and raw[a : a + 100] == raw[b : b + 100] for a, b in zip(sa[1:].tolist(), sa.tolist(), strict=False)]
    assert same.tolist() == want


def place(key, text, i):
    """Rows without an id come last, each text for itself in the order of its hash."""
    signed = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return (1, 0, signed - (signed >> 63 << 64), i) if key is None else (0, key, 0, i)


def brute(rows, length):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            first[w] = min(first.get(w, place(key, text, i)), place(key, text, i))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] != place(key, text, i):
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((str(key), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 150, 0])
def test_equals_brute_force(spark, shard_bytes):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(8), text(12), "license line that all share, word by word, again"]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 12)), rng.choice(shared), text(rng.randrange(0, 6)), rng.choice(shared) if i % 3 else ""]
        rows.append((200 - 3 * i, "".join(parts)))
    rows += [(500, "a" * 200), (501, "ab" * 90), (502, "ab" * 90), (7, None), (8, ""), (503, "x" * 40), (504, "x" * 39), (None, rows[3][1]), (505, rows[5][1]), (505, rows[5][1])]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digests(docs, length=40, gram=12, shard_bytes=shard_bytes).collect())
    assert got == brute(rows, 40)


def test_settled():
    rng = np.random.default_rng(15)
    doc, row, key, whole, start = (rng.integers(0, n, 600) for n in (6, 3, 4, 3, 8))
    doc = np.where(doc == 5, sd.LAST, doc)
    later, again = sd.settled(doc, row, key, whole, start)
    of = lambda i: (doc[i], row[i] if doc[i] == sd.LAST else 0, start[i])
    rows = list(zip(key, whole, doc, row, start, strict=True))
    for i in range(600):
        assert later[i] == (of(i) != min(of(j) for j in range(600) if (key[j], whole[j]) == (key[i], whole[i])))
    assert sum(~again) == len(set(rows)) and {r for r, x in zip(rows, again, strict=True) if not x} == set(rows)
    assert not len(sd.settled(*[np.zeros(0, np.int64)] * 5)[0])


def test_spans():
    rng = np.random.default_rng(17)
    for _ in range(200):
        runs = np.stack([rng.integers(0, 50, n := rng.integers(0, 6)), rng.integers(1, 9, n)], axis=1)
        mask = np.zeros(70, bool)
        for a, k in runs:
            mask[a : a + k + 9] = True
        spans = sd.covered(70, runs, 10)
        again = np.zeros(70, bool)
        for a, b in spans:
            again[a:b] = True
        assert (again == mask).all() and len(spans) == int((mask[1:] & ~mask[:-1]).sum()) + int(mask[0])


def test_rows_without_own_ids_and_ids_of_any_type(spark):
    rng = random.Random(18)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = [text(60), text(45)]
    keys = [None, None, None, None, 3, 3, 3, 3, 5, -4, 9, None]
    rows = [(k, text(30) + rng.choice(shared) + text(40)) for k in keys]
    rows[3] = rows[2]
    rows[6] = (3, rows[5][1][7:] + text(7))  # equal length, moved by 7 bytes
    rows[7] = (3, text(len(rows[5][1])))
    rows += [(None, None), (None, ""), (3, None), (3, None), (None, text(400)), (None, text(400))]
    lonely = [i for i in (7, len(rows) - 1, len(rows) - 2)]
    for kind, given in (("long", rows), ("string", [(None if k is None else f"id{k + 10:03}", t) for k, t in rows])):
        docs = spark.createDataFrame(given, f"doc_id {kind}, text string").repartition(4)
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digests(docs, length=40, gram=12).collect())
        assert got == brute(given, 40) and len(got) == len(rows)
        kept = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sd.remove_repeats(docs, length=40, gram=12).collect())
        assert kept == got
    whole = {hashlib.sha256(rows[i][1].encode()).hexdigest() for i in lonely}
    assert whole <= {r[4] for r in got}


def test_long_texts_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE_BYTES", 70)
    monkeypatch.setattr(sd, "BATCH_BYTES", 60)
    rng = random.Random(19)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    base = text(900)
    rows = [(1, base), (2, text(50) + base[100:700] + text(333)), (3, base[450:520] * 3), (4, text(70)), (5, base)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digests(docs, length=40, gram=12).collect())
    assert got == brute(rows, 40)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digests(docs).count() == 0
