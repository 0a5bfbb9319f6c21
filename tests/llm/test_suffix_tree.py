"""Passages removed by suffix trees against brute force over every window."""

import random

import numpy as np
import pytest

from driftspark.llm import suffix_tree

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            out, word = (out + [word], "") if word else (out, "")
        else:
            word += c
    return out


def brute(rows, length):
    first = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1 if key is not None else 0):
            t = tuple(w[i : i + length])
            first[t] = min(first.get(t, key), key)
    out = []
    for key, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - length + 1 if key is not None else 0):
            if first[tuple(w[i : i + length])] < key:
                gone.update(range(i, i + length))
        out.append((str(key), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def corpus(rng, n, pool, most, passages):
    rows = []
    for i in range(n):
        w = [rng.choice(pool) for _ in range(rng.randrange(most))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            cut = rng.randrange(len(p))
            w[at:at] = p[cut:] if rng.random() < 0.5 else p
        rows.append((i, "".join(x + rng.choice(BLANKS) * rng.randrange(1, 3) for x in w)))
    return rows


@pytest.mark.parametrize(("group_bytes", "prefixes"), [(2 << 20, (16, 32)), (1, (3, 5)), (400, (2, 4))])
def test_equals_brute_force(spark, group_bytes, prefixes):
    rng = random.Random(group_bytes)
    pool = ["a", "b", "É", "x1", "The", "\xa0", "\u2003", "\x1c"]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(6, 40))] for _ in range(6)]
    rows = corpus(rng, 60, pool, 40, passages) + [(200, None), (201, ""), (202, " \n"), (203, "a " * 50), (204, "a " * 60), (None, "a " * 60), (None, "a " * 60)]
    rows += [(5, rows[7][1]), (5, rows[5][1]), (5, rows[5][1])]
    given = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, key string, row int").repartition(3)
    got = suffix_tree.remove_passages(given, length=7, gram=3, group_bytes=group_bytes, prefixes=prefixes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 7)
    assert all(sum(s.n for s in r.spans) == r.n_removed for r in got)
    assert suffix_tree.digests(given.limit(0)).count() == 0


def test_long_texts_by_pieces_and_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "PIECE_BYTES", 500)
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", 300)
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(50)]
    long = " ".join(rng.choice(pool) for _ in range(900))
    rows = [(1, long), (2, long[1000:2500] + " tail"), (3, "x" * 2000 + " " + long), (4, long), *[(10 + i, "own " * i + long[:400]) for i in range(20)]]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffix_tree.remove_passages(given).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 50)


def test_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    given = spark.createDataFrame([("b", text), ("a", text), ("c", text + " more")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffix_tree.digests(given).collect()} == {"a": 0, "b": 60, "c": 60}


def test_nodes_of_a_subtree():
    text = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    first = suffix_tree.first_documents(text, np.array([0, 3, 6]), np.array([7, 5, 6]), 3)
    assert first.tolist() == [6, 5, 6]  # 1 2 3 is below a node of documents 6 and 7
    assert suffix_tree.first_documents(text, np.array([0, 3, 6]), np.array([7, 5, 6]), 2).tolist() == [5, 5, 5]
