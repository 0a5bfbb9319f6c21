"""Decontamination against a brute-force reading of every window."""

import random
import re

import pytest

from driftspark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            size = min(10, len(b))
            windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item) if item is not None else "")
        out.append((str(key), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "É", "x1", "The"]) for _ in range(n))
    items = [(1, text(30)), (2, "one two three"), (3, ""), (4, None), (None, "É b"), (5, "9"), (1, text(14)), (22, text(10)), (6, "a a a a a a a a a a a a")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100, f"zz {items[0][1].upper().replace('É', 'É')} yy; {items[7][1]}"), (101, None), (102, ""), (103, "--- !!"), (104, "ONE, two\n(three) 9"), (104, "one two three"), (None, "a " * 300)]
    given = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1.5) for i, t in items], "item_id long, text string, size double")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontam.hits(given, bench).collect())
    assert got == brute(docs, items)
    digests = decontam.digests(decontam.hits(given, bench))
    assert digests.filter("contaminated").count() == sum(1 for x in got if x[2])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = decontam.digests(decontam.hits(docs, bench)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert decontam.hits(docs.limit(0), bench).count() == 0


def test_rows_go_by_their_own_texts(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x {text}", "a"), (1, "other", "b"), (None, f"{text} y", "c"), (None, "", "d"), (None, None, "e"), (2, text, "f"), (2, text, "g")], "doc_id long, text string, _x string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r._x for r in kept.collect()) == ["b", "d", "e"]
