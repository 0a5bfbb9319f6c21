"""The audits of filters and of sources against brute force over small tables."""

import random
from collections import Counter
from itertools import permutations

from driftspark.llm import filter_audit, source_audit


def failing(rows, i):
    key, text, _ = rows[i]
    text = text or ""
    words = text.replace("\x85", "_").replace("\xa0", "_").replace("\u2003", "_").replace("\x1c", "_").split()
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    same = [k for k, t, _ in rows if (t or "") == text and k is not None and key is not None and k < key]
    return found + "E" * bool(same)


def test_filters_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, pool: " ".join(rng.choice(pool) for _ in range(n))
    many = [f"w{i}" for i in range(400)]
    texts = [text(250, many), text(250, ["a", "b"]), text(10, many), text(10, many) + " $", text(260, [m.upper() for m in many]), "", None, "É x\x85y\xa0z\x1cq", "a\tb\x0bc\n" * 100, "A", "😀 " * 230 + "Q" * 5]
    rows = [(i, rng.choice(texts), rng.choice(["s", "s", "s", "t", "", None])) for i in range(120)]
    rows += [(5, rows[5][1], "s"), (None, texts[0], "u"), (None, texts[0], "u"), (3, texts[0], "u"), *[(None, texts[1], None)] * 3]
    labels = [(i, rng.choice([0, 1]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id int, text string, source string, part string, bits int").repartition(3)
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, n string")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(filter_audit.counted(given, marks)).collect()}

    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    fails = [failing(rows, i) for i in range(len(rows))]
    parts = {r[2] or "" for r in rows}
    assert len(got) == 600 * len(parts)
    for part in parts:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = Counter()
        want = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                shapley[f] += len(gone)
                redundant = sum(f in fails[i] for i in own) - len(gone)
                want[order, step] = (len(left), len(gone), redundant, sum(fails[i] == f for i in own), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone))
        for (order, step), values in want.items():
            r = got[part, order, step]
            assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == values
            assert r.shapley == shapley[order[step - 1]] and r.filter == order[step - 1]


def test_filters_of_hot_texts_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr("driftspark.llm.common.HOT_KEYS", 4)  # keys of more than a quarter of the rows are broadcast
    rows = [(i, "same", "s") for i in range(40)] + [(7, f"t{i}", "s") for i in range(60)] + [(None, "x", "s")] * 40
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    row = filter_audit.audit(filter_audit.counted(given, marks)).filter("filter_order = 'EABCD' AND step = 1").first()
    assert (row.removed, row.kept, row.good_lost, row.toxic_lost) == (39, 101, 1, 1)
    assert filter_audit.audit(filter_audit.counted(given.limit(0), marks)).count() == 0
    assert filter_audit.audit(filter_audit.counted(given, marks.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0


def brute_divergence(rows, least=3, ranks=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = []
    for text, lang, source in rows:
        cut = "".join(c if c > "\x7f" or c.isalpha() else " " for c in (text or "").translate(low))
        docs.append((lang or "", source or "", [w for w in cut.split(" ") if w]))
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, w in docs:
            if g == lang:
                counts[s].update(t for t in w if t in kept)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def test_sources_equal_brute_force(spark):
    rng = random.Random(9)
    pool = ["the", "The", "THE", "É", "é", "a", "bb", "x1y", "don't", "漢字", "İx", "z\x00w", "q", "_u_", "K"]
    rows = [(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for _ in range(60)]
    rows += [(None, "fr", "s1"), ("one two", "fr", "s2"), ("", "fr", None), ("solo", "it", "s1"), (None, None, None), *[("rep rep", "pt", "s1")] * 3]
    given = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "text string, lang string, source string, term string, n int, salt int").repartition(3)
    got = sorted(tuple(r) for r in source_audit.divergence(given).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows)
    got = sorted(tuple(r) for r in source_audit.divergence(given, least=1, ranks=2).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, 1, 2)
    assert source_audit.divergence(given.limit(0)).count() == 0
