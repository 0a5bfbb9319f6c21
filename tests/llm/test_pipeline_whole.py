"""The whole pipeline on a small corpus against a slow version of every stage."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import regex

import corpus_pipeline
from driftspark.llm import bpe, pii, quality, queries

from test_decontam import brute as hit_by
from test_pii import slow_matches, stays
from test_pipeline import TINY, shingles


def accepted(docs, labels):
    """Documents whose labelled neighbours vote for them, by a loop over all labelled rows."""
    terms = quality._Terms()
    learnt = labels[labels.quality.isin([0, 1]) & labels.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 != 0)].groupby("doc_id").quality.max()
    text = dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    known = [(i, int(y)) for i, y in learnt.items() if i in text]
    noise = [quality.noise(text[i], zlib.crc32(str(i).encode())) for i, y in known if y == 1 and len(text[i].split()) >= quality.NOISE_WORDS]
    rows = quality.features([text[i] for i, _ in known] + noise, terms)
    model = quality.train(rows, np.array([float(y) for _, y in known] + [quality.NOISE_LABEL] * len(noise)))
    out = {}
    for i, t in text.items():
        v = (quality.features([t], terms) @ model.projection)[0]
        v = v / (np.linalg.norm(v) or 1)
        cos = model.vectors @ v
        near = sorted(range(len(cos)), key=lambda j: -cos[j])[: quality.NEIGHBOURS]
        w = [max(0.0, float(cos[j])) ** quality.SHARPNESS for j in near]
        out[i] = sum(a * model.labels[j] for a, j in zip(w, near, strict=True)) / sum(w) if sum(w) else model.prior
    return {i for i, s in out.items() if s >= queries.QUALITY_CUT}


def one_of_each_group(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in texts if find(i) == i}


def test_run_equals_the_slow_version(spark):
    docs, labels, bench = (pd.read_parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    text = dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    left = accepted(docs, labels)
    left = one_of_each_group({i: text[i] for i in left})
    hit = {int(i) for i, _, n, _ in hit_by([(i, text[i]) for i in left], list(zip(bench.item_id, bench.text, strict=True))) if n}
    left -= hit

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, TINY).collect()}
    assert set(got) == left and 0 < len(left) < len(text)
    ranks = public_tokenizers.path(queries.BPE_RANKS)
    enc, vocabulary, to = bpe.encoding(ranks, public_tokenizers.PATTERN), bpe.token_bytes(ranks), {}
    for i, r in got.items():
        new = b"".join(vocabulary[x] for x in r.token_ids)
        assert r.token_ids == enc.encode_ordinary(new.decode()) and r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.token_ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(new).hexdigest()
        matches, gaps = slow_matches(text[i])
        found = regex.fullmatch("(.+?)".join(map(regex.escape, gaps)), new.decode(), regex.DOTALL)
        assert found and (matches or new.decode() == text[i])
        for a, b in zip(matches, found.groups(), strict=True):
            assert (a == b) == stays(a)
            assert to.setdefault(a, b) == b or regex.match(pii.TITLES, a)
