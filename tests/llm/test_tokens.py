"""BPE round trip and token counts against the libraries on whole texts."""

import random

import public_tokenizers
import pytest
import regex
import sentencepiece

from driftspark.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  ", "\n\n \t x", "don't 'll we've'", "ñandú ciónez 日本語のテキスト", "a" * 5000, " " * 3000, "👩‍👩‍👧 'r 'v", "<s>hi</s> <unk>", "x ▁y ▁▁ z", "1234 56 7'", "é" * 700 + "'s " * 50]


def random_text(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ab '  sveld\n\t1é日!") for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(7, 4), (16, 8), (50, 20)])
def test_chunks_give_the_ids_of_the_whole_text(chunk, overlap):
    enc, split, words = bpe.encoding(RANKS, public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN), bpe.token_bytes(RANKS)
    rng = random.Random(1)
    for text in [*ODD, *(random_text(rng, 400) for _ in range(150))]:
        ids = bpe.encode_text(enc, split, text, chunk, overlap)
        assert ids.tolist() == enc.encode_ordinary(text)
        assert bpe.decode_ids(words, ids) == text.encode()


#: White space of all kinds, and characters that look like it or that some tables count as such.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2007\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


@pytest.mark.parametrize("chunk", range(1, 10))
def test_no_cut_changes_ids_beside_white_space_of_any_kind(chunk):
    enc, split = bpe.encoding(RANKS, public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(chunk)
    alphabet = BLANKS + "ab'Z.1é日" * 3
    for _ in range(600):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
        assert bpe.encode_text(enc, split, text, chunk, rng.randrange(1, 6)).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("blank", ["\xa0", "\u2028", "\x85", "\u2009", " ", "\n"])
def test_default_chunks_beside_white_space(blank):
    enc, split = bpe.encoding(RANKS, public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    for place in range(bpe.CHUNK_CHARS - 4, bpe.CHUNK_CHARS + 3):
        text = ("word. " * 8000)[:place] + f". {blank}Zebra" + " tail" * 3000
        assert bpe.encode_text(enc, split, text).tolist() == enc.encode_ordinary(text)


def test_a_long_pre_token_is_split_in_linear_work():
    class Counting:
        def __init__(self):
            self.inner, self.chars = regex.compile(public_tokenizers.PATTERN), 0

        def finditer(self, text, start, end):
            self.chars += end - start
            return self.inner.finditer(text, start, end)

    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in ("x" * 3000 + " and more " + "y" * 100, "ab " * 50 + " " * 2000 + "z", "word " * 500):
        split = Counting()
        assert bpe.encode_text(enc, split, text, 32, 8).tolist() == enc.encode_ordinary(text)
        assert split.chars <= 8 * len(text)


def test_round_trip_of_odd_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(1, None, "x"), (None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True, chunk_chars=64, overlap_chars=16)
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded), r.token_ids) for r in encoded.collect())
    assert got == sorted((i is None, i or 0, (t or "").encode(), enc.encode_ordinary(t or "")) for i, t, _ in rows)
    assert bpe.decode(encoded, RANKS).count() == len(rows)
    assert bpe.digests(encoded).filter("n_tokens = 0").count() == 2
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_equal_the_library_on_whole_texts(spark):
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(2)
    texts = [*ODD, *(random_text(rng, 200) for _ in range(300)), None]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL, limit=50, batch_bytes=500).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0
