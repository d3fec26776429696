from __future__ import annotations

import random

import public_tokenizers
import pytest

from tickloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return tokens.tokenizer(PATH)


def test_splices_equal_one_encoding(tok):
    rng = random.Random(0)
    for k in range(250):
        a = rng.choice(["ab \n", "a", "  \n\t", "a'sé 1!\x85 ", "<|endoftext|> a", "́e 日本 \x1c\x1d", "x1 2,3. "])
        t = "".join(rng.choice(a) for _ in range(rng.randrange(900)))
        if k % 7 == 0:
            t += "<|endoftext|>" * rng.randrange(40) + t
        for chunk, overlap in ((64, 8), (100, 50), (37, 3)):
            assert tokens.count_long(tok, t, chunk, overlap) == len(tok.encode(t, add_special_tokens=False)), (t, chunk, overlap)


def test_one_huge_word_and_blanks(tok):
    for t in ("x" * 5000, " " * 5000, "\n" * 3000 + "a" + " " * 3000, "ab" * 2000 + " c" * 2000):
        assert tokens.count_long(tok, t, 256, 16) == len(tok.encode(t, add_special_tokens=False))


def test_counts(docs_of, tok):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "<|endoftext|>"), (4, "é" * 40), (5, "word " * 3000), (5, "word " * 3000)]
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs_of(rows), PATH, chunk=512, overlap=32).collect()), key=str)
    want = sorted(((d is not None, d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 1024) for d, t in rows), key=str)
    assert got == want


def test_query(spark, small, small_texts, tok):
    for r in tokens.op8_token_counts(spark, small).collect():
        t = small_texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False)))


def test_empty_table(docs_of):
    assert tokens.token_counts(docs_of([]), PATH).count() == 0
