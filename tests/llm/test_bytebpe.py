"""Byte-level BPE by recursive queries against the library, and the round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from gradewell.llm import bytebpe as B

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["the ", "a", "  ", "\n", "é", "漢", "😀", "####", " hello", "=", "\x00", "ing", "123", "    ", " 's", "don't ", "\x1c", " \n", "　", "\xa0", "aaaa"]
EDGES = ["", " ", " a", "a ", "<|endoftext|> x", "a" * 5000, "ab" * 700, "=" * 3000, " " * 3000]


@pytest.fixture(scope="module")
def coder():
    return B.WordCoder(RANKS, P.PATTERN, cached_words=500)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def test_ids_equal_the_library(coder, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 200))) for _ in range(200)] + EDGES
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1500)))
    for text, (ids, raw) in zip(texts, coder.encode_many(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode_ordinary(text)
        assert raw == text.encode()


def test_words_of_any_length(coder, library):
    """Runs over few letters, where ties and overlaps are many, and long words without a break."""
    rng = random.Random(4)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 300))) for letters in ("ab", "abn", "=-", "é漢", "etaoin") for _ in range(60)]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (100, 1500, 20_000)]
    for word, (ids, raw) in zip(words, coder.contract([w.encode() for w in words])):
        assert np.frombuffer(ids, np.uint32).tolist() == library._encode_single_piece(word) and raw == word.encode()


def test_a_word_of_a_megabyte(coder, library):
    rng = random.Random(6)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    [(ids, raw)] = coder.encode_many([word])
    assert np.frombuffer(ids, np.uint32).tolist() == library.encode_ordinary(word) and raw == word.encode()


def test_table_and_round_trip(spark, library):
    texts = [None, "", "One text", "One text", "x " * 5000, *EDGES]
    table = spark.createDataFrame([(None if i == 2 else i % 5, t, "c") for i, t in enumerate(texts)], "session_id int, free_text_feedback string, decoded string")
    encoded = B.encode_feedback(table, RANKS, P.PATTERN)
    rows = encoded.collect()
    assert [r["token_ids"] for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]).decode() for r in B.decode_feedback(encoded, RANKS, P.PATTERN).collect()] == [t or "" for t in texts]
    digests = B.encoded_digests(table, RANKS, P.PATTERN).collect()
    assert [r["ids_sha256"] for r in digests] == [hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for t in texts]
    assert B.encode_feedback(table.limit(0), RANKS, P.PATTERN).count() == 0
    bad = spark.createDataFrame([(1, [10_000_000])], "session_id int, token_ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode_feedback(bad, RANKS, P.PATTERN).collect()
