"""Token counts by overlap resynchronisation against the library over whole texts."""

import random

import public_tokenizers as P
import pytest

from gradewell.llm.tokens import Splicer, feedback_token_counts

MODEL = P.path("piece_bpe_32k.model")
PARTS = ["the ", "a", "  ", "\n", "é", "漢", "😀", "####", " hello", "=", "▁", "\x00", "ß", "ing", "123", "    ", "<s>", "</s>"]


@pytest.fixture(scope="module")
def splicer():
    return Splicer(MODEL, 200, 20)


def test_spliced_counts_equal_whole_counts(splicer):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 900)))
        assert splicer.count_long(text) == len(splicer.model.encode(text))


@pytest.mark.parametrize("text", ["a" * 5000, "=" * 3000, " " * 3000, "ab " * 2000, "", "x", "\n" * 999])
def test_texts_without_boundaries_widen(splicer, text):
    assert splicer.count_long(text) == len(splicer.model.encode(text))


def test_table(spark):
    texts = [None, "", "one two", "one two", "word " * 30_000, "z" * 5000]
    rows = [(None if i == 1 else i % 4, t, 7) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "session_id int, free_text_feedback string, n_tokens int")
    out = feedback_token_counts(table, MODEL, chunk_chars=1000).collect()
    whole = Splicer(MODEL).model
    assert [(r["session_id"], r["n_bytes"], r["n_tokens"]) for r in out] == [(k, len((t or "").encode()), len(whole.encode(t or ""))) for k, t, _ in rows]
    assert [r["over_limit"] for r in out] == [len(whole.encode(t or "")) > 4096 for t in texts]
    assert feedback_token_counts(table.limit(0), MODEL).count() == 0
