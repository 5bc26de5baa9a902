"""Packing: ids against the library, plans against their bounds, pieces against the texts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradewell.llm import packing as K

FILE = P.path("word_bpe_49k.json")
PARTS = ["the ", "a", "  ", "\n", "é", "É", "漢", "😀", "####", "=", "\x00", "ß", "ing", "123", " 's", "don't ", "\x1c", "　", "\xa0", "THE", "<|endoftext|>", " ́", "İ", "ΑΣ ", "ÿ", "ª", "µ", "'S "]


def test_ids_equal_the_library():
    ours, library = K.WordIds(FILE, cached_words=50), Tokenizer.from_file(FILE)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(ours.encode_many([text])[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def used(plan):
    total = Counter()
    for pieces, n in plan:
        for size, m in pieces.items():
            total[size] += m * n
    return +total


def padding(plan, length):
    sums = [(sum(s * m for s, m in pieces.items()), n) for pieces, n in plan]
    return sum((0 if s & (s - 1) == 0 else length - s) * n for s, n in sums)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 3000), max_size=12))
def test_plans_use_the_histogram_exactly(histogram):
    plan = K.plan_sequences(histogram, 64)
    assert used(plan) == Counter(histogram)
    assert all(sum(s * m for s, m in pieces.items()) <= 64 for pieces, _ in plan)


def test_little_padding():
    rng = random.Random(5)
    histogram = Counter()
    for _ in range(20_000):
        for _, size in K.cuts(int(rng.lognormvariate(6.5, 1)) + 1):
            histogram[size] += 1
    plan = K.plan_sequences(dict(histogram))
    assert padding(plan, K.LENGTH) < 0.002 * sum(s * n for s, n in histogram.items())


def test_column_generation_reaches_the_bound():
    sizes, counts = np.array([5, 7, 12]), np.array([1000.0, 900.0, 500.0])
    total = sum(u for _, u in K.generate_patterns(sizes, counts, 31))
    assert total <= float(sizes @ counts) / 31 * 1.03


@pytest.mark.parametrize("tokens", [1, 63, 64, 65, 4095, 4096, 4097, 12_345])
def test_cuts_cover_a_text(tokens):
    found = K.cuts(tokens)
    assert [s for s, _ in found] == np.concatenate([[0], np.cumsum([n for _, n in found])[:-1]]).tolist()
    assert sum(n for _, n in found) == tokens


def test_table(spark):
    texts = [None, "", "one two three", "one two three", "long text " * 9000, *[f"number {i} of many" * (i % 9) for i in range(60)]]
    rows = [(None if i == 2 else i if i < 40 else 41, t, 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "session_id int, free_text_feedback string, length int")
    out = K.pack_feedback(table, FILE).toPandas()
    library = Tokenizer.from_file(FILE)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    expected = Counter((-1 if k is None else k, s, n, zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()), len(x))
                       for (k, _, _), x in zip(rows, ids) for s, n in K.cuts(len(x)))
    out["session_id"] = out["session_id"].fillna(-1).astype(int)
    assert Counter(map(tuple, out[["session_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False))) == expected
    for _, pieces in out.sort_values("offset").groupby("sequence_id"):
        assert pieces["offset"].tolist() == np.concatenate([[0], np.cumsum(pieces["length"])[:-1]]).tolist()
        assert pieces["length"].sum() <= K.LENGTH
    assert K.pack_feedback(table.limit(0), FILE).count() == 0
