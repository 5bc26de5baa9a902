"""Repeated lines against a plain count."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradewell.llm import lines as L


def plain(rows, least, min_chars=1, keep_first=False):
    texts = defaultdict(int)
    first = {}
    for key, text in rows:
        for k in set(L.keys_of(text, min_chars)):
            texts[k] += 1
            if key is not None:
                first[k] = min(first.get(k, key), key)
    out = []
    for key, text in rows:
        found = (text or "").split("\n")
        stay = [x for x in found if texts.get(L.line_key(x.encode()), 0) < least or keep_first and key is not None and first.get(L.line_key(x.encode())) == key]
        out.append((key, "\n".join(stay), len(found), len(found) - len(stay)))
    return Counter(out)


def invented(n=300):
    rng = random.Random(7)
    common = ["All rights reserved", "  ALL rights reserved\t", "see you", "é É", "", " ", "---"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.3 else f"line {rng.randint(0, 2000)}" for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return rows + [(None, "see you\nother"), (5, None), (5, rows[5][1]), (5, rows[5][1]), (n, "see you\n" * 4000 + "end")]


@pytest.mark.parametrize(("bits", "keep_first", "min_chars"), [(1 << 20, False, 1), (64, False, 1), (1 << 12, True, 1), (1 << 16, False, 8)])
def test_table(spark, bits, keep_first, min_chars):
    rows = invented()
    table = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "session_id int, free_text_feedback string, kept_text string, _digest int").repartition(5)
    out = L.drop_repeated_lines(table, min_texts=10, min_chars=min_chars, keep_first=keep_first, bits=bits, segment_bytes=min(bits // 8, 1 << 10))
    assert Counter((r["session_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == plain(rows, 10, min_chars, keep_first)


def test_empty_table(spark):
    table = spark.createDataFrame([], "session_id int, free_text_feedback string")
    out = L.drop_repeated_lines(table)
    assert out.columns == ["session_id", "free_text_feedback", "kept_text", "n_lines", "n_dropped"] and out.count() == 0


def test_partition_of_copies_only(spark):
    rows = [(i, "a shared line\nanother shared line") for i in range(10)]
    table = spark.createDataFrame(rows, "session_id int, free_text_feedback string").coalesce(1)
    out = L.drop_repeated_lines(table, min_texts=10).collect()
    assert Counter((r["session_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out) == plain(rows, 10)
    assert {r["n_dropped"] for r in out} == {2}


def test_segments_with_only_hashes_seen_twice():
    filters = L.TwoFilters(L.FILTER_BITS)
    hashes = L.hash_keys([b"a shared line", b"another shared line"])
    filters.add(np.concatenate([hashes, hashes]))
    sent = np.zeros_like(filters.twice)
    for i, _, twice in filters.segments(L.SEGMENT_BYTES):
        sent[i * L.SEGMENT_BYTES:(i + 1) * L.SEGMENT_BYTES] = np.frombuffer(twice, np.uint8)
    assert L.TwoFilters.has(sent, L.places(hashes, filters.bits)).all()


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 2 ** 63, 5000).astype(np.uint64), rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    filters = L.TwoFilters(1 << 18)
    filters.add(np.concatenate([once[:2500], twice]))
    filters.add(np.concatenate([once[2500:], twice]))
    assert filters.has(filters.twice, L.places(twice, filters.bits)).all()
    assert filters.has(filters.twice, L.places(once, filters.bits)).mean() < 0.05
