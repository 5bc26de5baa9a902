"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from gradewell.llm import simhash as S


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, k=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= k:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \n\t", "One", "one two", "ONE two\tthree four", "a b c d e f g h", "a  b c d e f g H", "é ü ß x\x0by z " * 5, "word " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def near_cloud(rng, n):
    """Chains and clouds of fingerprints around a few centres, and strangers."""
    prints = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(prints) < n:
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            p ^= 1 << b
        prints.append(p)
    return prints


@pytest.mark.parametrize("crowded", [256, 3, 1, 0])
def test_links_match_all_pairs(spark, crowded):
    prints = sorted(set(near_cloud(random.Random(crowded), 300)) | {0, (1 << 64) - 1, 1 << 63})
    table = spark.createDataFrame([(i, S.signed(p)) for i, p in enumerate(prints)], "session_id bigint, fingerprint bigint")
    expected = plain_components(prints)
    groups = S.group_table(table, "session_id", 4, 5, crowded)
    found = {r["fp"]: r["component_id"] for r in groups.collect()}
    assert [found[S.signed(p)] for p in prints] == expected


def test_groups_with_nulls_repeats_and_other_columns(spark):
    rows = [(3, "a b c d e f g h i j"), (1, "A b c d e f g h i j"), (None, "a b c d e f g h i j"), (5, None), (4, " "), (7, "quite another text of some words here"), (7, "quite another text of some words here"), (None, "alone among null keys is this text")]
    feedback = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "session_id bigint, free_text_feedback string, fingerprint string, component_id string")
    out = sorted((str(r["session_id"]), str(r["component_id"])) for r in S.near_duplicate_groups(feedback).collect())
    assert out == sorted([("3", "1"), ("1", "1"), ("None", "1"), ("5", "4"), ("4", "4"), ("7", "7"), ("7", "7"), ("None", "None")])
    kept = S.keep_one_per_group(feedback)
    assert kept.columns == feedback.columns
    assert sorted(str(r["session_id"]) for r in kept.collect()) == ["1", "4", "7", "None"]


def test_empty_table(spark):
    feedback = spark.createDataFrame([], "session_id bigint, free_text_feedback string")
    assert S.near_duplicate_groups(feedback).count() == 0
    assert S.keep_one_per_group(feedback).count() == 0
