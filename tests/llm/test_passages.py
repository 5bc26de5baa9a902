"""Repeated passages against a plain version."""

import random

import pytest

from gradewell.llm import passages as P


def plain(rows, window):
    """rows of (key, text) in order -> {row number: (n_words, n_removed, kept)}."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    words = [(t or "").encode().split() for _, t in rows]
    seen, out = set(), [None] * len(rows)
    for i in order:
        gone = set()
        for s in range(len(words[i]) - window + 1):
            w = tuple(words[i][s:s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        kept = [w for j, w in enumerate(words[i]) if j not in gone]
        out[i] = (len(words[i]), len(gone), b" ".join(kept).decode())
    return out


def texts(rng, n):
    pool = [" ".join(rng.choice(["a", "b", "ccc", "é", "word", "x\ty", "漢字"]) for _ in range(rng.randint(18, 70))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < .5:
                p = rng.choice(pool).split(" ")
                a = rng.randint(0, 10)
                parts.append(" ".join(p[a:a + rng.randint(15, 60)]))
            else:
                parts.append(" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 40))))
        out.append("\n".join(parts))
    out += ["loop " * 300, "ab cd " * 100, "loop " * 25, None, "", "   ", pool[0], pool[0], " ".join(pool)]
    return out


@pytest.mark.parametrize("seed,window,block_bytes", [(1, 20, 4_000_000), (2, 20, 700), (3, 7, 2_000), (4, 6, 300)])
def test_equals_a_plain_version(spark, seed, window, block_bytes):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]) if i % 7 == 0 else i, t) for i, t in enumerate(texts(rng, 60))]
    rng.shuffle(rows)
    table = spark.createDataFrame([(k, t, "x") for k, t in rows], "session_id int, free_text_feedback string, block string").coalesce(1)
    got = P.drop_repeated_passages(table, window_words=window, block_bytes=block_bytes, crowded=4 if seed % 2 else 1000).collect()
    assert sorted(map(repr, ((r[0], r[1], r[2], r[3]) for r in got))) == sorted(map(repr, ((k, *x) for (k, _), x in zip(rows, plain(rows, window)))))


def test_text_keys_partitions_and_odd_tables(spark):
    rng = random.Random(9)
    rows = [(f"s{i:03}", t) for i, t in enumerate(texts(rng, 80))]
    table = spark.createDataFrame(rows, "session_id string, note string").repartition(7)
    got = {r[0]: (r[1], r[2], r[3]) for r in P.drop_repeated_passages(table, text="note", block_bytes=900).collect()}
    assert got == {k: x for (k, _), x in zip(rows, plain(rows, 20))}
    assert P.drop_repeated_passages(table.limit(0), text="note").count() == 0
    assert P.drop_repeated_passages(spark.createDataFrame([(None, None)] * 3, "session_id int, free_text_feedback string")).collect()[0][1:] == (0, 0, "")


def test_one_very_long_text_and_many_copies(spark):
    rng = random.Random(5)
    long = " ".join(f"t{rng.randint(0, 5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " tail"), *[(i, "same words " * 15) for i in range(3, 60)]]
    got = {r[0]: (r[1], r[2], r[3]) for r in P.drop_repeated_passages(spark.createDataFrame(rows, "session_id int, free_text_feedback string").repartition(5)).collect()}
    assert got == {k: x for (k, _), x in zip(rows, plain(rows, 20))}
