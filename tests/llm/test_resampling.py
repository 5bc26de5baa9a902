"""Importance resampling and its radix sort against plain versions."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from gradewell.llm import resampling as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return [crc32(b" ".join(words[i:i + n])) % R.BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def random_text(rng, n):
    return "".join(rng.choice(["Abc", "é", "x1", " ", ". ", "漢 ", "The ", "\n", "\x00", "Z"]) for _ in range(n))


@pytest.mark.parametrize("size", [1, 7, 40, R.SLICE_BYTES])
def test_runs_equal_a_plain_version(monkeypatch, size):
    monkeypatch.setattr(R, "SLICE_BYTES", size)
    rng = random.Random(size)
    for text in [None, "", " ", "a", "a b", *[random_text(rng, rng.randint(0, 300)) for _ in range(100)]]:
        found, n = R.run_buckets(text)
        expected, words = plain_runs(text)
        assert sorted(found.tolist()) == sorted(expected) and n == words


def test_radix_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-2 ** 63, 2 ** 63 - 1, 0, 5, -5, *range(20)]), rng.randint(-2 ** 40, 2 ** 40) if i % 2 else 7, i) for i in range(3000)]
    table = spark.createDataFrame(rows, "a bigint, b bigint, nr bigint").repartitionByRange(5, "nr").sortWithinPartitions("nr")
    for block_rows, digit_bits in ((64, 16), (256, 5)):
        got = R.radix_positions(table.filter("nr < 400") if digit_bits == 5 else table, ["a", "b"], block_rows, digit_bits).collect()
        expected = sorted(rows[:400] if digit_bits == 5 else rows)
        assert [(r["a"], r["b"], r["nr"]) for r in sorted(got, key=lambda r: r["position"])] == expected
        assert sorted(r["position"] for r in got) == list(range(len(expected)))
    one = R.radix_positions(spark.createDataFrame([(1, i) for i in range(100)], "a bigint, nr bigint").repartition(3), ["a"], 16)
    assert sorted(r["position"] for r in one.collect()) == list(range(100))
    assert R.radix_positions(table.limit(0), ["a"]).count() == 0


def plain_draw(rows, target, percent=5, min_words=20):
    runs = [plain_runs(t) for _, t in rows]
    s, t = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    for r, _ in runs:
        np.add.at(s, r, 1)
    for text in target:
        np.add.at(t, plain_runs(text)[0], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + R.BUCKETS) / ((a + 1) * (t.sum() + R.BUCKETS)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for (key, _), (r, n) in zip(rows, runs):
        h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in r)
        out.append([key, len(r), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= min_words), key=lambda o: (-o[3], o[0] is None, o[0] if o[0] is not None else 0))
    for i, o in enumerate(able[:len(able) * percent // 100]):
        o[4] = i + 1
    return [tuple(o[:5]) for o in out]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_draw_equals_a_plain_version(spark, kind):
    rng = random.Random(8)
    rows = [((i if kind == "int" else f"s{i % 97}-{i}"), random_text(rng, rng.choice([5, 60, 400]))) for i in range(300)]
    rows += [(400 if kind == "int" else "s", None), (401 if kind == "int" else "", "one"), (None, "a b c " * 20)]
    target = ["Abc the x1 é", None, "", "the the abc"]
    table = spark.createDataFrame([(k, t, 1, "r") for k, t in rows], f"session_id {kind}, free_text_feedback string, position int, rank string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "title string")
    for percent in (5, 60):
        got = R.resample_feedback(table, wanted, percent=percent, block_rows=64).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_draw(rows, target, percent)))


def test_odd_tables(spark):
    wanted = spark.createDataFrame([("a b",)], "title string")
    table = spark.createDataFrame([(1, "a b c d " * 10)] * 3 + [(2, None)], "session_id int, free_text_feedback string")
    assert sorted(r["rank"] or 0 for r in R.resample_feedback(table, wanted, percent=100).collect()) == [0, 1, 2, 3]
    assert R.resample_feedback(table.limit(0), wanted).count() == 0
    assert R.resample_feedback(table, wanted.limit(0)).count() == 4
    with pytest.raises(TypeError):
        R.resample_feedback(spark.createDataFrame([(1.5, "a")], "session_id double, free_text_feedback string"), wanted)
