"""Prefix trie against a plain version."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import prefixes as P


def plain(rows, donor, heads):
    """rows of (conv_id, turn, role, text) -> sorted node tuples."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, said, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {c: tuple(own.get(donor(c), [])[:heads(c)] + v[heads(c):]) for c, v in own.items()}
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = {k: [min(m), len(k), min(members[k[:-1]]) if k else None, len(m), 0, 0, 0,
               hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == k))).encode()).hexdigest()] for k, m in members.items()}
    for k in out:
        if k:
            out[k[:-1]][4] += 1
    for k, v in list(out.items()):
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", k[-1][1].encode())) if k else 0
        for d in range(len(k) + 1):
            out[k[:d]][5] += v[4] == 0
            out[k[:d]][6] += (v[3] - 1) * words
    return sorted(map(repr, (tuple(v) for v in out.values())))


def talks(rng, n, longest=8):
    said = [(r, t) for r in ("user", "assistant", None) for t in ("hello  there", "a b\tc", None, "", "é 漢字", "x")]
    rows = []
    for c in range(n):
        turns = [rng.choice(said[:4] if rng.random() < .7 else said) for _ in range(rng.randint(1, longest))]
        if c % 9 == 0:
            turns = [("user", "hello  there"), ("assistant", "x")] * 3
        rows += [(c * 3, None if i == 0 and c % 5 == 0 else i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn int, role string, text string"


@pytest.mark.parametrize("seed,shard_rows", [(1, 200_000), (2, 30), (3, 1)])
def test_equals_a_plain_version(spark, monkeypatch, seed, shard_rows):
    monkeypatch.setattr(P, "TOP_SHARE", 10 ** 6)
    monkeypatch.setattr(P, "IDS_PER_CHUNK", 8)
    rows = talks(random.Random(seed), 120) + [(None, 1, "user", "lost"), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, 1, "assistant", "x")]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", words int").repartition(5)
    donor, heads = (lambda c: c - c % 20), (lambda c: crc32(str(c).encode()) % 4)
    got = P.prefix_trie(table, F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, shard_rows).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows, donor, heads)


def test_unchanged_conversations_one_long_and_empty(spark):
    rows = talks(random.Random(4), 30) + [(1000, i, "user", f"w{i}") for i in range(800)] + [(1001, i, "user", f"w{i}") for i in range(790)]
    got = P.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_rows=100).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(rows, lambda c: c, lambda c: 0)
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = P.prefix_trie(spark.createDataFrame([(3, 1, "user", "a")], SCHEMA), F.lit(-1), F.lit(2)).collect()
    assert [tuple(r)[:7] for r in one] == [(3, 0, None, 1, 0, 1, 0)]


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        hi, lo = rng.integers(-2 ** 63, 2 ** 63, n), rng.integers(0, 4, n)
        table = P.SlotTable(hi, lo)
        assert sorted(table.slots(hi, lo).tolist()) == list(range(n))
        assert (table.slots(hi, lo + 9) == -1).all() and (table.slots(rng.integers(-2 ** 63, 2 ** 63, 100), np.zeros(100, np.int64)) == -1).all()
    with pytest.raises(ValueError):
        P.SlotTable(np.array([5, 5]), np.array([1, 1]))
