import random

import pytest
from pyspark.sql import functions as F

from gradewell.operators import dedup as D
from gradewell.operators import governed as G
from gradewell.operators import nearmatch as NM
from gradewell.plans import dedup as queries
from gradewell.plans.fixtures import Fixtures
from conftest import MEDIUM


def brute_pairs(rows, k):
    out = set()
    distinct = sorted(set(rows))
    for i, (g, a) in enumerate(distinct):
        for h, b in distinct[i + 1:]:
            if g == h and bin((a ^ b) & (2**64 - 1)).count("1") <= k:
                out.add((g, min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("hot_key", [4096, 0])
def test_near_pairs_equal_brute_force(spark, hot_key, k):
    rng = random.Random(7)
    rows = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            value = base
            for _ in range(rng.randint(0, k + 1)):
                value ^= 1 << rng.randrange(64)
            rows.append((rng.randint(0, 1), value - 2**64 if value >= 2**63 else value))
    table = spark.createDataFrame(rows, "g int, fp long")
    found = NM.near_pairs(table, ["g"], "fp", k=k, hot_key=hot_key).collect()
    got = [(r["g"], r["fp_a"], r["fp_b"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, k)


def test_wide_distance_on_embeddings(spark):
    fx = Fixtures(spark, MEDIUM)
    totals = NM.near_pair_totals(fx.cands, ["label"], "fp", k=20, bits=63)
    assert totals.agg(F.sum("row_pairs")).first()[0] == 67
    assert NM.near_pairs(fx.cands, ["label"], "fp", k=2, bits=63).count() == 0


def walk(rows, current, needed, priority, k):
    """The sequential rules, on plain rows ordered by rank."""
    seen, out = set(), {}
    for label in priority:
        accepted, prints = 0, []
        for r in sorted((r for r in rows if r["label"] == label), key=lambda r: (r["doc_id"] % 3, r["doc_id"])):
            if accepted >= needed.get(label, 0):
                break
            if not r["readable"] or r["tiny_or_invalid"]:
                reason = G.REJECT_INVALID
            elif not r["quality_pass"]:
                reason = G.REJECT_QUALITY
            elif r["sha"] in current:
                reason = G.REJECT_CURRENT
            elif r["sha"] in seen:
                reason = G.REJECT_EXACT
            elif any(bin((r["fp"] ^ p) & (2**64 - 1)).count("1") <= k for p in prints):
                reason = G.REJECT_NEAR
            else:
                reason, accepted = None, accepted + 1
                seen.add(r["sha"])
                prints.append(r["fp"])
            out[r["doc_id"]] = reason
    return out


@pytest.mark.parametrize("share", [0.1, 0.4, 2.0])
def test_governed_selection_equals_the_walk(spark, fx, share):
    candidates, current = queries.selection_candidates(fx)
    rows = [r.asDict() for r in candidates.collect()]
    table = spark.createDataFrame(candidates.collect(), candidates.schema)
    known = {r["sha"] for r in current.collect()}
    labels = sorted({r["label"] for r in rows})[:3]
    needed = {x: int(share * sum(r["label"] == x for r in rows)) for x in labels}
    found = G.governed_selection(table, current, needed, labels, [F.col("doc_id") % 3, F.col("doc_id")], k=2, bits=63)
    assert {r["doc_id"]: r["reason"] for r in found.collect()} == walk(rows, known, needed, labels, 2)


def test_chains_of_conflicts_and_empty_quota(spark):
    """Neighbours at distance 2 in a chain: every other one is accepted, which takes several rounds."""
    rows = [(i, 1, f"s{i}", (1 << i) - 1, True, False, True) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id int, label int, sha string, fp long, readable boolean, tiny_or_invalid boolean, quality_pass boolean")
    none = spark.createDataFrame([], "sha string")
    found = G.governed_selection(table, none, {1: 100}, [1], ["doc_id"], k=2)
    assert sorted(r["doc_id"] for r in found.filter("selected").collect()) == list(range(0, 40, 3))
    assert G.governed_selection(table, none, {1: 0}, [1], ["doc_id"]).count() == 0
    outputs = G.selection_outputs(found)
    assert outputs["clean"].count() + outputs["rejected"].count() == outputs["quality"].count() == 40


def test_dedup_is_idempotent_and_limits_groups_first(fx):
    once = D.dedup_vectors(fx.feats, queries.VECTOR, "row_id")
    assert "WindowGroupLimit" in once._jdf.queryExecution().executedPlan().toString()
    assert D.dedup_vectors(once, queries.VECTOR, "row_id").count() == once.count()


def test_digest_ignores_the_sign_of_zero_and_keeps_nulls_apart(spark):
    table = spark.createDataFrame([(1, 0.0, None), (2, -0.0, None), (3, 0.0, 0.0)], "row_id int, a double, b double")
    assert D.dedup_vectors(table.withColumn("label", F.lit(0)), ["a", "b"], "row_id").count() == 2
