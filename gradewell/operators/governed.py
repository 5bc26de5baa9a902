"""Governed selection: fill weak classes from ranked candidates without taking duplicates.

The rules are those of a walk: per label, in priority order, candidates are visited in rank order and
turned down when unreadable, of low quality, already in the current table, an exact copy of an
accepted one, or a near copy of one accepted for the same label; the walk ends when the quota is full.

The walk itself is sequential. Its outcome is not: a candidate is accepted exactly when no accepted
candidate of lower rank conflicts with it, which is the lexicographically first maximal independent
set of the conflict graph. It is found in rounds over all undecided candidates at once; only those
that have a conflict take part. Content decides the fingerprint, so candidates with equal
fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.nearmatch import near_pairs
from gradewell.operators.ordering import global_rank
from gradewell.session import materialize

REJECT_INVALID = "invalid_or_unreadable"
REJECT_QUALITY = "failed_quality_check"
REJECT_CURRENT = "duplicate_of_current_dataset"
REJECT_EXACT = "duplicate_within_extra_selection"
REJECT_NEAR = "near_duplicate_within_extra_selection"


def independent_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (fp, rank) accepted when visited in rank order, given conflicts (fp_a, fp_b).

    Each round accepts every undecided node without an undecided neighbour of lower rank and rejects
    the neighbours of those accepted. Rounds end when no conflict is left among undecided nodes.
    """
    ranked = edges.join(nodes.select(F.col("fp").alias("fp_a"), F.col("rank").alias("rank_a")), "fp_a").join(
        nodes.select(F.col("fp").alias("fp_b"), F.col("rank").alias("rank_b")), "fp_b")
    first = F.col("rank_a") < F.col("rank_b")
    conflicts = materialize(ranked.select(
        F.when(first, F.col("fp_a")).otherwise(F.col("fp_b")).alias("lo"),
        F.when(first, F.col("fp_b")).otherwise(F.col("fp_a")).alias("hi")))
    rejected = None
    while not conflicts.isEmpty():
        blocked = conflicts.select(F.col("hi").alias("lo")).distinct()
        accepted = conflicts.select("lo").distinct().join(blocked, "lo", "left_anti")
        lost = materialize(conflicts.join(accepted, "lo", "left_semi").select(F.col("hi").alias("fp")).distinct())
        rejected = lost if rejected is None else rejected.unionByName(lost)
        # Conflicts of rejected nodes no longer count, and those of accepted nodes are settled.
        gone = lost.select(F.col("fp").alias("hi"))
        conflicts = materialize(
            conflicts.join(gone, "hi", "left_anti").join(lost.select(F.col("fp").alias("lo")), "lo", "left_anti"))
    return nodes if rejected is None else nodes.join(rejected, "fp", "left_anti")


def _select_label(rows: DataFrame, edges: DataFrame, quota: int) -> tuple[DataFrame, DataFrame]:
    """(outcome per inspected row, accepted hashes) of one label whose static reasons and near pairs are known."""
    open_rows = rows.filter("reason is null")
    nodes = materialize(open_rows.groupBy("fp").agg(F.min("rank").alias("rank")))
    accepted = independent_nodes(nodes, edges)
    # The quota is cut at a rank found over ranges of ranks, not by ordering all accepted nodes in one task.
    placed = global_rank(accepted.withColumnRenamed("rank", "order_key"), "order_key")
    taken = materialize(placed.filter(F.col("rank") <= quota).select("fp", F.col("order_key").alias("rank")))
    last = taken.agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank")).first()
    inspected = rows
    if last["n"] >= quota:  # the walk stops at the candidate that fills the quota
        cut = taken.agg(F.max("rank").alias("_cut"))
        inspected = rows.crossJoin(F.broadcast(cut)).filter("rank <= _cut").drop("_cut")
    chosen = taken.join(open_rows.select("fp", "rank", "sha"), ["fp", "rank"]).select(F.col("rank"), "sha")
    chosen = materialize(chosen)
    marked = (
        inspected.join(chosen.select("rank", F.lit(True).alias("_chosen")), "rank", "left")
        .join(chosen.select("sha", F.lit(True).alias("_copied")), "sha", "left"))
    outcome = (F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_chosen"), None)
               .when(F.col("_copied"), REJECT_EXACT).otherwise(REJECT_NEAR))
    return marked.withColumn("reason", outcome).drop("_chosen", "_copied"), chosen.select("sha")


def governed_selection(candidates: DataFrame, current: DataFrame, needed: dict, priority: Sequence,
                       rank: Sequence[Column | str], k: int = 2, bits: int = 64) -> DataFrame:
    """Every inspected candidate with ``selected`` and, where turned down, the ``reason``.

    ``candidates`` need label, sha, fp, readable, tiny_or_invalid and quality_pass; ``rank`` must
    order them totally. ``current`` holds the ``sha`` of the rows already in the table, ``needed`` the
    number of rows wanted per label (labels that need none are not inspected).
    """
    ranked = candidates.withColumn("rank", F.struct(*rank))
    known = current.select("sha").distinct().withColumn("_known", F.lit(True))
    gated = ranked.join(known, "sha", "left").withColumn(
        "reason",
        F.when(~F.col("readable") | F.col("tiny_or_invalid"), REJECT_INVALID)
        .when(~F.col("quality_pass"), REJECT_QUALITY)
        .when(F.col("_known"), REJECT_CURRENT)).drop("_known")
    gated = materialize(gated.filter(F.col("label").isin(*priority)))
    # Near pairs of all labels at once; what an earlier label takes away only removes ends of them.
    near = materialize(near_pairs(gated.filter("reason is null"), ["label"], "fp", k, bits).select("label", "fp_a", "fp_b"))
    results, taken = None, None
    for label in priority:
        quota = needed.get(label, 0)
        if quota <= 0:
            continue
        rows = gated.filter(F.col("label") == label)
        if taken is not None:
            earlier = taken.distinct().withColumn("_taken", F.lit(True))
            rows = rows.join(earlier, "sha", "left").withColumn(
                "reason", F.coalesce("reason", F.when(F.col("_taken"), REJECT_EXACT))).drop("_taken")
            rows = materialize(rows)
        outcome, hashes = _select_label(rows, near.filter(F.col("label") == label).select("fp_a", "fp_b"), quota)
        results = outcome if results is None else results.unionByName(outcome)
        taken = hashes if taken is None else taken.unionByName(hashes)
    if results is None:
        return gated.limit(0).withColumn("selected", F.lit(False))
    return results.withColumn("selected", F.col("reason").isNull())


def needed_rows(current: DataFrame, totals: dict[int, int], label: str = "label") -> dict[int, int]:
    """Rows still wanted per target label."""
    counts = {r[label]: r["count"] for r in current.filter(F.col(label).isin(*totals)).groupBy(label).count().collect()}
    return {k: max(0, total - counts.get(k, 0)) for k, total in totals.items()}


def selection_outputs(results: DataFrame) -> dict[str, DataFrame]:
    """The five outputs: selected, clean (selected with details), rejected, duplicates, quality."""
    copies = [REJECT_CURRENT, REJECT_EXACT, REJECT_NEAR]
    status = F.lit("unique").alias("duplicate_status")
    return {
        "selected": results.filter("selected").select("label", "sha", "rank"),
        "clean": results.filter("selected").select("*", status),
        "rejected": results.filter("not selected"),
        "duplicates": results.filter(F.col("reason").isin(*copies)),
        "quality": results.drop("selected", "reason"),
    }
