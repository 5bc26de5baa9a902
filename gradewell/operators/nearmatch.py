"""Near-duplicate fingerprints: all pairs within a Hamming distance, without comparing all pairs.

Bits are cut into blocks. Two fingerprints at distance <= k agree on all blocks but k, so they share
at least one of the keys made by leaving k blocks out. Equal keys are brought together by an
equi-join and verified; a pair is emitted only under its first common key, so nothing has to be made
distinct afterwards.

Copies of one fingerprint are collapsed before the join: the result has one row per pair of distinct
fingerprints with the number of rows behind each. Keys shared by very many fingerprints are split
further: the bits such a key leaves open are cut into blocks again, of which a near pair must agree on all
but k. That holds for every k and drops nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.session import store

HOT_KEY = 4096


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def leave_out(bits: Sequence[int], k: int, blocks: int) -> list[int]:
    """One mask of the kept bits per way of leaving out k of the blocks."""
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[edges[i]:edges[i + 1]]) for i in range(blocks)]
    return [sum(parts[i] for i in range(blocks) if i not in dropped) for dropped in combinations(range(blocks), k)]


def key_masks(bits: int, k: int, blocks: int | None = None) -> list[int]:
    """One mask per way of leaving out k of the blocks. More blocks make fewer, longer common keys."""
    blocks = blocks or (5 if k == 2 else k + 1)
    if not k < blocks <= bits:
        raise ValueError("the number of blocks must lie between the distance and the number of bits")
    return [signed(m) for m in leave_out(range(bits), k, blocks)]


def split_masks(bits: int, k: int, mask: int) -> list[int]:
    """Longer keys for one key mask: its own bits and all but k blocks of the others."""
    open_bits = [b for b in range(bits) if not mask >> b & 1]
    blocks = min(len(open_bits), 5 if k == 2 else k + 2 if k < 6 else k + 1)
    if blocks <= k:
        return [mask]
    return [signed(m | mask & ((1 << 64) - 1)) for m in leave_out(open_bits, k, blocks)]


def mask_array(masks: Sequence[int]) -> str:
    return "array(" + ",".join(f"{m}L" if m > -(1 << 63) else "(-9223372036854775807L - 1L)" for m in masks) + ")"


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(df: DataFrame, by: Sequence[str], fingerprint: str, k: int = 2, bits: int = 64,
               blocks: int | None = None, hot_key: int = HOT_KEY) -> DataFrame:
    """(by, fp_a, fp_b, distance, n_a, n_b) for distinct fingerprints fp_a < fp_b of one group."""
    by = list(by)
    masks = key_masks(bits, k, blocks)
    finer = [split_masks(bits, k, m) for m in masks]
    # Read several times below: written once, so that fingerprints are not computed again from their source.
    counted = store(df.groupBy(*by, F.col(fingerprint).alias("fp")).agg(F.count(F.lit(1)).alias("n")))
    keyed = counted.select(*by, "fp", "n", F.posexplode(F.expr(f"transform({mask_array(masks)}, m -> fp & m)")).alias("key_no", "key"))
    common = [*by, "key_no", "key"]
    hot = store(keyed.groupBy(*common).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > hot_key).drop("_size"))
    cold = keyed.join(hot, common, "left_anti")
    sub_keys = "case key_no " + " ".join(f"when {i} then {mask_array(f)}" for i, f in enumerate(finer)) + " end"
    split = keyed.join(hot, common, "left_semi").select(
        *by, "key_no", "fp", "n", F.posexplode(F.expr(f"transform({sub_keys}, m -> fp & m)")).alias("sub_no", "sub_key"))

    def first_of(array: str) -> Column:
        """Number of the first mask under which the two agree."""
        return F.expr(f"array_position(transform({array}, m -> (fp_a ^ fp_b) & m = 0), true) - 1")

    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))

    def joined(rows: DataFrame, on: Sequence[str]) -> DataFrame:
        left = rows.select(*on, F.col("fp").alias("fp_a"), F.col("n").alias("n_a"))
        right = rows.select(*on, F.col("fp").alias("fp_b"), F.col("n").alias("n_b"))
        return left.join(right, list(on)).filter((F.col("fp_a") < F.col("fp_b")) & (near <= k)).filter(
            first_of(mask_array(masks)) == F.col("key_no"))

    pairs = joined(cold, common)
    crowded = joined(split, [*by, "key_no", "sub_no", "sub_key"]).filter(first_of(sub_keys) == F.col("sub_no"))
    names = [*by, "fp_a", "fp_b", near.alias("distance"), "n_a", "n_b"]
    return pairs.select(*names).unionByName(crowded.select(*names))


def near_pair_totals(df: DataFrame, by: Sequence[str], fingerprint: str, k: int = 2, **layout) -> DataFrame:
    """Row pairs within the distance per group: across fingerprints and between copies of one."""
    pairs = near_pairs(df, by, fingerprint, k, **layout)
    across = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("fingerprint_pairs"), F.sum(F.col("n_a") * F.col("n_b")).alias("_rows"))
    copies = df.groupBy(*by, F.col(fingerprint).alias("fp")).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fingerprints"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("copy_pairs"))
    return copies.join(across, list(by), "left").select(
        *by, "n_fingerprints", F.coalesce("fingerprint_pairs", F.lit(0)).alias("fingerprint_pairs"), "copy_pairs",
        (F.coalesce("_rows", F.lit(0)) + F.col("copy_pairs")).alias("row_pairs"))
