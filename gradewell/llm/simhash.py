"""Near-duplicate feedback texts: SimHash fingerprints linked by pigeonring filtering.

Fingerprints are cut into ``segments`` on a ring. If two of them differ in at most k bits, there is a segment from which
every chain of consecutive segments stays within its proportional budget: the first l segments differ in at most
floor(l * k / segments) bits together, for every l. With more segments than k the first segment must be equal and the
second may differ in one bit at most, and so on. Candidates meet by an equi-join on (start, first segment, second
segment with up to its budget of bits flipped); the whole chain is then required before the full Hamming check.

Copies are collapsed to one row per distinct fingerprint before anything is compared. Where more than ``crowded``
fingerprints share a join key, they aren't compared in pairs: every fingerprint of such a key names all values within
k/2 bits of it that keep the key, and those that name one value are linked to the least of them. Two fingerprints within
k bits with that key always name a common value, so this is exact, and linear in the members, however many they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import per_batch
from gradewell.session import store

BITS = 64
CROWDED = 256
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence where there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, of = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([of(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(found) - words + 1].tolist()
    return np.fromiter((of(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:].tolist())), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 without words."""
    hashes = shingle_hashes(text, words, seed)
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def feedback_fingerprints(feedback: DataFrame, key: str = "session_id", text: str = "free_text_feedback", words: int = 4, seed: int = 42) -> DataFrame:
    """(key, fingerprint bigint) of every whole text, row by row. A-Z count as a-z, words are runs without ASCII blanks.

    Null, empty and blank texts have fingerprint 0. Other columns are not read, whatever their names.
    """
    kind = feedback.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        prints = np.array([fingerprint(t, words, seed) for t in rows["text"]], np.uint64)
        return {"key": rows["key"], "fingerprint": prints.view(np.int64)}

    return per_batch(feedback, {"key": key, "text": text}, f"key {kind}, fingerprint bigint", work, weigh="text").withColumnRenamed("key", key)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def ring(segments: int) -> list[list[int]]:
    """Bits of every segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [list(range(edges[i], edges[i + 1])) for i in range(segments)]


def mask(bits: Sequence[int]) -> int:
    return signed(sum(1 << b for b in bits))


def flips(bits: Sequence[int], most: int) -> list[int]:
    return [mask(chosen) for n in range(most + 1) for chosen in combinations(bits, n)]


def near_links(prints: DataFrame, k: int = 4, segments: int = 5, crowded: int = CROWDED, column: str = "fingerprint") -> DataFrame:
    """(a, b) links between distinct fingerprints whose connected components are those of all pairs within k bits.

    Every link is a path of pairs within k bits. Not every pair is named: in crowded keys a spanning set is. Null
    fingerprints take no part. ``segments`` must be more than k, so that a chain starts with an equal segment.
    """
    if k % 2 or not k < segments <= BITS:
        raise ValueError("k must be even, and segments lie between k and the number of bits")
    parts = ring(segments)
    distinct = store(prints.filter(F.col(column).isNotNull()).select(F.col(column).alias("fp")).distinct())

    def keyed(spare: int) -> DataFrame:
        """One row per start and variant: the first segment as it is, the second with up to ``spare`` bits flipped."""
        rows = []
        for i, bits in enumerate(parts):
            following = parts[(i + 1) % segments]
            both = mask([*bits, *following])
            rows.append(F.expr(f"transform({lit_text(flips(following, spare))}, m -> named_struct('start', {i}, 'key', (fp ^ m) & {lit_number(both)}))"))
        return distinct.select("fp", F.inline(F.concat(*rows)))

    spare = 2 * k // segments
    asked, given = keyed(spare), keyed(0)
    sizes = given.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n"))
    full = store(sizes.filter(F.col("n") > crowded).select("start", "key"))

    apart = F.expr("a ^ b")
    budgets = []
    for i in range(segments):
        chain = [[b for j in range(length) for b in parts[(i + j) % segments]] for length in range(1, segments + 1)]
        budgets.append(" and ".join(f"bit_count((a ^ b) & {lit_number(mask(bits))}) <= {(n + 1) * k // segments}" for n, bits in enumerate(chain)))
    chains = F.expr("case start " + " ".join(f"when {i} then {b}" for i, b in enumerate(budgets)) + " end")
    sparse = given.join(full, ["start", "key"], "left_anti")
    pairs = (
        asked.select("start", "key", F.col("fp").alias("a")).join(sparse.select("start", "key", F.col("fp").alias("b")), ["start", "key"])
        .filter("a <> b").filter(chains).filter(F.bit_count(apart) <= k)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    # Crowded keys: whoever meets the key names values that keep it; whoever flipped bits to meet it has that many fewer left.
    outside = [[b for b in range(BITS) if b not in {*parts[i], *parts[(i + 1) % segments]}] for i in range(segments)]
    members = asked.join(full, ["start", "key"], "left_semi").withColumn("used", F.bit_count(F.expr(f"(fp ^ key) & ({both_masks(parts)})")))
    near = F.expr("case " + " ".join(
        f"when start = {i} and used = {used} then {lit_text(flips(bits, k // 2 - used))}"
        for i, bits in enumerate(outside) for used in range(min(spare, k // 2) + 1)) + " end")
    named = members.select("start", "fp", F.expr(f"(fp & ~({both_masks(parts)})) | key").alias("moved"), F.explode(near).alias("m")).select(
        "start", "fp", F.expr("moved ^ m").alias("value"))
    joint = named.groupBy("start", "value").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("start", "value", "a")
    linked = named.join(joint, ["start", "value"]).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(linked).distinct()


def both_masks(parts: list[list[int]]) -> str:
    """SQL for the bits of a start's first two segments."""
    return "case start " + " ".join(f"when {i} then {lit_number(mask([*bits, *parts[(i + 1) % len(parts)]]))}" for i, bits in enumerate(parts)) + " end"


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component.

    Alternates two joins that pull every node to its least neighbour, the larger ones first, until nothing changes;
    the number of rounds grows with the logarithm of the longest chain. Every round is a stored table.
    """
    edges = store(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "u", "m")
        edges = store(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def group_table(prints: DataFrame, key: str, k: int, segments: int, crowded: int) -> DataFrame:
    """(fp, component_id): for every distinct fingerprint the least key, nulls apart, in its component."""
    roots = components(near_links(prints, k, segments, crowded))
    per_print = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least_key"))
    with_root = per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = with_root.groupBy("root").agg(F.min("least_key").alias("component_id"))
    return with_root.join(ids, "root").select("fp", "root", "component_id")


def near_duplicate_groups(feedback: DataFrame, key: str = "session_id", text: str = "free_text_feedback", words: int = 4, seed: int = 42,
                          k: int = 4, segments: int = 5, crowded: int = CROWDED) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) for every feedback row.

    ``component_id`` is the least key reachable over links of at most ``k`` differing bits, a text's own key included.
    Texts without words (null, empty, blank) have fingerprint zero and are linked like any other. Rows with a null key
    take part; their key is never a component's id unless it has no other (then the id is null). Repeated rows are all
    returned. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    prints = store(feedback_fingerprints(feedback, key, text, words, seed))
    groups = group_table(prints, key, k, segments, crowded)
    return prints.join(groups.select(F.col("fp").alias("fingerprint"), "component_id"), "fingerprint").select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(feedback: DataFrame, key: str = "session_id", text: str = "free_text_feedback", words: int = 4, seed: int = 42,
                       k: int = 4, segments: int = 5, crowded: int = CROWDED) -> DataFrame:
    """The rows of ``feedback`` whose key is the least of their near-duplicate group, one row for each group.

    Where the least key stands on several rows (or all keys are null) one of them stays. Columns are unchanged.
    """
    @F.pandas_udf("bigint")
    def prints_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    # Row numbers are written with the rows, so they stay what they are; texts move once, by row number.
    held = store(feedback.withColumns({"_fp": prints_of(feedback[text]), "_row": F.monotonically_increasing_id()}))
    narrow = held.select(F.col(key).alias("key"), F.col("_fp").alias("fingerprint"), "_row")
    groups = group_table(narrow, "key", k, segments, crowded).select(F.col("fp").alias("fingerprint"), "root")
    least = F.min(F.struct(F.col("key").isNull(), "key", "_row"))
    per_print = narrow.groupBy("fingerprint").agg(least.alias("first"))
    kept = per_print.join(groups, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return held.join(kept.hint("shuffle_hash"), "_row", "left_semi").select(*feedback.columns)


def lit_number(value: int) -> str:
    return f"{value}L" if value > -(1 << 63) else "(-9223372036854775807L - 1L)"


def lit_text(values: Sequence[int]) -> str:
    return "array(" + ",".join(lit_number(v) for v in values) + ")"
