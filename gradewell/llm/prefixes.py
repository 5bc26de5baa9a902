"""Prefix trie of conversations: what a cache of shared beginnings would save, node by node.

The project keeps no dialogues, so the operator is general: turns (conv_id, turn, role, text).

1. Turns get their place in the conversation and a digest. A prefix has the sum of 128-bit digests of its (place, turn) pairs,
   found as running sums over ranges of (conversation, place): a conversation of any length spreads over tasks.
2. Distinct prefix digests are the nodes. Each is checked: all its rows must have the same last turn (SHA-256) and the same
   parent, so by induction the same turns; a collision is an error.
3. A node of one conversation is known at once (one leaf, nothing saved). The others are dealt into shards that are
   whole subtrees of at most about ``shard_rows`` turns; the few nodes above them form the top.
4. A shard gives its digests the slots of a minimal perfect hash, verified against the stored digests, scatters counts into flat
   arrays and adds them up through an array of parent slots, deepest level first. Subtree sums go to the top,
   which does the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.operators.ordering import cumulative_by_value
from gradewell.session import settle, store

SHARD_ROWS = 200_000
TOP_SHARE = 1024
IDS_PER_CHUNK = 4096
LANES = 4
NODE = ["hi", "lo"]
EMPTY = hashlib.sha256(b"").hexdigest()
GAMMA = 1.5
RESULT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


# Minimal perfect hash ------------------------------------------------------------------------------------------------

def level_hash(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (hi.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> np.uint64(31))) + lo.view(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class SlotTable:
    """Slots 0 .. n - 1 of n distinct digests; a digest that is not in the table has slot -1.

    Level by level, digests that are alone at their place of a bit array stay there, the rest goes on to the next level. The
    slot is the number of set bits before the place. Digests are stored at their slots, so every look-up is verified.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels, self.before, placed = [], [], 0
        left = np.arange(len(hi))
        slots = np.empty(len(hi), np.int64)
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("repeated digests have no perfect hash")
            size = max(4, int(len(left) * GAMMA))
            at = level_hash(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            slots[left[alone[at]]] = placed + rank[at[alone[at]]]
            self.levels.append(alone)
            self.before.append(placed + rank)
            placed += int(alone.sum())
            left = left[~alone[at]]
        self.hi, self.lo = np.empty(len(hi), np.int64), np.empty(len(hi), np.int64)
        self.hi[slots], self.lo[slots] = hi, lo
        if not (np.array_equal(np.sort(slots), np.arange(len(hi))) and np.array_equal(self.slots(hi, lo), slots)):
            raise ValueError("slots are not a permutation")

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (alone, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = level_hash(hi[left], lo[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        found = out >= 0
        found[found] = (self.hi[out[found]] == hi[found]) & (self.lo[out[found]] == lo[found])
        return np.where(found, out, -1)


def add_up(nodes: pa.Table) -> pa.Table:
    """``nodes`` with n_children, n_leaves and saved_tokens summed over those of their descendants that are in the table.

    The given values of the three columns are what lies outside of the table; parents outside of it get nothing.
    """
    hi, lo, up_hi, up_lo, depth, n, words = (nodes.column(c).to_numpy() for c in ("hi", "lo", "parent_hi", "parent_lo", "depth", "n_convs", "words"))
    table = SlotTable(hi, lo)
    slot = table.slots(hi, lo)
    parent, level, own = (np.empty(len(slot), np.int64) for _ in range(3))
    children, leaves, saved = (np.empty(len(slot), np.int64) for _ in range(3))
    parent[slot] = np.where(depth > 0, table.slots(up_hi, up_lo), -1)
    level[slot], own[slot] = depth, (n - 1) * words
    for array, name in ((children, "n_children"), (leaves, "n_leaves"), (saved, "saved_tokens")):
        array[slot] = nodes.column(name).to_numpy()
    inside = parent >= 0
    np.add.at(children, parent[inside], 1)
    leaves[children == 0] += 1
    saved += own
    order = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for these in np.split(order, cuts):
        these = these[parent[these] >= 0]
        np.add.at(leaves, parent[these], leaves[these])
        np.add.at(saved, parent[these], saved[these])
    for name, values in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
        nodes = nodes.set_column(nodes.schema.get_field_index(name), name, pa.array(values[slot]))
    return nodes.append_column("outside", pa.array((parent < 0)[slot]))


# Prefixes ------------------------------------------------------------------------------------------------------------

def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, said, words): turns with their place from 1, the SHA-256 of role and text, and the words of the text."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(turns["turn"].alias("turn"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("said"),
                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")).alias("item"),
        F.lit(1).cast("bigint").alias("n"))
    ranked = cumulative_by_value(rows, ["conv_id"], "item", ["n"])
    return ranked.select("conv_id", F.explode(F.sequence(F.col("n_below") + 1, F.col("n_below") + F.col("n"))).alias("place"), "item.said", "item.words")


def rebuilt_turns(turns: DataFrame, donor: Column, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, total, said, words) and conversations (conv_id, total) after a change of beginnings.

    The first ``heads`` turns of conversation ``donor`` (all if it has fewer, none if it is absent) stand in place of
    the conversation's own first ``heads`` turns. Both are expressions over ``conv_id``.
    """
    own = store(placed_turns(turns))
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("size"))
    convs = sizes.withColumns({"donor": donor, "heads": heads.cast("bigint")})
    given = convs.alias("c").join(sizes.select(F.col("conv_id").alias("donor"), F.col("size").alias("donor_size")), "donor", "left")
    convs = store(given.select("conv_id", "donor", "heads", F.least("heads", F.coalesce("donor_size", F.lit(0))).alias("taken"),
                               (F.least("heads", F.coalesce("donor_size", F.lit(0))) + F.greatest(F.col("size") - F.col("heads"), F.lit(0))).alias("total")))
    most = convs.agg(F.max("heads")).first()[0] or 0
    heads_of = own.filter(F.col("place") <= most).withColumnRenamed("conv_id", "donor")
    taken = convs.join(heads_of, "donor").filter("place <= taken").select("conv_id", F.col("place").alias("depth"), "total", "said", "words")
    rest = own.join(convs, "conv_id").filter("place > heads").select("conv_id", (F.col("taken") + F.col("place") - F.col("heads")).alias("depth"), "total", "said", "words")
    return taken.unionByName(rest), convs.select("conv_id", "total")


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Rows with the digest of the prefix that ends with them (hi, lo) and of the one before (parent_hi, parent_lo)."""
    lanes = [f"lane{i}" for i in range(LANES)]
    digest = F.sha2(F.concat_ws("|", F.col("depth").cast("string"), F.col("said")).cast("binary"), 256)
    items = rows.select("conv_id", F.struct("depth", "total", "said", "words").alias("item"), digest.alias("digest")).select(
        "conv_id", "item", *[F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint").alias(lane) for i, lane in enumerate(lanes)])
    # Lanes of 32 bits, so that sums over two thousand million turns cannot overflow.
    sums = cumulative_by_value(items, ["conv_id"], "item", lanes)

    def pair(of) -> list[Column]:
        low = [F.expr(f"{of(lane)} & 4294967295") for lane in lanes]
        return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]

    here, above = pair(lambda x: f"({x} + {x}_below)"), pair(lambda x: f"{x}_below")
    return sums.select("conv_id", "item.*", here[0].alias("hi"), here[1].alias("lo"), above[0].alias("parent_hi"), above[1].alias("parent_lo"))


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """One row per prefix digest, checked: equal digests have equal last turns and equal parents."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("said", "parent_hi", "parent_lo", "depth") for n, f in (("min", F.min), ("max", F.max))]
    nodes = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"),
                                    F.sum(F.col("total") - F.col("depth") + 1).alias("below"), F.max(F.col("total") > F.col("depth")).alias("goes_on"), *ends)
    same = " and ".join(f"{c}_min = {c}_max" for c in ("said", "parent_hi", "parent_lo", "depth"))
    sound = F.when(F.expr(same), F.col("depth_min")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("bigint"))
    return nodes.select(*NODE, sound.alias("depth"), F.col("parent_hi_min").alias("parent_hi"), F.col("parent_lo_min").alias("parent_lo"),
                        "conv_id", "n_convs", "words", "below", "goes_on")


def ends_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of nodes at which conversations end.

    Ids are joined to strings of at most ``IDS_PER_CHUNK`` neighbouring ids in parallel; only these strings meet, in order, and
    are hashed as a stream, one at a time.
    """
    ends = rows.filter("depth = total").select(*NODE, "conv_id").unionByName(
        convs.filter("total = 0").select(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"), "conv_id"))
    chunk = F.floor(F.col("conv_id") / IDS_PER_CHUNK)
    chunks = ends.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
                if (hi, lo) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, state.hexdigest()), schema)], schema=schema)

    return ordered.select(*NODE, "ids").mapInArrow(digest, "hi bigint, lo bigint, ends_sha256 string")


SUMS = "hi bigint, lo bigint, parent_hi bigint, parent_lo bigint, depth bigint, conv_id bigint, n_convs bigint, words bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
SUM_NAMES = [c.split()[0] for c in SUMS.split(", ")]


def summed(nodes: DataFrame, shard: Column) -> DataFrame:
    return nodes.select(shard.alias("shard"), *SUM_NAMES).groupBy("shard").applyInArrow(
        lambda t: add_up(t.drop_columns(["shard"])), f"{SUMS}, outside boolean")


def prefix_trie(turns: DataFrame, donor: Column | None = None, heads: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id (integer), turn, role and text. Turns stand in the order of ``turn``, null first, turns of one number in
    the order of their digests; a null role or text counts as empty; rows without a conv_id belong to no conversation;
    repeated rows are turns of their own. ``donor`` and ``heads`` (expressions over conv_id) let each conversation
    begin with turns of another one, see :func:`rebuilt_turns`; by default nothing is changed. Other columns are not read,
    whatever their names. Without conversations there is no node, not even the root.

    A node's ``conv_id`` is its smallest member, ``saved_tokens`` sums (members - 1) times the words of the last text over the
    node and all below it, and ``ends_sha256`` is taken over the ids of the conversations that end there, ascending, joined
    by commas.
    """
    donor, heads = (F.col("conv_id") if donor is None else donor), (F.lit(0) if heads is None else heads)
    rows, convs = rebuilt_turns(turns, donor, heads)
    rows, convs = store(with_prefixes(rows)), settle(convs)
    nodes = store(distinct_nodes(rows))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("total").alias("below")).first()
    spark = turns.sparkSession
    if not root["n_convs"]:
        return spark.createDataFrame([], RESULT)
    top_node = spark.createDataFrame([(0, 0, 0, 0, 0, root["conv_id"], root["n_convs"], 0, root["below"] + 1)],
                                     "hi bigint, lo bigint, depth bigint, parent_hi bigint, parent_lo bigint, conv_id bigint, n_convs bigint, words bigint, below bigint")
    shared = store(nodes.filter("n_convs > 1").drop("goes_on").unionByName(top_node))
    single = nodes.filter("n_convs = 1 and depth > 0").withColumns({
        "n_children": F.col("goes_on").cast("bigint"), "n_leaves": F.lit(1).cast("bigint"), "saved_tokens": F.lit(0).cast("bigint")})

    # What the conversations that leave the shared part bring to the node where they leave it.
    leaving = single.select(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).groupBy(*NODE).agg(F.count(F.lit(1)).alias("own_children"))
    shared = store(shared.join(leaving, NODE, "left").select(
        *[c for c in shared.columns], F.coalesce("own_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.coalesce("own_children", F.lit(0)).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")))

    # Subtrees of at most ``limit`` turns are dealt out whole; above them there are at most TOP_SHARE nodes per depth.
    turns_in_all = rows.count()
    limit = max(shard_rows, turns_in_all // TOP_SHARE)
    heavy = F.col("below") > limit
    top = shared.filter(heavy | (F.col("depth") == 0))
    light = shared.filter(~heavy & (F.col("depth") > 0))
    # Shared nodes have several members, so each lies on the path of its smallest one; below a light node all are light.
    roots = rows.select("conv_id", "depth", *NODE).join(light.select(*NODE), NODE, "left_semi").groupBy("conv_id").agg(
        F.min(F.struct("depth", *NODE)).alias("root"))
    shards = max(1, 4 * turns_in_all // limit)
    light = light.join(roots, "conv_id")
    below = store(summed(light, F.pmod(F.xxhash64("root.hi", "root.lo"), F.lit(shards))))
    hanging = below.filter("outside").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    top = top.join(hanging, NODE, "left").withColumns({
        "n_children": F.col("n_children") + F.coalesce("c", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)),
        "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))})
    above = summed(top, F.lit(0))

    whole = below.select(*SUM_NAMES).unionByName(above.select(*SUM_NAMES)).unionByName(single.select(*SUM_NAMES))
    parents = shared.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("shared_parent"))
    # A node of one conversation below another such node has that conversation as its parent's; the root's children need no join.
    below_root = F.col("depth") == 1
    asked = whole.withColumns({"parent_hi": F.when(below_root, F.col("hi")).otherwise(F.col("parent_hi")), "parent_lo": F.when(below_root, F.col("lo")).otherwise(F.col("parent_lo"))})
    found = asked.join(parents, ["parent_hi", "parent_lo"], "left").join(ends_digests(rows, convs), NODE, "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(below_root, F.lit(root["conv_id"])).otherwise(F.coalesce("shared_parent", "conv_id"))
    return found.select("conv_id", "depth", parent.cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
