"""Random forests, extra trees and balanced forests grown from binned features.

Features are cut into at most ``max_bins`` bins once; a row is a label and one byte per feature. Nodes with more than
``local_rows`` draws are split level by level: one aggregation of (tree, node, feature, bin, label) counts per level serves
as many nodes as have ``CELLS_PER_PASS`` cells, and only their counts exist at once. The rows of a smaller node travel, packed, to
one task, which grows everything below it. Both ways evaluate the same counts with the same code, so the trees do not depend on ``local_rows``.

Nothing is drawn from a running generator: how often a tree takes a row is a Poisson number from a hash of (tree, row), the
features tried at a node and the random cuts of extra trees come from hashes of (node, feature).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.operators.profile import medians
from gradewell.session import settle, store

KINDS = ("random_forest", "extra_trees", "balanced_forest")
BIN_SAMPLE = 20_000
LOCAL_ROWS = 500_000
NODES_PER_PASS = 100_000
CELLS_PER_PASS = 4_000_000
ROWS_PER_BLOCK = 10_000
LEAF = -1


def mixed(x: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of unsigned 64-bit numbers."""
    x = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# Bins ----------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """Per feature: ascending cut values (bin b holds values up to cut b) and the value that stands in for missing ones."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    fill: tuple[float, ...]

    def apply(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and ``bins``, one byte per feature; cells that are missing or not finite take the fill value."""
        cells = rows.select(*keep, *[F.col(f).cast("double").alias(f"_b{i}") for i, f in enumerate(self.features)])
        out = rows.select(*keep).withColumn("bins", F.lit(b""))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, f = batch.num_rows, len(self.features)
                codes = np.empty((n, f), np.uint8)
                for i in range(f):
                    values = batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(np.float64)
                    codes[:, i] = np.searchsorted(self.cuts[i], np.where(np.isfinite(values), values, self.fill[i]))
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * f + 1, f, dtype=np.int32)), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], packed], names=[*keep, "bins"])

        return cells.mapInArrow(work, out.schema)


def fit_bins(train: DataFrame, features: Sequence[str], key: Sequence[str], max_bins: int = 64) -> Bins:
    """Cuts at quantiles of the ``BIN_SAMPLE`` rows of least key hash (all rows, if there are no more)."""
    if not 2 <= max_bins <= 256:
        raise ValueError("2 to 256 bins")
    fill = {r["feature"]: float(r["median"] or 0.0) for r in medians(train, features).collect()}
    sample = train.select(F.xxhash64(*key).alias("_h"), *[F.col(f).cast("double").alias(f) for f in features]).orderBy("_h", *features).limit(BIN_SAMPLE).toPandas()
    cuts = []
    for f in features:
        values = sample[f].to_numpy()
        values = np.sort(np.where(np.isfinite(values), values, fill[f]))
        picked = values[np.arange(1, max_bins) * len(values) // max_bins] if len(values) else values
        cuts.append(np.unique(picked[picked < values[-1]]) if len(values) else values)
    return Bins(tuple(features), tuple(cuts), tuple(fill[f] for f in features))


def bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, width), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, first).reshape(-1, width)


# Trees ---------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Growth:
    """How trees grow. ``rates`` are the expected draws of a row of each class (empty: every row once).

    ``columns`` are the places in a row's ``width`` bytes of the features that the trees may use.
    """

    n_trees: int
    classes: int
    width: int
    columns: tuple[int, ...]
    tried: int
    class_weights: tuple[float, ...]
    rates: tuple[float, ...] = ()
    random_cuts: bool = False
    max_depth: int | None = None
    min_leaf: int = 2
    max_bins: int = 64
    seed: int = K.SEED

    @property
    def n_features(self) -> int:
        return len(self.columns)

    def matrix(self, column: pa.Array) -> np.ndarray:
        return bytes_matrix(column, self.width)[:, list(self.columns)]

    def root(self, tree: int) -> np.uint64:
        return mixed(np.uint64(tree) + mixed(self.seed))[0]

    def draws(self, tree: int, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """How often ``tree`` takes each row (given by its hash)."""
        if not self.rates:
            return np.ones(len(rows), np.int64)
        u = uniform(mixed(rows.view(np.uint64) ^ self.root(tree)))
        out = np.zeros(len(rows), np.int64)
        for c, rate in enumerate(self.rates):
            k = np.arange(0, 20 + int(4 * rate))
            steps = np.cumsum(np.exp(-rate + k * np.log(rate) - np.cumsum(np.log(np.maximum(k, 1))))) if rate > 0 else np.ones(1)
            ours = labels == c
            out[ours] = np.minimum(np.searchsorted(steps, u[ours], "right"), k[-1])
        return out

    def splits(self, nodes: np.ndarray, entries, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best (feature, cut bin, gain, class counts to the left) of every node; feature LEAF where no cut is allowed.

        ``nodes`` are ids, ``totals`` their class counts; ``entries(f)`` gives (node number, bin, label, count) of feature f.
        ``tried`` features are compared; further ones are taken, one at a time, while a node has no allowed cut.
        """
        m = len(nodes)
        feature, cut, gain = np.full(m, LEAF), np.zeros(m, np.int64), np.zeros(m)
        left = np.zeros((m, self.classes), np.int64)
        score = np.full(m, -np.inf)
        weights = np.array(self.class_weights)
        parent = self.purity(totals * weights)
        dice = mixed(nodes[:, None] ^ mixed(np.arange(self.n_features, dtype=np.uint64) + np.uint64(1))[None, :])
        place = np.empty(dice.shape, np.int8 if self.n_features < 128 else np.int64)
        np.put_along_axis(place, np.argsort(dice, axis=1, kind="stable"), np.arange(self.n_features, dtype=place.dtype)[None, :], axis=1)
        for step in range(self.tried - 1, self.n_features):
            waiting = feature == LEAF
            if step >= self.tried:
                if not waiting.any():
                    break
                entries = self.narrowed(entries, waiting)
            for f in range(self.n_features):
                chosen = (place[:, f] < self.tried) if step < self.tried else waiting & (place[:, f] == step)
                if not chosen.any():
                    continue
                node, bins, label, count = entries(f)
                if not chosen.all():
                    ours = np.flatnonzero(chosen[node])
                    node, bins, label, count = node[ours], bins[ours], label[ours], count[ours]
                if not len(node):
                    continue
                runs, counts = self.runs(node * self.max_bins + bins.astype(np.int64), label, count, m * self.max_bins)
                owner, run_bin = runs // self.max_bins, runs % self.max_bins
                heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                running = np.cumsum(counts, axis=0)
                runs_held = np.diff(np.append(heads, len(runs)))
                before = running - np.repeat(running[heads] - counts[heads], runs_held, axis=0)
                after = totals[owner] - before
                good = (before.sum(axis=1) >= self.min_leaf) & (after.sum(axis=1) >= self.min_leaf)
                if self.random_cuts:
                    low, high = run_bin[heads], run_bin[np.append(heads[1:], len(runs)) - 1]
                    drawn = np.repeat(low + (uniform(mixed(dice[owner[heads], f])) * (high - low)).astype(np.int64), runs_held)
                    good &= (run_bin <= drawn) & (np.append(run_bin[1:], 0) > drawn)
                value = np.where(good, self.purity(before * weights) + self.purity(after * weights), -np.inf)
                most = np.maximum.reduceat(value, heads)
                best = np.minimum.reduceat(np.where(value == np.repeat(most, runs_held), np.arange(len(runs)), len(runs)), heads)
                to = owner[heads]
                better = most > score[to]
                best, to = best[better], to[better]
                score[to], feature[to], cut[to], left[to] = value[best], f, run_bin[best], before[best]
        found = feature != LEAF
        gain[found] = score[found] - parent[found]
        return feature, cut, gain, left

    @staticmethod
    def narrowed(entries, nodes: np.ndarray):
        """``entries`` of some of the nodes only; each feature is cut down once, when it is asked for."""
        held = {}

        def some(f: int) -> tuple[np.ndarray, ...]:
            if f not in held:
                every = entries(f)
                ours = np.flatnonzero(nodes[every[0]])
                held[f] = tuple(x[ours] for x in every)
            return held[f]

        return some

    def runs(self, key: np.ndarray, label: np.ndarray, count: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ``key`` in order and their counts per class; sorted only where most of all ``keys`` are absent."""
        if keys <= 2 * len(key):
            counts = np.bincount(key * self.classes + label, count, keys * self.classes).reshape(-1, self.classes)
            runs = np.flatnonzero(counts.any(axis=1))
            return runs, counts[runs]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        return key[starts], np.bincount(run_of * self.classes + label[order], count[order], len(starts) * self.classes).reshape(-1, self.classes)

    @staticmethod
    def purity(counts: np.ndarray) -> np.ndarray:
        total = counts.sum(axis=1)
        return (counts ** 2).sum(axis=1) / np.where(total > 0, total, 1)

    def may_split(self, totals: np.ndarray, depth: int) -> np.ndarray:
        deep = self.max_depth is not None and depth >= self.max_depth
        return (totals.sum(axis=1) >= 2 * self.min_leaf) & ((totals > 0).sum(axis=1) > 1) & (not deep)

    def grow(self, root: int, depth: int, bins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Nodes below and including ``root``: ids, lefts, rights, features, cuts, gains, class counts."""
        out = []
        ids = np.array([root], np.uint64)
        where = np.zeros(len(labels), np.int64)
        bins = np.ascontiguousarray(bins.T)
        while len(ids):
            totals = np.bincount(where * self.classes + labels, counts, len(ids) * self.classes).astype(np.int64).reshape(-1, self.classes)
            feature, cut, gain = np.full(len(ids), LEAF), np.zeros(len(ids), np.int64), np.zeros(len(ids))
            able = np.flatnonzero(self.may_split(totals, depth))
            if len(able):
                number = np.full(len(ids), -1)
                number[able] = np.arange(len(able))
                inside = np.flatnonzero(number[where] >= 0)
                if len(inside) < len(where):
                    bins, labels, counts, where = np.take(bins, inside, axis=1), labels[inside], counts[inside], where[inside]
                node = number[where]
                feature[able], cut[able], gain[able], _ = self.splits(ids[able], lambda f: (node, bins[f], labels, counts), totals[able])
            left, right = children(ids)
            out.append([ids, left, right, feature, cut, gain, totals])
            split = np.flatnonzero(feature != LEAF)
            if not len(split):
                break
            number = np.full(len(ids), -1)
            number[split] = np.arange(len(split))
            inside = np.flatnonzero(number[where] >= 0)
            if len(inside) < len(where):
                bins, labels, counts, where = np.take(bins, inside, axis=1), labels[inside], counts[inside], where[inside]
            goes_right = bins[feature[where], np.arange(len(where))] > cut[where]
            where = 2 * number[where] + goes_right
            ids = np.stack([left[split], right[split]], axis=1).ravel()
            depth += 1
        return [np.concatenate(c) for c in zip(*out)]


def children(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(ids * np.uint64(2)), mixed(ids * np.uint64(2) + np.uint64(1))


class Walk:
    """Nodes of one tree, sorted by id; rows walk down to the last node that is known."""

    def __init__(self, ids: np.ndarray, left: np.ndarray, right: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
        self.order = np.argsort(ids)
        self.ids, self.feature, self.cut = ids[self.order], feature[self.order].astype(np.int64), cut[self.order].astype(np.int64)
        self.left, self.right = (self.find(x[self.order]) for x in (left, right))
        self.left_id, self.right_id = left[self.order], right[self.order]

    def find(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def down(self, root: np.uint64, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the id it ends at, and the place of that node (-1: it is not in the table)."""
        start = self.find(np.array([root], np.uint64))[0] if len(self.ids) else -1
        ids, at = np.full(len(bins), root, np.uint64), np.full(len(bins), start)
        moving = np.arange(len(bins))
        while len(moving := moving[at[moving] >= 0]) and len(moving := moving[self.feature[at[moving]] != LEAF]):
            here = at[moving]
            right = bins[moving, self.feature[here]] > self.cut[here]
            ids[moving] = np.where(right, self.right_id[here], self.left_id[here])
            at[moving] = np.where(right, self.right[here], self.left[here])
        return ids, at


NODES = "tree int, node bigint, left bigint, right bigint, feature int, cut int, gain double, counts array<bigint>"


def node_batch(tree: int, columns: Sequence[np.ndarray]) -> pa.Table:
    ids, left, right, feature, cut, gain, totals = columns
    left, right = (np.where(feature == LEAF, np.uint64(0), x) for x in (left, right))  # hashes of children a leaf does not have only cost disk
    n, k = totals.shape
    lists = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(totals.ravel()))
    return pa.table({"tree": pa.array(np.full(n, tree, np.int32)), "node": ids.view(np.int64), "left": left.view(np.int64), "right": right.view(np.int64),
                     "feature": feature.astype(np.int32), "cut": cut.astype(np.int32), "gain": gain, "counts": lists})


class Forest:
    """Grows all trees of a :class:`Growth` over binned rows (row hash, label, bins)."""

    def __init__(self, growth: Growth, rows: DataFrame, local_rows: int, rows_in_all: int) -> None:
        self.growth, self.rows, self.local_rows, self.rows_in_all = growth, rows, local_rows, rows_in_all
        self.top: dict[int, list[tuple]] = {t: [] for t in range(growth.n_trees)}

    def walks(self) -> dict[int, Walk]:
        out = {}
        for tree, nodes in self.top.items():
            ids = np.array([n[0] for n in nodes], np.uint64)
            left, right = children(ids)
            out[tree] = Walk(ids, left, right, np.array([n[1] for n in nodes], np.int64), np.array([n[2] for n in nodes], np.int64))
        return out

    def level(self, frontier: dict[int, list[int]]) -> dict[tuple[int, int], tuple]:
        """(feature, cut, gain, left counts, totals) of the frontier nodes of every tree, by one aggregation."""
        g, walks = self.growth, self.walks()
        cell = g.n_features * g.max_bins * g.classes
        waiting = {t: np.array(sorted(ids), np.uint64) for t, ids in frontier.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {t: np.zeros(len(ids) * cell, np.int64) for t, ids in waiting.items()}
            for batch in batches:
                rows, labels, bins = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), g.matrix(batch.column(2))
                for t, ids in waiting.items():
                    drawn = g.draws(t, rows, labels)
                    node, _ = walks[t].down(g.root(t), bins)
                    at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                    inside = (ids[at] == node) & (drawn > 0)
                    base = at[inside] * cell + labels[inside]
                    for f in range(g.n_features):
                        sums[t] += np.bincount(base + (f * g.max_bins + bins[inside, f].astype(np.int64)) * g.classes, drawn[inside], len(sums[t])).astype(np.int64)
            for t, values in sums.items():
                hit = np.flatnonzero(values)
                yield pa.RecordBatch.from_pydict({"tree": np.full(len(hit), t, np.int32), "cell": hit, "n": values[hit]})

        cells = self.rows.mapInArrow(count, "tree int, cell bigint, n bigint").groupBy("tree", "cell").agg(F.sum("n").alias("n"))

        def split(table: pa.Table) -> pa.Table:
            tree = table.column("tree")[0].as_py()
            at, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
            label, bins, feature, node = at % g.classes, at // g.classes % g.max_bins, at // (g.classes * g.max_bins) % g.n_features, at // cell
            ids = waiting[tree]
            one = feature == 0
            totals = np.bincount(node[one] * g.classes + label[one], n[one], len(ids) * g.classes).astype(np.int64).reshape(-1, g.classes)
            found = g.splits(ids, lambda f: (node[feature == f], bins[feature == f], label[feature == f], n[feature == f]), totals)
            best, cut, gain, left = found
            return pa.table({"tree": pa.array(np.full(len(ids), tree, np.int32)), "node": ids.view(np.int64), "feature": best.astype(np.int32), "cut": cut.astype(np.int32),
                             "gain": gain, "left": pa.array(left.tolist(), pa.list_(pa.int64())), "totals": pa.array(totals.tolist(), pa.list_(pa.int64()))})

        done = cells.groupBy("tree").applyInArrow(split, "tree int, node bigint, feature int, cut int, gain double, left array<bigint>, totals array<bigint>").collect()
        return {(r["tree"], int(np.int64(r["node"]).view(np.uint64))): (r["feature"], r["cut"], r["gain"], np.array(r["left"]), np.array(r["totals"])) for r in done}

    def drawn_rows(self) -> np.ndarray:
        """Draws of every tree by class."""
        g = self.growth

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((g.n_trees, g.classes), np.int64)
            for batch in batches:
                rows, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
                for t in range(g.n_trees):
                    sums[t] += np.bincount(labels, g.draws(t, rows, labels), g.classes).astype(np.int64)
            tree, label = np.divmod(np.arange(sums.size), g.classes)
            yield pa.RecordBatch.from_pydict({"tree": tree.astype(np.int32), "label": label.astype(np.int32), "n": sums.ravel()})

        out = np.zeros((g.n_trees, g.classes), np.int64)
        for r in self.rows.select("row", "label").mapInArrow(count, "tree int, label int, n bigint").groupBy("tree", "label").agg(F.sum("n").alias("n")).collect():
            out[r["tree"], r["label"]] = r["n"]
        return out

    def passes(self, frontier: dict[int, list[int]]) -> Iterator[dict[int, list[int]]]:
        """Parts of the frontier whose counts a task can hold, at least one node each."""
        g = self.growth
        most = max(1, CELLS_PER_PASS // (g.n_features * g.max_bins * g.classes))
        nodes = [(t, node) for t, ids in frontier.items() for node in ids]
        for start in range(0, len(nodes), most):
            part: dict[int, list[int]] = {}
            for t, node in nodes[start:start + most]:
                part.setdefault(t, []).append(node)
            yield part

    def grown(self) -> DataFrame:
        """All nodes of all trees, stored."""
        g, depth, frontier = self.growth, 0, {}
        if self.rows_in_all > self.local_rows // 2:
            totals = self.drawn_rows()
            frontier = {t: [int(g.root(t))] for t in range(g.n_trees) if totals[t].sum() > self.local_rows and g.may_split(totals[t:t + 1], 0)[0]}
        top = []
        depths = {}
        while frontier:
            following: dict[int, list[int]] = {}
            found = {}
            for part in self.passes(frontier):
                found |= self.level(part)
            for (tree, node), (feature, cut, gain, left, total) in found.items():
                ids = np.array([node], np.uint64)
                kids = children(ids)
                top.append((tree, [ids, *kids, np.array([feature]), np.array([cut]), np.array([gain]), total[None, :]]))
                self.top[tree].append((node, feature, cut))
                if feature == LEAF:
                    continue
                for kid, counts in zip(kids, (left, total - left)):
                    depths[int(kid[0])] = depth + 1
                    if counts.sum() > self.local_rows and g.may_split(counts[None, :], depth + 1)[0]:
                        following.setdefault(tree, []).append(int(kid[0]))
            frontier, depth = following, depth + 1
        local = self.grown_locally(depths)
        if not top:
            return store(local)
        known = pa.concat_tables([node_batch(t, c) for t, c in top])  # an Arrow table, so that no session setting matters
        return store(local.unionByName(self.rows.sparkSession.createDataFrame(known, NODES)))

    def grown_locally(self, depths: dict[int, int]) -> DataFrame:
        """Rows of every tree go to the task of the node they stand at, at most ``local_rows`` draws each.

        What a batch sends to a node is one record of bytes, so that Spark neither sorts nor stores single draws.
        """
        g, walks = self.growth, self.walks()

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, labels, bins = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32), g.matrix(batch.column(2))
                for t, walk in walks.items():
                    drawn = g.draws(t, rows, labels)
                    node, at = walk.down(g.root(t), bins)
                    ours = np.flatnonzero((drawn > 0) & (at < 0))
                    ours = ours[np.argsort(node[ours], kind="stable")]
                    ids, starts = np.unique(node[ours], return_index=True)
                    pieces = np.split(ours, starts[1:]) if len(ids) else []
                    yield pa.RecordBatch.from_pydict({
                        "tree": np.full(len(ids), t, np.int32), "node": ids.view(np.int64), "label": pa.array([labels[p].tobytes() for p in pieces], pa.binary()),
                        "n": pa.array([drawn[p].astype(np.int32).tobytes() for p in pieces], pa.binary()), "bins": pa.array([bins[p].tobytes() for p in pieces], pa.binary())})

        def grow(table: pa.Table) -> pa.Table:
            tree, node = table.column("tree")[0].as_py(), np.int64(table.column("node")[0].as_py()).view(np.uint64)
            label, n, bins = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
                              for c, kind in (("label", np.int32), ("n", np.int32), ("bins", np.uint8)))
            found = g.grow(node, depths.get(int(node), 0), bins.reshape(-1, g.n_features), label.astype(np.int64), n.astype(np.int64))
            return node_batch(tree, found)

        return self.rows.mapInArrow(route, "tree int, node bigint, label binary, n binary, bins binary").groupBy("tree", "node").applyInArrow(grow, NODES)


def packer(growth: Growth, width: int):
    """For mapInArrow: rows of ``width`` kept columns and bins as blocks of at most ``ROWS_PER_BLOCK`` rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(start, ROWS_PER_BLOCK)
                kept = pa.Table.from_batches([part]).select(list(range(width)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as writer:
                    writer.write_table(kept)
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "held": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                                  "bins": pa.array([growth.matrix(part.column(width)).tobytes()], pa.binary())})
                number += 1
    return pack


# Models --------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ForestModel:
    """Stored nodes of a forest and the bins of its features."""

    bins: Bins
    growth: Growth
    nodes: DataFrame

    def votes(self, binned: DataFrame, keep: Sequence[str], nodes_per_pass: int = NODES_PER_PASS) -> DataFrame:
        """``keep`` with ``prob``: the mean over all trees of the weighted class shares at the leaf.

        The rows, packed in blocks, go to the tasks that hold the trees, each ``nodes_per_pass`` nodes or one tree; a block's sums
        of all trees then meet in one task. So no task holds the forest, and neither the driver nor a broadcast does.
        """
        g = self.growth
        held = binned.select(*keep)
        packed = store(binned.select(*keep, "bins").mapInArrow(packer(g, len(keep)), "block bigint, held binary, bins binary"))
        sizes = {r["tree"]: r["n"] for r in self.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
        pass_of, last, nodes_held = [], 0, 0
        for t in range(g.n_trees):
            if nodes_held and nodes_held + sizes.get(t, 0) > nodes_per_pass:
                last, nodes_held = last + 1, 0
            pass_of.append(last)
            nodes_held += sizes.get(t, 0)
        passes = binned.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("pass"))
        weights = np.array(g.class_weights)

        def score(blocks: pa.Table, nodes: pa.Table) -> pa.Table:
            bins = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, g.n_features) for x in blocks.column("bins")]
            sums = [np.zeros((len(b), g.classes)) for b in bins]
            tree = nodes.column("tree").to_numpy()
            fields = [nodes.column(c).to_numpy() for c in ("node", "left", "right", "feature", "cut")]
            counts = nodes.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, g.classes) * weights
            counts = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
            for t in np.unique(tree):
                ours = tree == t
                walk = Walk(*[x[ours].view(np.uint64) for x in fields[:3]], *[x[ours] for x in fields[3:]])
                shares = counts[ours][walk.order]
                for total, b in zip(sums, bins):
                    total += shares[walk.down(g.root(int(t)), b)[1]]
            return pa.table({"pass": blocks.column("pass"), "block": blocks.column("block"), "sums": pa.array([x.tobytes() for x in sums], pa.binary())})

        def finish(scored: pa.Table, rows: pa.Table) -> pa.Table:
            kept = pa.ipc.open_stream(rows.column("held")[0].as_buffer()).read_all()
            prob = np.zeros((kept.num_rows, g.classes))
            sums = scored.column("sums")
            for at in np.argsort(scored.column("pass").to_numpy()):
                prob += np.frombuffer(sums[int(at)].as_buffer(), np.float64).reshape(-1, g.classes)
            prob /= g.n_trees
            lists = pa.ListArray.from_arrays(np.arange(0, prob.size + 1, g.classes, dtype=np.int32), pa.array(prob.ravel()))
            return kept.append_column("prob", lists)

        sent = packed.select("block", "bins").join(F.broadcast(passes))
        dealt = self.nodes.withColumn("pass", F.array(*[F.lit(p) for p in pass_of])[F.col("tree")])
        scored = sent.groupBy("pass").cogroup(dealt.groupBy("pass")).applyInArrow(score, "pass int, block bigint, sums binary")
        schema = held.withColumn("prob", F.lit(None).cast("array<double>")).schema
        return scored.groupBy("block").cogroup(packed.select("block", "held").groupBy("block")).applyInArrow(finish, schema)

    def predictions(self, rows: DataFrame, keep: Sequence[str], truth: str | None, labels: Sequence[int]) -> DataFrame:
        """Prediction table as of the other models: kept columns, y_true, y_pred and prob."""
        named = {c: f"_k{i}" for i, c in enumerate(keep)}
        wide = rows.select(*[F.col(c).alias(n) for c, n in named.items()], *([F.col(truth).cast("int").alias("_truth")] if truth else []), *self.bins.features)
        kept = [*named.values(), *(["_truth"] if truth else [])]
        return self.finish(self.votes(self.bins.apply(wide, kept), kept), named, truth, labels)

    @staticmethod
    def finish(voted: DataFrame, named: dict[str, str], truth: str | None, labels: Sequence[int]) -> DataFrame:
        prob = F.array(*[F.coalesce(F.try_element_at("prob", F.lit(i + 1)), F.lit(0.0)) for i in range(len(labels))])
        best = (F.array_position("prob", F.array_max("prob")) - 1).cast("int")
        return voted.select(*[F.col(n).alias(c) for c, n in named.items()], *([F.col("_truth").alias("y_true")] if truth else []), best.alias("y_pred"), prob.alias("prob"))

    def save(self, path: str) -> None:
        """Nodes as Parquet and, beside them, bins and growth as one JSON document."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        document = json.dumps({"features": self.bins.features, "cuts": [c.tolist() for c in self.bins.cuts], "fill": self.bins.fill, "growth": asdict(self.growth)})
        self.nodes.sparkSession.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        d = json.loads(spark.read.text(f"{path}/forest").first()["value"])
        bins = Bins(tuple(d["features"]), tuple(np.array(c, np.float64) for c in d["cuts"]), tuple(d["fill"]))
        growth = Growth(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["growth"].items()})
        return ForestModel(bins, growth, spark.read.schema(NODES).parquet(f"{path}/nodes"))

    def importance(self) -> DataFrame:
        """(feature, score): mean over the trees of the share of impurity that each feature's cuts remove."""
        gains = self.nodes.filter(F.col("feature") >= 0).groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        totals = gains.groupBy("tree").agg(F.sum("gain").alias("total"))
        share = gains.join(totals, "tree").filter("total > 0").groupBy("feature").agg((F.sum(F.col("gain") / F.col("total"))).alias("score"))
        per_feature = share.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", "score"))).alias("m"), F.sum("score").alias("s"))
        names = self.nodes.sparkSession.createDataFrame([(i, self.bins.features[c]) for i, c in enumerate(self.growth.columns)], "nr int, feature string")
        return names.join(F.broadcast(per_feature)).select("feature", (F.coalesce(F.try_element_at("m", F.col("nr")), F.lit(0.0)) / F.col("s")).alias("score"))


def features_tried(strategy: str | int, n: int) -> int:
    if strategy == "sqrt":
        return max(1, int(n ** 0.5))
    if strategy == "log2":
        return max(1, int(np.log2(n)))
    return n if strategy == "all" else max(1, min(n, int(strategy)))


@dataclass(frozen=True)
class Training:
    """Binned training rows (row hash, label, bins), stored, and their number per label."""

    bins: Bins
    rows: DataFrame
    sizes: dict[int, int]


def prepare(train: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "label", max_bins: int = 64) -> Training:
    """Fit bins and write the binned rows once; any number of forests and boosters can be grown from them.

    Rows without a label are left out. ``key`` tells rows apart: equal keys are drawn together.
    """
    bins = fit_bins(train, features, key, max_bins)
    labelled = train.filter(F.col(label).isNotNull()).withColumns({"_row": F.xxhash64(*key), "_label": F.col(label).cast("int")})
    parallel = train.sparkSession.sparkContext.defaultParallelism
    if labelled.rdd.getNumPartitions() < parallel:  # a task does the work of all trees for its rows
        labelled = labelled.repartition(parallel)
    rows = settle(bins.apply(labelled, ["_row", "_label"]).withColumnsRenamed({"_row": "row", "_label": "label"}))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        raise ValueError("no labelled rows")
    return Training(bins, rows, sizes)


def grow_forest(training: Training, kind: str, *, n_trees: int = 50, max_depth: int | None = None, min_leaf: int = 2, strategy: str | int = "sqrt",
                local_rows: int = LOCAL_ROWS, seed: int = K.SEED, features: Sequence[str] | None = None) -> ForestModel:
    """A forest of ``n_trees`` trees over integer labels 0, 1, ..., by default on all binned features.

    ``random_forest`` draws as many rows as there are, with replacement, and weighs classes equally; ``extra_trees`` takes every
    row once and cuts at random; ``balanced_forest`` draws from every class as many rows as the rarest one has.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown forest {kind}")
    bins, sizes = training.bins, training.sizes
    classes = max(sizes) + 1
    n = sum(sizes.values())
    columns = tuple(bins.features.index(f) for f in features or bins.features)
    even = tuple(n / (len(sizes) * sizes[c]) if c in sizes else 1.0 for c in range(classes))
    growth = Growth(n_trees, classes, len(bins.features), columns, features_tried(strategy, len(columns)), even, (1.0,) * classes,
                    False, max_depth, min_leaf, max((len(c) for c in bins.cuts), default=0) + 1, seed)
    if kind == "extra_trees":
        growth = replace(growth, rates=(), random_cuts=True)
    if kind == "balanced_forest":
        growth = replace(growth, class_weights=(1.0,) * classes, rates=tuple(min(sizes.values()) / sizes[c] if c in sizes else 0.0 for c in range(classes)))
    return ForestModel(bins, growth, Forest(growth, training.rows, local_rows, n).grown())


def fit_forest(train: DataFrame, features: Sequence[str], kind: str, key: Sequence[str], label: str = "label", max_bins: int = 64, **params) -> ForestModel:
    """:func:`prepare` and :func:`grow_forest` in one."""
    return grow_forest(prepare(train, features, key, label, max_bins), kind, **params)
