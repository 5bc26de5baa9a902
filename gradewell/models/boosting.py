"""Gradient boosting over several classes at once: one softmax booster in place of one-vs-rest, one logistic booster for two classes.

A round grows one tree per class from gradients and Hessians of the softmax loss (a logistic booster: one tree for class 1). The binned
rows stay in cached blocks with margins that are brought up to date every ``ROUNDS_MERGED`` rounds, and between by walking the trees since;
the rows a round draws are kept with their gradients until it ends. Per level one job sums histograms of the lighter child of each node (the other follows by subtraction) and the driver makes the cuts, so no row moves. Gradients are rounded to whole numbers, so sums do not depend on how the rows are dealt. A histogram has
classes x nodes x features x bins cells, whatever the number of rows. A table of at most ``rows_per_task`` rows is boosted in one task
by the same code. Lost blocks are computed again from the last checkpoint, which is at most ``ROUNDS_KEPT`` + ``ROUNDS_MERGED`` rounds old.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.models.forests import Bins, ForestModel, Training, bytes_matrix, mixed, prepare, uniform
from gradewell.session import shared_folder, store

UNIT = float(1 << 30)
ROWS_PER_TASK = 100_000
MOST_ROWS_PER_TASK = 2_000_000
ROWS_PER_BLOCK = 50_000
ROUNDS_KEPT = 25
#: Rounds after which margins are written anew: a walk costs less than moving all rows between the JVM and Python.
ROUNDS_MERGED = 4
MOST_SENT = 128
#: Levels of a tree whose nodes are compared with all rows.
NARROW = 6


@dataclass(frozen=True)
class Boosting:
    """Sizes of a booster; ``share`` and ``feature_share`` are the parts of rows (per round) and features (per tree) used.

    ``logistic``: two classes, one tree a round.
    """

    classes: int
    n_features: int
    n_bins: int
    rounds: int = 220
    depth: int = 5
    rate: float = 0.06
    share: float = 0.9
    feature_share: float = 0.85
    ridge: float = 1.0
    least_weight: float = 1.0
    seed: int = K.SEED
    logistic: bool = False

    @property
    def trees(self) -> int:
        """Trees of a round."""
        return 1 if self.logistic else self.classes

    @property
    def label_type(self) -> type:
        return np.uint8 if self.classes <= 256 else np.int64

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Of every class, from margins[row, tree]."""
        if self.logistic:
            with np.errstate(over="ignore"):  # exp overflows to a probability of 0
                p = 1 / (1 + np.exp(-margins))
            return np.concatenate([1 - p, p], axis=1)
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def features(self, round_: int) -> np.ndarray:
        """Features of each tree, by least hash."""
        n = max(1, round(self.feature_share * self.n_features))
        trees = np.arange(self.trees, dtype=np.uint64) + np.uint64(round_ * self.trees)
        dice = mixed(mixed(trees + mixed(self.seed))[:, None] + np.arange(self.n_features, dtype=np.uint64)[None, :])
        allowed = np.zeros(dice.shape, bool)
        np.put_along_axis(allowed, np.argsort(dice, axis=1, kind="stable")[:, :n], True, axis=1)
        return allowed

    def cuts(self, sums: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best (feature, cut) per tree and node from sums[tree, node, feature, bin, 2]; feature -1 where nothing is gained."""
        left = np.cumsum(sums, axis=3)
        total = left[:, :, :, -1:, :]
        right = total - left

        def worth(s: np.ndarray) -> np.ndarray:
            return s[..., 0] ** 2 / (s[..., 1] + self.ridge)

        gain = worth(left) + worth(right) - worth(total)
        good = (left[..., 1] >= self.least_weight) & (right[..., 1] >= self.least_weight) & allowed[:, None, :, None]
        gain = np.where(good, gain, 0.0)
        gain[..., -1] = 0.0
        flat = gain.reshape(*gain.shape[:2], -1)
        best = flat.argmax(axis=2)
        found = np.take_along_axis(flat, best[..., None], axis=2)[..., 0] > 1e-9
        return np.where(found, best // self.n_bins, -1), best % self.n_bins

    def draw(self, block: Block, weights: np.ndarray, round_: int) -> Drawn:
        """The rows of a block that a round uses, with gradients and Hessians in whole numbers."""
        p, own = self.probabilities(block.margins), weights[block.labels]
        truth = p[np.arange(len(p)), block.labels]
        loss = np.rint(-np.log(np.maximum(truth, 1e-15)) * own * UNIT).astype(np.int64).sum()
        used = np.flatnonzero(uniform(mixed(block.rows.view(np.uint64) ^ mixed(mixed(self.seed) + np.uint64(round_))[0])) < self.share)
        classes = np.arange(self.classes - self.trees, self.classes)
        p, own = np.take(p.T[classes], used, axis=1), own[used]
        g = np.rint((p - (block.labels[used] == classes[:, None])) * own * UNIT)
        h = np.rint(np.maximum(p * (1 - p), 1e-6) * own * UNIT)
        kind = np.int32 if weights.max() < 2 else np.float64  # both hold the whole numbers exactly
        return Drawn(np.take(block.bins, used, axis=1), g.astype(kind), h.astype(kind), int(loss))

    def histograms(self, drawn: Drawn, round_: int, level: int, feature: np.ndarray, cut: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Sums [tree, node, feature, bin, 2] in whole numbers, flat, followed by the loss: all nodes of level 0, one child of each node of others.

        ``asked[tree, node]`` tells which child.
        """
        k, n_bins, width = self.trees, self.n_bins, 1 << level
        shape = (k, width if level == 0 else width // 2, self.n_features, n_bins, 2)
        sums, cells = np.zeros(shape), shape[1] * n_bins
        allowed = self.features(round_)
        for c in range(k):
            node, g, h = self.walk(drawn.bins, feature[c], cut[c], level), drawn.g[c], drawn.h[c]
            if level:
                ours = np.flatnonzero(asked[c][node])
                node, g, h = (node[ours] - width) // 2, g[ours], h[ours]
            else:
                node = node - width
            g, h = g.astype(np.float64), h.astype(np.float64)
            base = node.astype(np.int64) * n_bins
            for f in np.flatnonzero(allowed[c]):
                at = base + (drawn.bins[f][ours] if level else drawn.bins[f])
                sums[c, :, f, :, 0] = np.bincount(at, g, cells).reshape(-1, n_bins)
                sums[c, :, f, :, 1] = np.bincount(at, h, cells).reshape(-1, n_bins)
        return np.append(sums.astype(np.int64).ravel(), 0 if level else drawn.loss)

    @staticmethod
    def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """Node of every column of bins[feature, row] after so many levels of one tree.

        The few nodes of an upper level are compared one by one with all rows, byte by byte; that is faster than looking up each row's cut.
        """
        n = bins.shape[1]
        node, row, flat = np.ones(n, np.uint8 if levels < 8 else np.int64), np.arange(n) if levels > NARROW else None, bins.ravel()
        for level in range(levels):
            if level < NARROW:
                right = np.zeros(n, bool)
                for i in range(1 << level, 2 << level):
                    if feature[i] >= 0:
                        right |= (node == i) & (bins[feature[i]] > int(cut[i]))
            else:
                f = feature[node]
                right = (f >= 0) & (flat[np.maximum(f, 0) * n + row] > cut[node])
            node = 2 * node + right
        return node

    def advanced(self, block: Block, *trees: tuple[np.ndarray, ...]) -> Block:
        """The block with the margins after more rounds."""
        margins = block.margins.copy(order="F")
        for feature, cut, value in trees:
            for c in range(self.trees):
                margins[:, c] += value[c, self.walk(block.bins, feature[c], cut[c], self.depth) - (1 << self.depth)]
        return replace(block, margins=margins)

    def train(self, ask: Callable[..., np.ndarray]) -> Iterator[dict]:
        """The rounds, as dictionaries of arrays; ``ask(last tree, round, level, feature, cut, asked)`` sums :meth:`histograms` over all rows.

        Trees are complete: node 1 is the root, node i has the children 2i and 2i + 1; a node without a cut sends all rows left.
        """
        k, leaves, tree = self.trees, 1 << self.depth, None
        for round_ in range(self.rounds):
            allowed = self.features(round_)
            feature, cut, asked = np.full((k, leaves), -1), np.zeros((k, leaves), np.int64), np.zeros((k, leaves), bool)
            parents, loss = None, 0
            for level in range(self.depth):
                width = 1 << level
                sent = ask(tree, round_, level, feature, cut, asked)
                sums = sent[:-1].reshape(k, -1, self.n_features, self.n_bins, 2)
                if level:
                    both = np.empty((k, width, *sums.shape[2:]), np.int64)
                    right = asked[:, width + 1:2 * width:2][..., None, None, None]
                    both[:, 0::2], both[:, 1::2] = np.where(right, parents - sums, sums), np.where(right, sums, parents - sums)
                    sums = both
                else:
                    loss = int(sent[-1])
                parents = sums
                feature[:, width:2 * width], cut[:, width:2 * width] = f, at = self.cuts(sums / UNIT, allowed)
                # The sums of the children are the sides of the cuts; any feature that was counted has the whole.
                every = np.arange(k)[:, None], np.arange(width)[None, :]
                whole = sums[every[0], every[1], allowed.argmax(axis=1)[:, None]].sum(axis=2)
                left = np.where((f >= 0)[..., None], np.cumsum(sums, axis=3)[every[0], every[1], np.maximum(f, 0), at], whole)
                if 2 * width < leaves:
                    asked[:, 2 * width + 1:4 * width:2] = whole[..., 1] < 2 * left[..., 1]  # the right child has less Hessian
                    asked[:, 2 * width:4 * width:2] = ~asked[:, 2 * width + 1:4 * width:2]
            ends = np.stack([left, whole - left], axis=2).reshape(k, leaves, 2) / UNIT
            value = -self.rate * ends[..., 0] / (ends[..., 1] + self.ridge)
            tree = (feature, cut, value)
            yield {"round": round_, "loss": float(loss / UNIT), "feature": feature, "cut": cut, "value": value}


@dataclass(frozen=True)
class Block:
    """Row hashes, labels, bins[feature, row] and margins[row, tree of a round], a tree's side by side, of some rows."""

    rows: np.ndarray
    labels: np.ndarray
    bins: np.ndarray
    margins: np.ndarray


@dataclass(frozen=True)
class Drawn:
    """bins[feature, row], gradients and Hessians [tree, row] of the rows of a block that a round uses; the loss of the whole block."""

    bins: np.ndarray
    g: np.ndarray
    h: np.ndarray
    loss: int


def blocks(batches: Iterator[tuple], s: Boosting, rows_per_block: int = ROWS_PER_BLOCK) -> Iterator[Block]:
    """Arrow columns (row, label, bins) as blocks with margins of 0."""
    def block(parts: list[tuple]) -> Block:
        rows, labels, bins = (np.concatenate(x) for x in zip(*parts))
        return Block(rows, labels, np.ascontiguousarray(bins.T), np.zeros((len(rows), s.trees), order="F"))

    parts, held = [], 0
    for row, label, bins in batches:
        parts.append((row.to_numpy().astype(np.int64), label.to_numpy().astype(s.label_type), bytes_matrix(bins, s.n_features)))
        held += len(row)
        if held >= rows_per_block:
            yield block(parts)
            parts, held = [], 0
    if held:
        yield block(parts)


def total(parts: Iterator[np.ndarray]) -> list[np.ndarray]:
    """The sum, in a list; nothing for no parts."""
    out = None
    for part in parts:
        out = part if out is None else out + part
    return [] if out is None else [out]


def asked_by_jobs(s: Boosting, weights: np.ndarray, held: RDD) -> Callable[..., np.ndarray]:
    """``ask`` for cached blocks: one job per level."""
    state, drawn, since, kept = held.persist(StorageLevel.MEMORY_AND_DISK), None, [], 0

    def ask(tree, round_: int, level: int, *cuts: np.ndarray) -> np.ndarray:
        nonlocal state, drawn, since, kept
        before = None
        if level == 0:
            if tree is not None:
                since = [*since, tree]
                drawn.unpersist()
            trees = since
            if len(trees) == ROUNDS_MERGED:
                before, state = state, state.map(lambda b: s.advanced(b, *trees)).persist(StorageLevel.MEMORY_AND_DISK)
                since = []
                if round_ - kept >= ROUNDS_KEPT:
                    state.checkpoint()
                    kept = round_
            open_ = since
            drawn = state.map(lambda b: s.draw(s.advanced(b, *open_) if open_ else b, weights, round_)).persist(StorageLevel.MEMORY_AND_DISK)
        at = [x.copy() for x in cuts]
        sums = drawn.mapPartitions(lambda ds: total(s.histograms(d, round_, level, *at) for d in ds))
        out = total(sums.collect())[0] if sums.getNumPartitions() <= MOST_SENT else sums.treeReduce(np.add)
        if before is not None:
            before.unpersist()
        if (round_, level) == (s.rounds - 1, s.depth - 1):
            drawn.unpersist()
            state.unpersist()
        return out

    return ask


ROUND = "round int, loss double, feature binary, cut binary, value binary"


@dataclass(frozen=True)
class BoosterModel:
    """Stored rounds of a booster; at most rounds x trees x 2 ** depth nodes, so they can be sent to every task."""

    bins: Bins
    sizes: Boosting
    rounds: DataFrame

    def trees(self) -> list[tuple[np.ndarray, ...]]:
        shape = (self.sizes.trees, 1 << self.sizes.depth)
        return [(np.frombuffer(r["feature"], np.int64).reshape(shape), np.frombuffer(r["cut"], np.int64).reshape(shape), np.frombuffer(r["value"], np.float64).reshape(shape))
                for r in self.rounds.orderBy("round").collect()]

    def votes(self, binned: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` with ``prob``, the classes' probabilities by the summed leaf values."""
        s, width = self.sizes, len(keep)
        shared = binned.sparkSession.sparkContext.broadcast(self.trees())
        out = binned.select(*keep, "bins").withColumn("prob", F.array(*[F.lit(0.0)] * s.classes))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = np.ascontiguousarray(bytes_matrix(batch.column(width), s.n_features).T)
                margins = np.zeros((bins.shape[1], s.trees))
                for feature, cut, value in shared.value:
                    for c in range(s.trees):
                        margins[:, c] += value[c, s.walk(bins, feature[c], cut[c], s.depth) - (1 << s.depth)]
                p = s.probabilities(margins)
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, s.classes, dtype=np.int32), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width + 1], lists], names=[*keep, "bins", "prob"])

        return out.mapInArrow(work, out.schema).drop("bins")

    def predictions(self, rows: DataFrame, keep: Sequence[str], truth: str | None, labels: Sequence[int]) -> DataFrame:
        """Prediction table as of the other models."""
        named = {c: f"_k{i}" for i, c in enumerate(keep)}
        wide = rows.select(*[F.col(c).alias(n) for c, n in named.items()], *([F.col(truth).cast("int").alias("_truth")] if truth else []), *self.bins.features)
        kept = [*named.values(), *(["_truth"] if truth else [])]
        return ForestModel.finish(self.votes(self.bins.apply(wide, kept), kept), named, truth, labels)

    def save(self, path: str) -> None:
        """Rounds as Parquet and, beside them, bins and sizes as one JSON document."""
        self.rounds.write.mode("overwrite").parquet(f"{path}/rounds")
        document = json.dumps({"features": self.bins.features, "cuts": [c.tolist() for c in self.bins.cuts], "fill": self.bins.fill, "sizes": asdict(self.sizes)})
        self.rounds.sparkSession.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/booster")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoosterModel:
        d = json.loads(spark.read.text(f"{path}/booster").first()["value"])
        bins = Bins(tuple(d["features"]), tuple(np.array(c, np.float64) for c in d["cuts"]), tuple(d["fill"]))
        return BoosterModel(bins, Boosting(**d["sizes"]), spark.read.schema(ROUND).parquet(f"{path}/rounds"))

    def losses(self) -> list[float]:
        """Weighted training loss before every round."""
        return [r["loss"] for r in self.rounds.select("round", "loss").orderBy("round").collect()]


def round_batch(r: dict) -> dict:
    return {"round": r["round"], "loss": r["loss"], "feature": r["feature"].astype(np.int64).tobytes(), "cut": r["cut"].astype(np.int64).tobytes(), "value": r["value"].tobytes()}


def grow_booster(training: Training, rows_per_task: int = ROWS_PER_TASK, **sizes) -> BoosterModel:
    """A booster over the integer labels 0, 1, ... of ``training``, classes weighted equally; ``sizes`` as of :class:`Boosting`."""
    n, known = sum(training.sizes.values()), training.sizes
    if sizes.get("logistic") and max(known) > 1:
        raise ValueError("a logistic booster has the classes 0 and 1")
    s = Boosting(2 if sizes.get("logistic") else max(known) + 1, len(training.bins.features), max(len(c) for c in training.bins.cuts) + 1, **sizes)
    even = np.array([n / (len(known) * known[c]) if c in known else 0.0 for c in range(s.classes)])
    spark = training.rows.sparkSession
    context = spark.sparkContext
    parallel, needed = context.defaultParallelism, -(-n // MOST_ROWS_PER_TASK)
    tasks = max(min(parallel, -(-n // rows_per_task)), needed if needed <= parallel else -(-needed // parallel) * parallel)  # whole waves

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, drawn = list(blocks((b.columns for b in batches), s)), []

        def ask(tree, round_: int, level: int, *cuts: np.ndarray) -> np.ndarray:
            if level == 0:
                if tree is not None:
                    state[:] = [s.advanced(b, tree) for b in state]
                drawn[:] = [s.draw(b, even, round_) for b in state]
            return total(s.histograms(d, round_, level, *cuts) for d in drawn)[0]

        for r in s.train(ask):
            yield pa.RecordBatch.from_pylist([round_batch(r)], pa.schema([("round", pa.int32()), ("loss", pa.float64()), *[(c, pa.binary()) for c in ("feature", "cut", "value")]]))

    dealt = training.rows.repartition(tasks)
    if tasks == 1:
        return BoosterModel(training.bins, s, store(dealt.mapInArrow(work, ROUND)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks((x.columns for x in batches), s):
            yield pa.RecordBatch.from_pydict({c: pa.array([x.tobytes()], pa.binary()) for c, x in (("row", b.rows), ("label", b.labels), ("bins", b.bins))})

    def unpacked(r) -> Block:
        rows = np.frombuffer(r["row"], np.int64)
        return Block(rows, np.frombuffer(r["label"], s.label_type), np.frombuffer(r["bins"], np.uint8).reshape(s.n_features, -1), np.zeros((len(rows), s.trees), order="F"))

    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    held = dealt.mapInArrow(packed, "row binary, label binary, bins binary").rdd.map(unpacked)
    rounds = spark.createDataFrame([round_batch(r) for r in s.train(asked_by_jobs(s, even, held))], ROUND)  # a few KB a round
    return BoosterModel(training.bins, s, store(rounds))


def fit_booster(train: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "label", max_bins: int = 32, **sizes) -> BoosterModel:
    """:func:`forests.prepare` and :func:`grow_booster` in one; logistic for the labels 0 and 1."""
    training = prepare(train, features, key, label, max_bins)
    return grow_booster(training, logistic=max(training.sizes) < 2, **sizes)
