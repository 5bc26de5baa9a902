"""Feedback texts packed into training sequences of fixed length by cutting-stock column generation.

Texts become token ids with an end id. Whole sequences are cut off first; the rest of a text is cut into a head whose length
is a multiple of ``grain`` and a tail shorter than it. So only ``length / grain + grain`` piece lengths occur, whatever the
corpus, and the histogram of lengths is all the packing has to look at.

Sequences are patterns (how many pieces of each length fill one). A linear program chooses how often to use each
pattern; its columns are generated: knapsack dynamic programming finds the pattern that is worth most at the current
prices of lengths, until none is worth more than the sequence it takes. The number of uses is rounded down, and the few
pieces left over are filled in by exact subset sums. Pieces are then ranked within their length, and a rank says which
sequence and place a piece gets: one join-free pass over the pieces, however many there are.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import per_batch
from gradewell.session import store

LENGTH = 4096
GRAIN = 64
END_ID = 2
CACHED_WORDS = 400_000
#: Letters below U+0100 and ASCII marks but the apostrophe: such a word has one run of letters and one run of marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)?([!-&(-/:-@\[-`{-~]+)?")


class Kept(dict):
    """Values computed where they are missing; the first ``most`` short keys, which are the frequent ones, are kept."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = value
        return value


class WordIds:
    """Ids of whole texts, word by word. The tokenizer must drop white space and never join words across it."""

    def __init__(self, tokenizer_file: str, cached_words: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenize = self.tokenizer.model.tokenize
        self.words = Kept(self.word_ids, cached_words)
        self.runs = Kept(self.run_ids, cached_words // 2)
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}

    def run_ids(self, run: str) -> bytes:
        """Ids of one run of letters or marks, spelled in the byte alphabet of the tokenizer."""
        return array("I", [t.id for t in self.tokenize(run if run.isascii() else run.translate(self.letters))]).tobytes()

    def word_ids(self, word: bytes) -> bytes:
        text = word.decode()
        plain = PLAIN.fullmatch(text)
        if plain is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        letters, marks = plain.groups()
        if not marks:
            return self.runs[letters.lower()]
        return self.runs[letters.lower()] + self.runs[marks] if letters else self.runs[marks]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        look = self.words.__getitem__
        return [b"".join(map(look, t.encode().split())) for t in texts]


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def cuts(tokens: int, length: int = LENGTH, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text: whole sequences, a head of whole grains, a tail."""
    out = [(s, length) for s in range(0, tokens - length + 1, length)]
    start = len(out) * length
    head = (tokens - start) // grain * grain
    if head:
        out.append((start, head))
    if tokens - start - head:
        out.append((start + head, tokens - start - head))
    return out


def feedback_pieces(feedback: DataFrame, tokenizer_file: str, key: str = "session_id", text: str = "free_text_feedback",
                    end_id: int = END_ID, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of every piece; a null or empty text is its end id alone."""
    kind = feedback.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def work(rows: dict[str, list]) -> dict[str, list]:
        out = {"key": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
        for k, ids in zip(rows["key"], word_ids(tokenizer_file).encode_many([t or "" for t in rows["text"]])):
            ids += end
            tokens = len(ids) // 4
            for start, size in cuts(tokens, length, grain):
                out["key"].append(k)
                out["start"].append(start)
                out["length"].append(size)
                out["ids_crc32"].append(zlib.crc32(ids[4 * start:4 * (start + size)]))
                out["doc_tokens"].append(tokens)
        return out

    return per_batch(feedback, {"key": key, "text": text}, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", work,
                     weigh="text", group_bytes=4_000_000)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits, by knapsack dynamic programming over the capacity."""
    best, took = np.zeros(length + 1), np.full(length + 1, -1)
    order = np.argsort(sizes)
    small, worth = sizes[order], prices[order]
    fits = np.searchsorted(small, np.arange(length + 1), side="right")
    for c in range(1, length + 1):
        n = fits[c]
        best[c] = best[c - 1]
        if n:
            values = best[c - small[:n]] + worth[:n]
            i = values.argmax()
            if values[i] > best[c]:
                best[c], took[c] = values[i], order[i]
    pattern, c = np.zeros(len(sizes), np.int64), length
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[length]), pattern


def generate_patterns(sizes: np.ndarray, counts: np.ndarray, length: int, rounds: int = 400, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """(pattern, uses) of the linear program: as few sequences as possible that hold every length as often as it occurs.

    Revised simplex over a basis of one pattern per length, entered by the best pattern of each round. Stops at the
    optimum, within ``gap`` of the bound that prices give, or after ``rounds``: the basis is a solution at any time.
    """
    basis = np.diag(length // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    uses = inverse @ counts
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, np.maximum(prices, 0), length)
        bound = max(uses.sum() / max(worth, 1.0), float(sizes @ counts) / length)
        if worth <= 1 + 1e-9 or uses.sum() <= bound * (1 + gap):
            break
        direction = inverse @ pattern
        positive = direction > 1e-9
        ratios = np.where(positive, uses / np.where(positive, direction, 1), np.inf)
        leaves = int(ratios.argmin())
        step = ratios[leaves]
        if not np.isfinite(step):
            break
        uses = uses - step * direction
        uses[leaves] = step
        basis[:, leaves] = pattern
        row = inverse[leaves] / direction[leaves]
        inverse = inverse - np.outer(direction, row)
        inverse[leaves] = row
        uses = np.maximum(uses, 0)
    return [(np.round(basis[:, i]).astype(np.int64), float(u)) for i, u in enumerate(uses) if u > 1e-9]


def fill(sizes: np.ndarray, counts: np.ndarray, target: int) -> tuple[int, np.ndarray]:
    """The greatest sum up to ``target`` of the pieces there are, and how many of each it takes."""
    reached = np.full(target + 1, -1)
    reached[0] = len(sizes)
    used = []
    for i in np.argsort(-sizes):
        n, size = int(counts[i]), int(sizes[i])
        spent = np.where(reached >= 0, 0, -1)
        if n and size <= target:
            for c in range(size, target + 1):
                if spent[c] < 0 and 0 <= spent[c - size] < n:
                    spent[c] = spent[c - size] + 1
                    reached[c] = i
        used.append((i, spent))
        if reached[target] >= 0:
            break
    total = int(np.flatnonzero(reached >= 0).max())
    taken, c = np.zeros(len(sizes), np.int64), total
    for i, spent in reversed(used):
        taken[i] = spent[c]
        c -= int(spent[c]) * int(sizes[i])
    return total, taken


def plan_sequences(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """(pieces by length, number of such sequences) that use up the histogram exactly."""
    plan = [({length: 1}, histogram[length])] if histogram.get(length) else []
    sizes = np.array(sorted(s for s in histogram if s != length and histogram[s]), np.int64)
    if not len(sizes):
        return plan
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    for pattern, uses in generate_patterns(sizes, left.astype(float), length):
        n = min([int(uses + 1e-6), *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if n > 0:
            plan.append(({int(s): int(a) for s, a in zip(sizes, pattern) if a}, n))
            left = left - n * pattern
    while left.any():
        total = int(sizes @ left)
        reached, taken = fill(sizes, left, min(length, total))
        if total < length:  # the last one: a power of two needs no padding
            target = 1 << (total.bit_length() - 1)
            reached, exact = fill(sizes, left, target)
            taken = exact if reached == target else left.copy()
        plan.append(({int(s): int(a) for s, a in zip(sizes, taken) if a}, 1))
        left = left - taken
    return plan


class Slots:
    """Where the pieces of a length go, by their rank within the length."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for pieces, n in plan:
            offset = 0
            for size in sorted(pieces, reverse=True):
                rows.setdefault(size, []).append((ranks.get(size, 0), pieces[size], sequence, offset))
                ranks[size] = ranks.get(size, 0) + pieces[size] * n
                offset += size * pieces[size]
            sequence += n
        self.rows = {size: np.array(r, np.int64) for size, r in rows.items()}
        self.sequences = sequence

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence id and offset of every (length, rank)."""
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for size in np.unique(sizes):
            chosen = sizes == size
            first, each, start, base = self.rows[int(size)][np.searchsorted(self.rows[int(size)][:, 0], ranks[chosen], side="right") - 1].T
            at = ranks[chosen] - first
            sequence[chosen], offset[chosen] = start + at // each, base + at % each * size
        return sequence, offset


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of stored pieces."""
    buckets = 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(buckets)))
    counted = store(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(plan_sequences(histogram, length))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = keyed.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
    kind = pieces.schema["key"].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        sequence, offset = slots.place(np.array(rows["length"], np.int64), np.array(rows["rank"], np.int64))
        return {**{n: rows[n] for n in names}, "sequence_id": sequence, "offset": offset}

    return per_batch(ranked, {n: n for n in [*names, "rank"]},
                     f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", work)


def pack_feedback(feedback: DataFrame, tokenizer_file: str, key: str = "session_id", text: str = "free_text_feedback",
                  end_id: int = END_ID, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every text in exactly one piece.

    Sequences hold at most ``length`` ids; within one, offsets run from 0 without gaps. ``start`` counts the text's ids
    before the piece, ``ids_crc32`` is taken over its ids as little-endian unsigned 32-bit integers. A null or empty
    text has only its end id. Null and repeated keys are kept, every row is a text of its own; other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    pieces = store(feedback_pieces(feedback, tokenizer_file, key, text, end_id, length, grain))
    return pack_pieces(pieces, length).withColumnRenamed("key", key)
