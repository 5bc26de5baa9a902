"""Passages that recur in feedback texts: confirmed, compiled into automata and cut out wherever they occur again.

A window is ``window_words`` consecutive words. Each window has an anchor, its least hashed phrase of ``PHRASE`` words; equal
windows have equal anchors, so only windows whose anchor stands in two places can recur. Windows that share one anchor
place form a passage. The steps:

1. Texts are packed into blocks of a few megabytes, one compressed row each. A text whose words are all those of an earlier
   one recurs whole; the others go on.
2. Every block sends its anchors through a shuffle; those that stand in two places come back to their blocks.
3. Every block sends its passages with such an anchor. Passages, then their windows, are counted and get their first
   place; a passage that recurs, or has a window that does, is confirmed and comes back to the blocks that hold it.
4. Every block compiles its confirmed passages into an Aho-Corasick automaton over words and streams all of its texts
   through it. The automata are the shards: one holds no more than its block does, however large the corpus, and a text
   meets the only automaton that can match it.

Hashes decide only which windows are compared; an automaton matches words. Within an anchor windows are told apart by 64
bits. A very common passage is one row per block. The passages of one anchor meet in one task while they are few; an anchor
with more than ``crowded`` places sends single windows instead, which are counted before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradewell.llm.common import groups
from gradewell.session import store

WINDOW_WORDS = 20
PHRASE = 5
BLOCK_BYTES = 2_000_000
ANCHOR_BITS = 48
CROWDED = 1000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A random number for every byte value, and white space.
BYTE_CODES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2 ** 64, to the powers 0 to n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse))


def runs_hashed(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of codes[first:last] for arrays of bounds, by differences of prefix sums."""
    up, down = powers(len(codes))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:-1], dtype=np.uint64)])
    return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    return runs_hashed(BYTE_CODES[data], first, last), first


def least_phrases(phrases: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost least phrase among every ``size`` consecutive ones."""
    value, place, width = phrases, np.arange(len(phrases)), 1

    def lesser(shift: int, value: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = value[shift:] < value[:len(value) - shift]
        return tuple(np.where(right, x[shift:], x[:len(x) - shift]) for x in (value, place))

    while width * 2 <= size:
        value, place = lesser(width, value, place)
        width *= 2
    return lesser(size - width, value, place)[1] if size > width else place


class Block:
    """The texts of one block with the hashes of their windows; texts in ``skipped`` have no windows."""

    def __init__(self, packed: bytes, sizes: list[int], window: int, skipped: set[int]) -> None:
        self.raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, sum(sizes) + len(sizes)))
        self.ends = np.cumsum(np.array(sizes, np.int64) + 1)  # a line break follows every text
        codes, first = word_hashes(self.raw)
        self.text_of = np.searchsorted(self.ends, first, "right")
        n = max(0, len(codes) - window + 1)
        self.starts = np.empty(0, np.int64)
        if not n:
            return
        at = np.arange(len(codes) - PHRASE + 1)
        phrases = runs_hashed(codes, at, at + PHRASE)
        place = least_phrases(phrases, window - PHRASE + 1)
        usable = self.text_of[:n] == self.text_of[window - 1:]
        if skipped:
            usable &= ~np.isin(self.text_of[:n], list(skipped))
        self.starts = np.flatnonzero(usable)
        self.windows = runs_hashed(codes, self.starts, self.starts + window)
        self.places = place[self.starts]
        self.anchors = phrases[self.places] >> np.uint64(64 - ANCHOR_BITS)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def local_copies(row: dict) -> set[int]:
    """Texts that repeat an earlier one of their block; texts too short for a window have no digest."""
    first = set(row["firsts"])
    return {i for i, d in enumerate(row["digests"]) if d is not None and i not in first}


def pack_blocks(feedback: DataFrame, key: str, text: str, window: int, block_bytes: int) -> DataFrame:
    """One row per block: keys, sizes in bytes, word digests (null: fewer words than a window), first of each digest, texts."""
    kind = feedback.schema[key].dataType.simpleString()
    schema = f"keys array<{kind}>, sizes array<bigint>, digests array<binary>, firsts array<int>, packed binary"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in groups(batch, "text", block_bytes):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                keys, texts = part.column(0).to_pylist(), [(t or "").encode() for t in part.column(1).to_pylist()]
                words = [t.split() for t in texts]
                digests = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if len(w) >= window else None for w in words]
                order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i], i) if keys[i] is not None else (True, 0, i))
                firsts = {}
                for i in order:
                    if digests[i] is not None:
                        firsts.setdefault(digests[i], i)
                packed = zstandard.ZstdCompressor(6).compress(b"".join(t + b"\n" for t in texts))
                columns = [[keys], [[len(t) for t in texts]], [digests], [sorted(firsts.values())], [packed]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    packed = feedback.select(feedback[key].alias("key"), feedback[text].alias("text")).mapInArrow(pack, schema)
    return store(packed.withColumn("block", F.monotonically_increasing_id()))


def whole_copies(blocks: DataFrame) -> DataFrame:
    """(block, row) of texts whose words are those of an earlier text in another block."""
    firsts = blocks.select("block", "keys", "digests", F.explode("firsts").alias("row")).select(
        "block", "row", F.element_at("keys", F.col("row") + 1).alias("key"), F.element_at("digests", F.col("row") + 1).alias("digest"))
    order = Window.partitionBy("digest").orderBy(F.col("key").isNull(), "key", "block", "row")
    return firsts.withColumn("n", F.row_number().over(order)).filter("n > 1").select("block", "row")


def recurring_anchors(blocks: DataFrame, window: int) -> DataFrame:
    """(block, anchor, places) of anchors that stand in two places; a block sends each of its anchors once."""
    schema = pa.schema([("block", pa.int64()), ("anchor", pa.int64()), ("n", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row["packed"], row["sizes"], window, local_copies(row))
                if len(block.starts):
                    new = np.concatenate([[True], block.places[1:] != block.places[:-1]])
                    anchors, n = np.unique(block.anchors[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchors), row["block"])), pa.array(anchors.astype(np.int64)),
                                                      pa.array(n.astype(np.int32))], schema=schema)

    sent = blocks.select("block", "sizes", "digests", "firsts", "packed").mapInArrow(find, "block bigint, anchor bigint, n int")
    return sent.withColumn("places", F.sum("n").over(Window.partitionBy("anchor"))).filter("places > 1").select("block", "anchor", "places")


def passages_with(blocks: DataFrame, anchors: DataFrame, copies: DataFrame, window: int, kind: str, crowded: int) -> DataFrame:
    """Passages with a recurring anchor: one row per block and distinct passage, at its first place there."""
    wanted = anchors.withColumn("row", F.lit(None).cast("int")).unionByName(copies.withColumns({c: F.lit(None).cast("bigint") for c in ("anchor", "places")}))
    wanted = wanted.groupBy("block").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("row").alias("copies"),
                                         F.collect_list(F.when(F.col("places") > crowded, F.col("anchor"))).alias("crowded"))
    schema = f"anchor bigint, passage bigint, windows array<bigint>, crowded boolean, key {kind}, block bigint, at bigint, places bigint"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                found = Block(row["packed"], row["sizes"], window, local_copies(row) | set(row["copies"]))
                ours = np.isin(found.anchors, np.array(row["anchors"], np.uint64)) if len(found.starts) else np.empty(0, bool)
                if not ours.any():
                    continue
                starts, windows, places, anchors = (x[ours] for x in (found.starts, found.windows, found.places, found.anchors))
                new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
                last = np.concatenate([new[1:], [len(places)]])
                sizes = last - new
                passage = mixed(windows[new] * BASE + mixed(windows[last - 1] + sizes.astype(np.uint64)))
                keys = row["keys"]
                rank = np.empty(len(keys), np.int64)
                rank[sorted(range(len(keys)), key=lambda i: (False, keys[i], i) if keys[i] is not None else (True, 0, i))] = np.arange(len(keys))
                owner = found.text_of[starts[new]]
                order = np.lexsort([starts[new], rank[owner], passage, anchors[new]])
                head = np.concatenate([[True], (passage[order][1:] != passage[order][:-1]) | (anchors[new][order][1:] != anchors[new][order][:-1])])
                kept = order[head]
                counts = np.diff(np.concatenate([np.flatnonzero(head), [len(order)]]))
                parts = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32)
                inside = np.repeat(new[kept] - parts[:-1], sizes[kept]) + np.arange(parts[-1])
                columns = [anchors[new][kept].astype(np.int64), passage[kept].view(np.int64), pa.ListArray.from_arrays(parts, pa.array(windows[inside].view(np.int64))),
                           np.isin(anchors[new][kept], np.array(row["crowded"], np.uint64)), [keys[i] for i in owner[kept]], np.full(len(kept), row["block"]), starts[new][kept], counts.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    joined = blocks.join(wanted, "block").select("block", "keys", "sizes", "digests", "firsts", "packed", "anchors", "copies", "crowded")
    return joined.mapInArrow(find, schema)


def confirmed_passages(found: DataFrame) -> DataFrame:
    """(block, at, n, first_block, first_at, moved): passages that recur whole or in part, one row per block that holds one.

    ``first_block`` and ``first_at`` are the first place of the passage; ``moved`` lists the windows (by number) that
    have an earlier place in another passage, with that place.
    """
    place = F.struct(F.col("key").isNull().alias("nokey"), "key", "block", "at")
    alike = Window.partitionBy("anchor", "passage")
    marked = found.withColumn("first", F.min(place).over(alike)).withColumn("all_places", F.sum("places").over(alike)).withColumn("n", F.size("windows"))
    own = (F.col("first.block") == F.col("block")) & (F.col("first.at") == F.col("at"))
    marked = store(marked.withColumn("windows", F.when(own, F.col("windows"))).drop("places", "key"))
    distinct = marked.filter("windows is not null").select("anchor", "passage", "first", "windows", "crowded")

    def single(rows: DataFrame) -> DataFrame:
        rows = rows.select("anchor", "passage", "first", F.posexplode("windows").alias("nr", "window"))
        return rows.withColumn("here", F.struct("first.nokey", "first.key", "first.block", (F.col("first.at") + F.col("nr")).alias("at"))).drop("first")

    few = single(distinct.filter("not crowded").repartition("anchor")).withColumn("least", F.min("here").over(Window.partitionBy("anchor", "window")))
    many = single(distinct.filter("crowded"))
    many = many.join(many.groupBy("anchor", "window").agg(F.min("here").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), ["anchor", "window"])

    def changed(rows: DataFrame) -> DataFrame:
        rows = rows.filter((F.col("least.block") != F.col("here.block")) | (F.col("least.at") != F.col("here.at")))
        return rows.groupBy("anchor", "passage").agg(F.collect_list(F.struct("nr", "least.block", "least.at")).alias("moved"))

    moved = changed(few).unionByName(changed(many))
    return marked.join(moved, ["anchor", "passage"], "left").filter("all_places > 1 or moved is not null").select(
        "block", "at", "n", F.col("first.block").alias("first_block"), F.col("first.at").alias("first_at"), "moved")


class PassageAutomaton:
    """Confirmed passages of one block over its words; ``cover`` marks what stands earlier elsewhere."""

    def __init__(self, passages: list[dict], words: list[bytes], block: int, window: int) -> None:
        import ahocorasick
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.passages = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for nr, p in enumerate(passages):
            text = words[p["at"]:p["at"] + p["n"] + window - 1]
            self.automaton.add_word(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in text), nr)
            moved = {m["nr"]: m["at"] - m["nr"] if m["block"] == block else -1 for m in p["moved"] or ()}
            home = p["first_at"] if p["first_block"] == block else -1
            #: Where in this block the passage would have to start for a window to be at its first place (-1: nowhere).
            homes = [moved.get(i, home) for i in range(p["n"])]
            self.passages.append((p["n"], homes if moved else home))
        self.automaton.make_automaton()

    def cover(self, words: list[bytes], first: int) -> bytearray:
        """One byte per word of a text whose first word has the number ``first`` in the block: 1 if it goes."""
        covered = bytearray(len(words))
        for end, nr in self.automaton.iter(tuple(map(self.ids.get, words, repeat(0)))):
            n, home = self.passages[nr]
            start = end - n - self.window + 2
            if isinstance(home, int):
                if home != first + start:
                    covered[start:end + 1] = b"\1" * (end + 1 - start)
                continue
            for i, at in enumerate(home):
                if at != first + start:
                    covered[start + i:start + i + self.window] = b"\1" * self.window
        return covered


def drop_repeated_passages(feedback: DataFrame, key: str = "session_id", text: str = "free_text_feedback", window_words: int = WINDOW_WORDS,
                           kept: str = "kept_text", block_bytes: int = BLOCK_BYTES, crowded: int = CROWDED) -> DataFrame:
    """(key, n_words, n_removed, kept): every text without the words of passages that stand earlier in the table.

    Words are runs without blanks (space, \\t, \\n, \\v, \\f, \\r). A word goes if a run of ``window_words`` words that covers
    it also starts earlier: in a text of lesser key, or earlier in the same text. Runs are judged on the given texts. Words
    that stay are joined by one space.

    A null text counts as empty: no words, an empty ``kept``. Rows with a null key come after all others; rows of one key
    stand in the order in which they are stored. Every row gives a row, repeated ones too. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    if window_words <= PHRASE:
        raise ValueError(f"window_words must be more than {PHRASE}")
    kind = feedback.schema[key].dataType.simpleString()
    blocks = pack_blocks(feedback, key, text, window_words, block_bytes)
    copies = store(whole_copies(blocks))
    found = passages_with(blocks, recurring_anchors(blocks, window_words), copies, window_words, kind, crowded)
    passages = confirmed_passages(found).groupBy("block").agg(F.collect_list(F.struct("at", "n", "first_block", "first_at", "moved")).alias("passages"))
    joined = blocks.join(passages, "block", "left").join(copies.groupBy("block").agg(F.collect_list("row").alias("copies")), "block", "left")
    schema = f"key {kind}, n_words bigint, n_removed bigint, kept string"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                raw = zstandard.ZstdDecompressor().decompress(row["packed"], max_output_size=max(1, sum(row["sizes"]) + len(row["sizes"])))
                ends = np.cumsum(np.array(row["sizes"], np.int64) + 1).tolist()
                texts = [raw[a:b].split() for a, b in zip([0, *ends], ends)]
                gone = local_copies(row) | set(row["copies"] or ())
                automaton = None
                if row["passages"]:
                    automaton = PassageAutomaton(row["passages"], [w for t in texts for w in t], row["block"], window_words)
                out, first = [], 0
                for i, words in enumerate(texts):
                    stay = words
                    if i in gone:
                        stay = []
                    elif automaton and len(words) >= window_words:
                        covered = automaton.cover(words, first)
                        if any(covered):
                            stay = [w for w, c in zip(words, covered) if not c]
                    out.append((len(words), len(words) - len(stay), b" ".join(stay).decode()))
                    first += len(words)
                columns = [row["keys"], *zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    result = joined.select("block", "keys", "sizes", "digests", "firsts", "packed", "passages", "copies").mapInArrow(cut, schema)
    return result.withColumnsRenamed({"key": key, "kept": kept})
