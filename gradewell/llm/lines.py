"""Lines that many feedback texts share, found with two Bloom filters and dropped.

Pass one reads the texts and builds, task by task, one filter of line hashes seen once and one of hashes seen twice.
Filters meet segment by segment: a hash present in two tasks' first filters belongs in the second one too, so the merged
second filter has every line of two or more texts, and a few more. Pass two sends only those suspected repeats through
a shuffle, where they are counted exactly by a 256-bit digest of the line. The repeated lines go back to the texts that
hold them by the digest of the text; texts that share a digest share their lines, so ids need not be unique.

The filters have a fixed size (a parameter): beyond it more lines are suspected and shuffled, the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import groups, per_batch
from gradewell.session import store

BLANKS = b" \t\n\v\f\r"
FILTER_BITS = 1 << 26
PROBES = 3
SEGMENT_BYTES = 1 << 18


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def keys_of(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct keys of at least ``min_chars`` code points of one text, in order."""
    keys = dict.fromkeys(line_key(x) for x in (text or "").encode().split(b"\n"))
    return [k for k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)]


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of every hash, one column per probe."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(PROBES)], axis=1).astype(np.int64)


class TwoFilters:
    """Hashes seen once and hashes seen twice, as bit arrays."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def put(bitmap: np.ndarray, at: np.ndarray) -> None:
        flat = at.ravel()
        np.bitwise_or.at(bitmap, flat >> 3, np.left_shift(np.uint8(1), (flat & 7).astype(np.uint8)))

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of one or more texts; a text's own repeats must be gone."""
        distinct, counts = np.unique(hashes, return_counts=True)
        at = places(distinct, self.bits)
        again = (counts > 1) | self.has(self.once, at)
        self.put(self.twice, at[again])
        self.put(self.once, at[~again])

    def segments(self, size: int) -> Iterator[tuple[int, bytes, bytes]]:
        for i in range(0, self.bits // 8, size):
            if self.once[i:i + size].any() or self.twice[i:i + size].any():
                yield i // size, self.once[i:i + size].tobytes(), self.twice[i:i + size].tobytes()


def hash_keys(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def repeat_filter(feedback: DataFrame, text: str, min_chars: int, bits: int, segment_bytes: int) -> np.ndarray:
    """The merged filter of hashes seen in two or more texts: ``bits`` / 8 bytes, whatever the size of the table."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(bits)
        for batch in batches:
            for first, last in groups(batch, "text", 4_000_000):
                rows = batch.column(0).slice(first, last - first).to_pylist()
                filters.add(hash_keys([k for t in rows for k in keys_of(t, min_chars)]))
        rows = list(filters.segments(segment_bytes))
        for segment, once, twice in rows:
            yield pa.RecordBatch.from_pydict({"segment": [segment], "once": [once], "twice": [twice]}, schema=schema)

    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(segment_bytes, np.uint8), np.zeros(segment_bytes, np.uint8)
        for part in parts:
            for a, b in zip(part.column("once"), part.column("twice")):
                a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
                twice |= b | (once & a)
                once |= a
        yield pa.RecordBatch.from_pydict({"segment": [key[0].as_py()], "twice": [twice.tobytes()]}, schema=merged)

    merged = pa.schema([("segment", pa.int32()), ("twice", pa.binary())])
    parts = feedback.select(feedback[text].alias("text")).mapInArrow(build, "segment int, once binary, twice binary")
    found = parts.groupBy("segment").applyInArrow(merge, "segment int, twice binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in found:
        out[row["segment"] * segment_bytes:(row["segment"] + 1) * segment_bytes] = np.frombuffer(row["twice"], np.uint8)
    return out


def text_digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()[:16]


def repeated_lines(feedback: DataFrame, text: str = "free_text_feedback", key: str = "session_id", min_texts: int = 10,
                   min_chars: int = 1, bits: int = FILTER_BITS, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Suspected (digest, text_digest) rows and the exact (digest, n_texts, first_key) of lines in ``min_texts`` texts or more.

    Every row of ``feedback`` is a text of its own, also where keys or texts repeat. ``first_key`` is the least key
    that is not null among the texts with the line (null if none).
    """
    if min_texts < 2:
        raise ValueError("min_texts must be 2 or more")
    spark = feedback.sparkSession
    kind = feedback.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(repeat_filter(feedback, text, min_chars, bits, segment_bytes))

    def suspects(rows: dict[str, list]) -> dict[str, list]:
        keys = [keys_of(t, min_chars) for t in rows["text"]]
        hashes = hash_keys([k for ks in keys for k in ks])
        hit = TwoFilters.has(shared.value, places(hashes, bits)).tolist() if len(hashes) else []
        out = {"digest": [], "text_digest": [], "key": []}
        at = 0
        for row, (t, ks) in enumerate(zip(rows["text"], keys)):
            found = [k for i, k in enumerate(ks) if hit[at + i]]
            at += len(ks)
            if found:
                out["digest"] += [hashlib.sha256(k).digest() for k in found]
                out["text_digest"] += [text_digest(t)] * len(found)
                out["key"] += [rows["key"][row]] * len(found)
        return out

    found = store(per_batch(feedback, {"key": key, "text": text}, f"digest binary, text_digest binary, key {kind}", suspects, weigh="text"))
    # Stored, so that its size is known and a join to it may broadcast it, or split the suspects of a very common line.
    counted = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.min("key").alias("first_key"))
    return found, store(counted.filter(F.col("n_texts") >= min_texts))


def drop_repeated_lines(feedback: DataFrame, key: str = "session_id", text: str = "free_text_feedback", min_texts: int = 10,
                        min_chars: int = 1, keep_first: bool = False, kept: str = "kept_text", bits: int = FILTER_BITS,
                        segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``feedback`` with ``kept`` (the text without repeated lines), ``n_lines`` and ``n_dropped`` appended.

    A line is repeated when its key (blanks stripped, A-Z lower-cased) has ``min_chars`` code points or more and stands
    in ``min_texts`` texts or more. All lines with such a key go, in every text; with ``keep_first`` they stay in the
    texts under the least key that has the line. The other lines stay as they are, joined by ``\\n``.

    A null text counts as the empty one, which is one empty line. Rows with null or repeated keys are all kept and all
    counted. Columns of ``feedback`` named like an added one are replaced, other columns are carried along. An empty
    table gives an empty result.
    """
    found, exact = repeated_lines(feedback, text, key, min_texts, min_chars, bits, segment_bytes)
    # One row per distinct text and line, so that a text held by very many rows is one small group. Stored, so that
    # the join below is between two exchanges and the rows of such a text can be split over tasks.
    drops = store(found.select("digest", "text_digest").distinct().join(exact, "digest").groupBy(F.col("text_digest").alias("_digest")).agg(
        F.collect_list(F.struct("digest", "first_key")).alias("_drops")))
    base = feedback.drop(kept, "n_lines", "n_dropped", "_digest", "_drops")
    whole = base.withColumn("_digest", F.substring(F.unhex(F.sha2(F.coalesce(base[text], F.lit("")).cast("binary"), 256)), 1, 16))
    joined = whole.join(drops.hint("shuffle_hash"), "_digest", "left").drop("_digest")
    names = [c for c in base.columns]
    schema = joined.drop("_drops").schema
    position = names.index(text), names.index(key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in groups(batch, text, 8_000_000):
                part = batch.slice(first, last - first)
                texts, keys = part.column(position[0]).to_pylist(), part.column(position[1]).to_pylist()
                results = [cut_text(t, d, k, keep_first) for t, d, k in zip(texts, part.column(len(names)).to_pylist(), keys)]
                columns = [part.column(i) for i in range(len(names))]
                added = [pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.int64()), pa.array([r[2] for r in results], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, kept, "n_lines", "n_dropped"])

    return joined.select(*names, "_drops").mapInArrow(cut, schema.add(kept, "string").add("n_lines", "long").add("n_dropped", "long"))


def cut_text(text: str | None, drops: list | None, key, keep_first: bool) -> tuple[str, int, int]:
    """The text without the lines in ``drops``, its number of lines and how many were dropped."""
    text = text or ""
    if not drops:
        return text, text.count("\n") + 1, 0
    gone = {d["digest"] for d in drops if not (keep_first and key is not None and d["first_key"] == key)}
    lines = text.encode().split(b"\n")
    stay = [x for x in lines if hashlib.sha256(line_key(x)).digest() not in gone]
    return b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)
