"""Importance resampling of feedback texts towards a target table, with ranks from a distributed radix sort.

Words (runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased) form runs of one to three; each run
falls into the bucket of its CRC-32. Both tables are counted per bucket, and a bucket's gain is the logarithm of its share
in the target over its share in the feedback, in thousandths. Gains are one array of fixed length that every task gets; a
text's weight is the sum of the gains of its runs. Weight plus Gumbel noise, drawn from a hash of the key, is the score;
the highest scores are the draw without replacement.

Ranks come from least-significant-digit radix sort over the composite key (score falling, key rising): each pass counts
(block, digit), turns the counts into global offsets and sends every row to its place, so rows of equal digits keep
their order. A block holds at most ``block_rows`` rows whatever the keys are, so equal scores cannot gather in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StringType, StructType

from gradewell.llm.common import groups, per_batch
from gradewell.session import settle, store

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
BLOCK_ROWS = 1 << 16
DIGIT_BITS = 12
SLICE_BYTES = 1_000_000
#: Lower-cases A-Z and turns every byte that is no word character into a space.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def run_buckets(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Buckets of all runs of one to three words, repeats included, and the number of words."""
    raw = (text or "").encode().translate(WORD_BYTES)
    found, n_words, carried, at = [], 0, [], 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        words = carried + raw[at:end].split()
        old = len(carried)
        n_words += len(words) - old
        codes = list(map(crc32, words))
        spaced = [b" " + w for w in words]
        for length in range(1, LONGEST_RUN + 1):
            # codes[i] is the CRC of the run of this length that starts at word i; runs within the carried words were counted before.
            found.append(np.array(codes[max(0, old - length + 1):], np.uint32))
            codes = list(map(crc32, spaced[length:], codes))
        carried, at = words[-(LONGEST_RUN - 1):], end
    return (np.concatenate(found) % np.uint32(buckets) if found else np.empty(0, np.uint32)), n_words


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Runs of a whole table per bucket; every task sends one row per bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(run_buckets(t.as_py(), buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], schema=schema)

    sent = texts.select(texts[text].alias("text")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(feedback: DataFrame, target: DataFrame, text: str = "free_text_feedback", target_text: str = "title", buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / feedback share)) per bucket, both shares with one added run per bucket."""
    s, t = bucket_counts(feedback, text, buckets).tolist(), bucket_counts(target, target_text, buckets).tolist()
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def noise(key, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_feedback(feedback: DataFrame, gains: np.ndarray, key: str, text: str, seed: int) -> DataFrame:
    """(key, n_features, n_words, weight, score) of every text."""
    kind = feedback.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        runs = [run_buckets(t, len(gains)) for t in rows["text"]]
        weights = [int(gains[b].sum()) for b, _ in runs]
        return {"key": rows["key"], "n_features": [len(b) for b, _ in runs], "n_words": [n for _, n in runs], "weight": weights,
                "score": [w + noise(k, seed) for w, k in zip(weights, rows["key"])]}

    return per_batch(feedback, {"key": key, "text": text}, f"key {kind}, n_features bigint, n_words bigint, weight bigint, score bigint", work, weigh="text")


def unsigned(values: np.ndarray) -> np.ndarray:
    """Signed longs as unsigned ones in the same order."""
    return values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def digits_of(batch: pa.RecordBatch | pa.Table, word: str, least: int, shift: int, bits: int) -> np.ndarray:
    values = unsigned(batch.column(word).to_numpy(zero_copy_only=False)) - np.uint64(least)
    return ((values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def radix_positions(rows: DataFrame, words: list[str], block_rows: int = BLOCK_ROWS, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` with ``position``: 0, 1, 2, ... in the order of the long columns ``words``, the first one being most significant.

    Rows that agree in all of ``words`` keep the order in which they were stored. Every pass writes its rows to the
    shared folder, so a lost executor costs its own blocks only. No column of ``words`` may hold nulls; ``position``
    must not be a column of ``rows``. An empty table gives an empty result.
    """
    block_bits = block_rows.bit_length() - 1
    if 1 << block_bits != block_rows:
        raise ValueError("block_rows must be a power of two")
    placed = store(rows.withColumn("position", F.monotonically_increasing_id()))
    ends = placed.agg(*[f(w).alias(f"{w}_{n}") for w in words for n, f in (("min", F.min), ("max", F.max))]).first()
    passes = []
    for w in reversed(words):
        if ends[f"{w}_min"] is not None:
            low, high = ends[f"{w}_min"] + (1 << 63), ends[f"{w}_max"] + (1 << 63)
            passes += [(w, low, shift) for shift in range(0, (high - low).bit_length(), digit_bits)]
    for w, low, shift in passes or [(words[0], 0, 0)]:
        placed = store(counting_pass(placed, w, low, shift, digit_bits if passes else 0, block_bits))
    return placed


def counting_pass(placed: DataFrame, word: str, least: int, shift: int, bits: int, block_bits: int) -> DataFrame:
    """One stable counting sort: rows go to offset(digit, block) + place among the block's rows of that digit."""
    schema = to_arrow_schema(placed.schema)
    counted = pa.schema([("block", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = (batch.column("position").to_numpy() >> block_bits << bits) | digits_of(batch, word, least, shift, bits)
            pairs, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> bits), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], schema=counted)

    counts = settle(placed.select("position", word).mapInArrow(count, "block bigint, digit int, n bigint").groupBy("block", "digit").agg(F.sum("n").alias("n")))
    bases = np.zeros(1 << bits, np.int64)  # 2 ** bits totals, whatever the number of rows
    for row in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():
        bases[row["digit"]] = row["n"]
    bases = np.cumsum(bases) - bases
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def scatter(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.select(schema.names).take(pa.array(np.argsort(rows.column("position").to_numpy())))
        digits = digits_of(rows, word, least, shift, bits)
        order = np.argsort(digits, kind="stable")
        sorted_digits = digits[order]
        local = np.arange(len(order)) - np.searchsorted(sorted_digits, sorted_digits)
        offset = np.zeros(1 << bits, np.int64)
        offset[before.column("digit").to_numpy()] = before.column("before").to_numpy()
        to = np.empty(len(order), np.int64)
        to[order] = (bases + offset)[sorted_digits] + local
        return rows.set_column(rows.schema.get_field_index("position"), "position", pa.array(to)).cast(schema)

    blocks = placed.withColumn("_block", F.expr(f"position >> {block_bits}"))
    return blocks.groupBy("_block").cogroup(offsets.groupBy("block")).applyInArrow(scatter, placed.schema)


def key_words(rows: DataFrame, key: str) -> DataFrame:
    """Long columns ``_w0``, ``_w1``, ... that order as ``key`` does, nulls last."""
    kind = rows.schema[key].dataType
    words = [F.col(key).isNull().cast("bigint")]
    if isinstance(kind, IntegralType):
        words.append(F.coalesce(F.col(key).cast("bigint"), F.lit(0)))
    elif isinstance(kind, StringType):
        # Seven bytes of the UTF-8 form a word, filled up with zero bytes; a zero byte in a key would tie with the end.
        longest = rows.agg(F.max(F.octet_length(key))).first()[0] or 0
        hexed = F.rpad(F.hex(F.coalesce(F.col(key), F.lit("")).cast("binary")), (longest + 6) // 7 * 14, "0")
        words += [F.conv(F.substring(hexed, i + 1, 14), 16, 10).cast("bigint") for i in range(0, (longest + 6) // 7 * 14, 14)]
    else:
        raise TypeError(f"keys of type {kind.simpleString()} have no digits")
    return rows.select("*", *[w.alias(f"_w{i}") for i, w in enumerate(words)])


def resample_feedback(feedback: DataFrame, target: DataFrame, key: str = "session_id", text: str = "free_text_feedback", target_text: str = "title",
                      percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = SEED, block_rows: int = BLOCK_ROWS,
                      digit_bits: int = DIGIT_BITS) -> DataFrame:
    """(key, n_features, weight, score, rank): every feedback text, and the rank of those drawn towards ``target``'s titles.

    Of the N texts with ``min_words`` words or more, the floor(percent N / 100) highest scores are drawn and ranked from 1;
    equal scores go by the lesser key. Other texts have a null rank.

    A null text has no words: no features, weight 0. A null key is hashed as ``None`` and comes after all others of its
    score; repeated keys are rows of their own, and rows equal in score and key rank in the order in which they are stored.
    An empty target makes all runs unlikely alike; an empty table gives an empty result. Other columns are not read,
    whatever their names. Keys are integers or strings.
    """
    gains = bucket_gains(feedback, target, text, target_text, buckets)
    scored = store(scored_feedback(feedback, gains, key, text, seed))
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    able = key_words(able.withColumn("_falling", F.bitwise_not("score")), "key")
    ranked = radix_positions(able, ["_falling", *[c for c in able.columns if c.startswith("_w")]], block_rows, digit_bits)
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    out = ["key", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(
        scored.filter(F.col("n_words") < min_words).select(*out, F.lit(None).cast("bigint").alias("rank"))).withColumnRenamed("key", key)
