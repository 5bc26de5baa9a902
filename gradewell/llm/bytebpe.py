"""Byte-level BPE encoding and decoding of whole feedback texts with recursive DuckDB queries inside each partition.

A text is split by the pattern of the tokenizer; every distinct word is contracted once per Python worker. Its bytes
become token-position rows which a recursive query joins with the merge table: each round contracts the leftmost pair
of least rank of every word until no pair is left. An ordered aggregation lists a word's ids and another one joins
the bytes of those ids again, which is the decoding. Texts are put together from their words, in order.

The merge table holds every pair of tokens whose joined bytes are a token, with that token's rank; it is built from
the rank file alone. A round also contracts every pair that no other merge can reach first. Let a pair of rank r be
(a, b), with the token t before a. Until (a, b) is contracted, a can only be taken by a merge (X, a), where X is t or grew from t and
so ends with the bytes of t; ``low_left`` of (t, a) is the least rank of all such merges. If it is more than r, (a, b) comes
first, whatever happens elsewhere in the word. Likewise behind b, where ``low_right`` of (b, u) is the least rank of a merge (b, Y)
whose Y begins with the bytes of u; there r itself will do, since of equal ranks the left one comes first. Two
neighbouring pairs cannot both pass. In words of more than ``KEPT_WORD`` bytes X, if it is not t itself, must also end with the byte
that stands before t, and Y go on with the byte behind u; and a pair is contracted as well if it is the leftmost one of least rank
among all within the longest token's bytes on both sides. (What merges further off could only reach it through tokens that grow
from there, and one that reached it would be longer than any.) So a word of any length takes few rounds. The ids
are always those of contracting one pair at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradewell.llm.common import per_batch

GROUP_BYTES = 4_000_000
CACHED_WORDS = 300_000
BATCH_BYTES = 600_000
KEPT_WORD = 64
POSITION_BITS = 32
WORD_BITS = 20
TOKEN_BITS = 20
MASK = (1 << POSITION_BITS) - 1
NEVER = 1 << 30
ASCII_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f"

#: Position keys are word << 32 | position, pair keys are rank << 32 | position; ``fb`` and ``lb`` are a token's first and last byte.
CONTRACT = f"""
with recursive t(k, tok, fb, lb, done) as (
  select k, tok, b, b, false from tokens
  union all
  (with pairs as (select k, tok, fb, lb, lead(tok) over by_k as nxt, lead(k) over by_k >> {POSITION_BITS} = k >> {POSITION_BITS} as same,
       case when lag(k) over by_k >> {POSITION_BITS} = k >> {POSITION_BITS} then lag(lb) over by_k end as byte_before,
       case when lead(k, 2) over by_k >> {POSITION_BITS} = k >> {POSITION_BITS} then lead(fb, 2) over by_k end as byte_behind, lead(lb) over by_k as lb_next
     from t where not done window by_k as (order by k)),
   ranked as (select p.*, m.id, case when {{sharp}} then least(m.id, x.low) else m.low_left end as low_left,
       case when {{sharp}} then least(m.id, y.low) else m.low_right end as low_right
     from pairs p left join merges m on m.pair = case when p.same then (p.tok::bigint << {TOKEN_BITS}) | p.nxt end
     left join grown_left x on x.triple = case when {{sharp}} and p.same then (p.tok::bigint << {TOKEN_BITS + 8}) | (p.nxt::bigint << 8) | p.byte_before end
     left join grown_right y on y.triple = case when {{sharp}} and p.same then (p.tok::bigint << {TOKEN_BITS + 8}) | (p.nxt::bigint << 8) | p.byte_behind end),
   near as (select k, tok, fb, lb, lb_next, id, low_right, (id::bigint << {POSITION_BITS}) | (k & {MASK}) as rank, lag(id) over by_k as id_before, lag(k) over by_k & {MASK} as at_before,
       lag(low_left) over by_k as low_left, lag(low_left, 2) over by_k as low_left_before, lead(low_right) over by_k as low_right_behind from ranked window by_k as (order by k)),
   least as (select *, {{bests}} from near),
   chosen as (select *, rank = best and rank = best_shifted or (id < coalesce(low_left, {NEVER}) and id <= coalesce(low_right_behind, {NEVER})) as taken from least),
   merged as (select *, {{taken_before}} as gone from chosen)
   select k, case when taken then id else tok end, fb, case when taken then lb_next else lb end, best_of_word is null from merged where gone is not true))
"""
#: Short words: the least pair of the word. Long ones: the least pair of two grids of blocks, shifted by half a block.
SHORT = {"bests": f"min(rank) over (partition by k >> {POSITION_BITS}) as best, best as best_shifted, best as best_of_word",
         "taken_before": f"id_before is not null and (((id_before::bigint << {POSITION_BITS}) | at_before) = best"
                         f" or (id_before < coalesce(low_left_before, {NEVER}) and id_before <= coalesce(low_right, {NEVER})))"}
LONG = {"bests": "min(rank) over (partition by k >> {block}) as best, min(rank) over (partition by (k + (1 << {block} - 1)) >> {block}) as best_shifted,"
                 f" min(rank) over (partition by k >> {POSITION_BITS}) as best_of_word",
        "taken_before": "lag(taken) over (order by k)"}
RESULT = f"""
select k >> {POSITION_BITS} as w, list(tok order by k) as ids, list(vocabulary.bytes order by k) as parts
from t join vocabulary on vocabulary.id = t.tok where done group by 1 order by 1
"""


def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordCoder:
    """Ids and decoded bytes of words, contracted in DuckDB and kept for words met early."""

    def __init__(self, rank_file: str, pattern: str, cached_words: int = CACHED_WORDS) -> None:
        import duckdb
        import regex
        self.ranks = read_ranks(rank_file)
        # The tokenizer's white space is Unicode's property of that name; Python's \s has four control characters more.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.loose = re.compile(r"\s | \s|\A | \Z")
        self.most = cached_words
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.chunk_ids: dict[str, bytes] = {}
        self.chunk_bytes: dict[str, bytes] = {}
        self.block_bits = max(max(map(len, self.ranks)), KEPT_WORD).bit_length() + 1  # half a block holds the longest token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": "1", "preserve_insertion_order": "false", "memory_limit": "1GB", "temp_directory": f"{tempfile.gettempdir()}/contract-{os.getpid()}"})
        for name, table in (
            *self.merge_tables().items(),
            ("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())})),
        ):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def merge_tables(self) -> dict[str, pa.Table]:
        """``merges`` (pair, id, low_left, low_right), and the bounds ``grown_left`` and ``grown_right`` (pair and byte beside it, low)."""
        ranks = self.ranks
        if max(ranks.values()) >= 1 << TOKEN_BITS:
            raise ValueError(f"ranks of more than {TOKEN_BITS} bits")
        ids, left, right, grown_left, grown_right = ({} for _ in range(5))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):  # the first rank met is the least
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is None or b is None:
                    continue
                ids[a << TOKEN_BITS | b] = rank
                for j in range(i):
                    if (t := ranks.get(token[j:i])) is not None:
                        left.setdefault(t << TOKEN_BITS | b, rank)
                        if j:
                            grown_left.setdefault(t << TOKEN_BITS + 8 | b << 8 | token[j - 1], rank)
                for j in range(i + 1, len(token) + 1):
                    if (u := ranks.get(token[i:j])) is not None:
                        right.setdefault(a << TOKEN_BITS | u, rank)
                        if j < len(token):
                            grown_right.setdefault(a << TOKEN_BITS + 8 | u << 8 | token[j], rank)
        pairs = sorted(left.keys() | right.keys())
        out = {"merges": pa.table({"pair": pa.array(pairs, pa.int64()), **{
            name: pa.array([known.get(p) for p in pairs], pa.int32()) for name, known in (("id", ids), ("low_left", left), ("low_right", right))}})}
        for name, known in (("grown_left", grown_left), ("grown_right", grown_right)):
            out[name] = pa.table({"triple": pa.array(known.keys(), pa.int64()), "low": pa.array(known.values(), pa.int32())})
        return out

    def contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of words, in the order given."""
        out: list = [None] * len(words)
        for long in (False, True):
            ours = [i for i, w in enumerate(words) if (len(w) > KEPT_WORD) == long]
            if ours:
                for i, found in zip(ours, self.contract_alike([words[i] for i in ours], long)):
                    out[i] = found
        return out

    def contract_alike(self, words: list[bytes], long: bool) -> list[tuple[bytes, bytes]]:
        form = {k: v.format(block=self.block_bits) for k, v in LONG.items()} if long else SHORT
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = (np.repeat(np.arange(len(words), dtype=np.int64), sizes) << POSITION_BITS) | (np.arange(len(flat)) - starts)
        self.db.register("given", pa.table({"k": keys, "tok": self.byte_ids[flat], "b": flat}))
        self.db.execute("create or replace temp table tokens as select * from given")
        rows = self.db.sql(CONTRACT.format(sharp=str(long).lower(), **form) + RESULT).to_arrow_table().combine_chunks()
        self.db.unregister("given")
        if not rows.num_rows:
            return []
        lists, parts = (rows.column(name).chunk(0) for name in ("ids", "parts"))
        ends = lists.offsets.to_numpy()
        ids = lists.values.to_numpy()[ends[0]:].astype("<u4").tobytes()
        ends = ((ends - ends[0]) * 4).tolist()
        tokens = parts.values
        places = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
        raw, cuts = tokens.buffers()[2].to_pybytes(), places[parts.offsets.to_numpy()].tolist()
        return [(ids[ends[i]:ends[i + 1]], raw[cuts[i]:cuts[i + 1]]) for i in range(len(words))]

    def look_up(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Every word of ``words`` with ids (little-endian unsigned 32-bit) and decoded bytes."""
        found, todo = {}, []
        for word in dict.fromkeys(words):
            if (known := self.words.get(word)) is not None:
                found[word] = known
                continue
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                found[word] = self.keep(word, (rank.to_bytes(4, "little"), raw))
            else:
                todo.append((word, raw))
        first = 0
        while first < len(todo):
            last, held = first, 0
            while last < len(todo) and (last == first or held + len(todo[last][1]) <= BATCH_BYTES) and last - first < 1 << WORD_BITS:
                held += len(todo[last][1])
                last += 1
            for (word, _), coded in zip(todo[first:last], self.contract([raw for _, raw in todo[first:last]])):
                found[word] = self.keep(word, coded)
            first = last
        return found

    def keep(self, word: str, coded: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        if len(self.words) < self.most // 2 and len(word) <= KEPT_WORD:
            self.words[word] = coded
        return coded

    def chunked(self, text: str) -> list[str]:
        """Parts whose words are those of the whole text.

        A lone space between two other characters always opens a word, so most texts can be cut there at once;
        where white space stands together the pattern itself cuts the text.
        """
        if not text or self.loosely_spaced(text):
            return self.split(text)
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def loosely_spaced(self, text: str) -> bool:
        """Whether a space stands at an end of the text or beside other white space."""
        if text[0] == " " or text[-1] == " " or "  " in text:
            return True
        if text.isascii():
            return any(c in text and (c + " " in text or " " + c in text) for c in ASCII_BLANKS)
        return self.loose.search(text) is not None

    def split_chunks(self, chunks: list[str]) -> list[list[str]]:
        """Words of every chunk; those that open with a space are split together, as each of them opens a word."""
        spaced = [c for c in chunks if c[0] == " " and len(c) > 1 and not c[1].isspace() and not c[-1].isspace() and " " not in c[1:]]
        words = self.split("".join(spaced))
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(spaced):
            return [self.split(c) for c in chunks]
        found = dict(zip(spaced, (words[i:j] for i, j in zip(starts, [*starts[1:], len(words)]))))
        return [found[c] if c in found else self.split(c) for c in chunks]

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as bytes and the decoded bytes of every text."""
        cut = [self.chunked(t) for t in texts]
        new = list(set().union(*cut) - self.chunk_ids.keys())
        if new:
            pieces = self.split_chunks(new)
            words = self.look_up([w for ws in pieces for w in ws])
            for c, ws in zip(new, pieces):
                if len(ws) == 1:
                    self.chunk_ids[c], self.chunk_bytes[c] = words[ws[0]]
                else:
                    self.chunk_ids[c] = b"".join([words[w][0] for w in ws])
                    self.chunk_bytes[c] = b"".join([words[w][1] for w in ws])
        ids, raw = self.chunk_ids.__getitem__, self.chunk_bytes.__getitem__
        out = [(b"".join(map(ids, parts)), b"".join(map(raw, parts))) for parts in cut]
        room = self.most - len(self.chunk_ids) + len(new)
        for c in new:  # chunks met early are the frequent ones; the rest goes again
            if room > 0 and len(c) <= KEPT_WORD:
                room -= 1
            else:
                del self.chunk_ids[c], self.chunk_bytes[c]
        return out

    def decode_many(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Bytes of every id sequence, by an ordered aggregation over position rows; unknown ids are an error."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        ids = np.concatenate([np.asarray(s, np.int64) for s in sequences]) if len(sequences) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        self.db.register("given", pa.table({"s": owner, "k": np.arange(len(ids)), "id": ids}))
        rows = self.db.execute("select s, list(bytes order by k), count(*) from given join vocabulary using (id) group by s").fetchall()
        self.db.unregister("given")
        out = [b""] * len(sequences)
        for s, parts, n in rows:
            if n == sizes[s]:
                out[s] = b"".join(parts)
        if sum(n for *_, n in rows) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        return out


@lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> WordCoder:
    return WordCoder(rank_file, pattern)


def encode_feedback(feedback: DataFrame, rank_file: str, pattern: str, key: str = "session_id", text: str = "free_text_feedback") -> DataFrame:
    """(key, token_ids, decoded): the ids of every whole text and the bytes these ids stand for; no shuffle.

    A null text counts as empty: no ids, no bytes. Keys may be null or repeated, every row gives a row; other columns
    are not read, whatever their names. An empty table gives an empty result. Special tokens are never recognised.
    """
    kind = feedback.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        coded = coder(rank_file, pattern).encode_many([t or "" for t in rows["text"]])
        return {"key": rows["key"], "token_ids": [np.frombuffer(ids, np.uint32).astype(np.int32) for ids, _ in coded], "decoded": [raw for _, raw in coded]}

    return per_batch(feedback, {"key": key, "text": text}, f"key {kind}, token_ids array<int>, decoded binary", work, weigh="text", group_bytes=GROUP_BYTES).withColumnRenamed("key", key)


def encoded_digests(feedback: DataFrame, rank_file: str, pattern: str, key: str = "session_id", text: str = "free_text_feedback") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): as ``encode_feedback``, with digests in place of the ids and bytes.

    ``ids_sha256`` is taken over the ids as little-endian unsigned 32-bit integers. Nulls, repeats and empty tables
    are treated as in ``encode_feedback``.
    """
    kind = feedback.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        coded = coder(rank_file, pattern).encode_many([t or "" for t in rows["text"]])
        return {"key": rows["key"], "n_tokens": [len(ids) // 4 for ids, _ in coded],
                "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids, _ in coded], "decoded_sha256": [hashlib.sha256(raw).hexdigest() for _, raw in coded]}

    return per_batch(feedback, {"key": key, "text": text}, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work, weigh="text", group_bytes=GROUP_BYTES).withColumnRenamed("key", key)


def decode_feedback(encoded: DataFrame, rank_file: str, pattern: str, key: str = "session_id", token_ids: str = "token_ids") -> DataFrame:
    """(key, decoded): the bytes of id sequences; a null sequence counts as empty, an id outside the vocabulary is an error."""
    kind = encoded.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"key": rows["key"], "decoded": coder(rank_file, pattern).decode_many([ids or [] for ids in rows["ids"]])}

    return per_batch(encoded, {"key": key, "ids": token_ids}, f"key {kind}, decoded binary", work).withColumnRenamed("key", key)
