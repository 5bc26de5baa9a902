"""Token counts of whole feedback texts with a piece model, by overlap resynchronisation.

A short text is encoded at once. A huge one is encoded in overlapping chunks with offsets; neighbouring chunks are
spliced inside their overlap at a boundary that both have and that is proven stable: no piece of the vocabulary holds
the two characters on its sides next to each other, so no merge can ever cross it, whatever the context. Tokens between
two such boundaries depend on nothing outside them, which makes the count equal to that of the whole text. Where an
overlap has no such boundary, it is doubled, up to the whole rest of the text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from gradewell.llm.common import per_batch

CHUNK_CHARS = 50_000
OVERLAP_CHARS = 200
SPACE = "▁"


class Splicer:
    """Counts the tokens of one text. The model must leave characters as they are (identity normalisation)."""

    def __init__(self, model_file: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.inside = {piece[i:i + 2] for piece in pieces for i in range(len(piece) - 1)}
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """No piece can hold both characters around position ``at``."""
        return text[at - 1:at + 1].replace(" ", SPACE) not in self.inside

    def encode(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of every token in characters."""
        return self.model.encode_as_offset_mapping(text)["offsets"]

    def count_many(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        counts = [0] * len(texts)
        for i, ids in zip(short, self.model.encode_as_numpy([texts[i] for i in short], num_threads=1) if short else []):
            counts[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                counts[i] = self.count_long(t)
        return counts

    def count_long(self, text: str) -> int:
        end = min(self.chunk, len(text))
        tokens, base, first, total = self.encode(text[:end]), 0, 0, 0
        while end < len(text):
            overlap, joint = self.overlap, None
            while joint is None:
                start = end - overlap
                if start <= base:  # the overlap has swallowed the chunk: encode on from its own start, with a longer chunk
                    end = min(len(text), base + 2 * (end - base))
                    tokens = self.encode(text[base:end])
                    break
                following_end = min(len(text), start + self.chunk + overlap)
                following = self.encode(text[start:following_end])
                joint = self.join(text, tokens, base, following, start, end)
                if joint is None:
                    overlap *= 2
                    self.widened += 1
            if joint is not None:
                left, right = joint
                total += left - first
                tokens, base, first, end = following, start, right, following_end
        return total + len(tokens) - first

    def join(self, text: str, left: list, left_base: int, right: list, start: int, end: int) -> tuple[int, int] | None:
        """Token index in both chunks of one stable boundary strictly inside the overlap, or None."""
        begins = {}
        for i in range(len(left) - 1, -1, -1):
            at = left[i][0] + left_base
            if at <= start:
                break
            if at < end:
                begins[at] = i  # the first token that begins here: empty spans of byte tokens come before their character
        for i, (begin, _) in enumerate(right):
            at = begin + start
            if at >= end:
                break
            if at in begins and self.stable(text, at):
                return begins[at], i
        return None


@lru_cache(maxsize=4)
def splicer(model_file: str, chunk_chars: int, overlap_chars: int) -> Splicer:
    return Splicer(model_file, chunk_chars, overlap_chars)


def feedback_token_counts(feedback: DataFrame, model_file: str, key: str = "session_id", text: str = "free_text_feedback",
                          limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every feedback row; no shuffle.

    ``n_bytes`` is the UTF-8 length, ``n_tokens`` the number of tokens of the whole text without begin, end or added
    tokens, ``over_limit`` whether that is more than ``limit``. A null or empty text has 0 bytes and 0 tokens. Null and
    repeated keys are kept, row by row; other columns of ``feedback`` are not read, whatever their names. An empty
    table gives an empty result. The model file is read by every executor from ``model_file``.
    """
    kind = feedback.schema[key].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in rows["text"]]
        counts = splicer(model_file, chunk_chars, overlap_chars).count_many(texts)
        return {"key": rows["key"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts,
                "over_limit": [n > limit for n in counts]}

    out = per_batch(feedback, {"key": key, "text": text}, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", work, weigh="text")
    return out.withColumnRenamed("key", key)
