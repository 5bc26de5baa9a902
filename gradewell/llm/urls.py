"""Allow and block rules over the links of literature records, by a bit-parallel wildcard automaton.

Rules are globs over the canonical link, host followed by path. All rules are laid one after another into the bits of a
few 64-bit words; a table gives for every byte the bits whose pattern place accepts it, another the bits that loop on
it. Shift-And then moves all rules over one byte in a handful of word operations: places advance by a shift, loops keep
theirs. NumPy runs many links of like length at once, a column of bytes at a time.

Glob syntax: ``*`` any run without a slash, ``**`` any run, ``?`` one byte but a slash; all else stands for itself. A rule
must fit the whole link.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gradewell.llm.common import per_batch

WORD = 64
CELLS = 2_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Links that no listed rule decides are blocked by these globs and else allowed.
DEFAULT_BLOCKED = ("**pills**", "**casino**", "**free-bets**", "**spam-farm**", "**porn**", "**xxx**", "**viagra**")


def host_and_path(link: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty without ``://``."""
    _, found, rest = (link or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class WildcardAutomaton:
    """All globs as one bit vector: place p of a rule is set when its first p symbols fit what was read."""

    def __init__(self, globs: Sequence[str]) -> None:
        self.size = len(globs)
        accept: list[set[int] | None] = []
        loops: list[str] = []
        first, last = [], []
        for glob in globs:
            first.append(len(loops))
            accept.append(set())
            loops.append("")
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i:i + 2] == b"**":
                    loops[-1], i = "any", i + 2
                elif raw[i:i + 1] == b"*":
                    loops[-1], i = loops[-1] or "part", i + 1
                else:
                    accept.append(set(range(256)) - {47} if raw[i:i + 1] == b"?" else {raw[i]})
                    loops.append("")
                    i += 1
            last.append(len(loops) - 1)
        self.words = max(1, -(-len(loops) // WORD))
        self.accept = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for place, (symbols, loop) in enumerate(zip(accept, loops)):
            word, bit = place // WORD, np.uint64(1 << place % WORD)
            self.accept[sorted(symbols), word] |= bit
            if loop:
                self.loop[:, word] |= bit
                if loop == "part":
                    self.loop[47, word] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for place in first:
            self.start[place // WORD] |= np.uint64(1 << place % WORD)
        self.last = np.array(last, np.int64)

    def fits(self, links: Sequence[str]) -> np.ndarray:
        """One row per link, one column per rule."""
        raw = [x.encode() for x in links]
        out = np.zeros((len(raw), self.size), bool)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and (last + 1 - first) * (len(raw[order[last]]) + 1) <= CELLS:
                last += 1
            chosen = order[first:last]
            out[chosen] = self.run([raw[i] for i in chosen])
            first = last
        return out

    def run(self, raw: list[bytes]) -> np.ndarray:
        """Links in order of length: the ones that have ended stand first and keep their state."""
        sizes = np.array([len(r) for r in raw])
        longest = int(sizes[-1]) if len(raw) else 0
        codes = np.zeros((len(raw), longest), np.uint8)
        for i, r in enumerate(raw):
            codes[i, :len(r)] = np.frombuffer(r, np.uint8)
        state = np.tile(self.start, (len(raw), 1))
        begun = np.searchsorted(sizes, np.arange(longest), side="right")
        one, top = np.uint64(1), np.uint64(WORD - 1)
        for at in range(longest):
            live = state[begun[at]:]
            byte = codes[begun[at]:, at]
            moved = live << one
            if self.words > 1:
                moved[:, 1:] |= live[:, :-1] >> top
            state[begun[at]:] = (moved & self.accept[byte]) | (live & self.loop[byte])
        return ((state[:, self.last // WORD] >> (self.last % WORD).astype(np.uint64)) & one).astype(bool)


class LinkJudge:
    def __init__(self, rules: Sequence[tuple[str, str, str]], blocked: Sequence[str]) -> None:
        self.rules = [(verdict, host + path) for verdict, host, path in rules]
        globs = []
        for _, host, path in rules:
            fixed = escape_free(host + path)
            globs += [fixed + "**", "*." + fixed + "**"]
        self.automaton = WildcardAutomaton([*globs, *blocked])

    def judge(self, links: Sequence[str | None]) -> dict[str, list]:
        parts = [host_and_path(x) for x in links]
        fits = self.automaton.fits([h + p for h, p in parts])
        n = len(self.rules)
        listed = fits[:, 0:2 * n:2] | fits[:, 1:2 * n:2]
        blocked = fits[:, 2 * n:].any(axis=1)
        rank = np.array([len(text) for _, text in self.rules], np.int64)
        best = np.where(listed, rank, -1).argmax(axis=1) if n else np.zeros(len(parts), np.int64)
        has = listed.any(axis=1)
        return {
            "host": [h for h, _ in parts], "path": [p for _, p in parts],
            "rule": [self.rules[b][1] if ok else None for b, ok in zip(best, has)],
            "verdict": [self.rules[b][0] if ok else "block" if bad else "allow" for b, ok, bad in zip(best, has, blocked)],
        }


def escape_free(text: str) -> str:
    if "*" in text or "?" in text:
        raise ValueError("hosts and paths of listed rules stand for themselves: no wildcards")
    return text


@lru_cache(maxsize=4)
def link_judge(rules: tuple, blocked: tuple) -> LinkJudge:
    return LinkJudge(rules, blocked)


def judge_links(literature: DataFrame, rules: Sequence[tuple[str, str, str]], blocked: Sequence[str] = DEFAULT_BLOCKED,
                key: str = "title", link: str = "link_or_doi") -> DataFrame:
    """(key, host, path, rule, verdict) for every literature record; no shuffle.

    ``rules`` are (verdict, host, path): such a rule fits its host and all subdomains when the link's path starts with
    its path; of several the one with the longest host + path wins (of equal ones the first). Where none fits, ``rule``
    is null and the globs in ``blocked`` decide. Null links and links without ``://`` have an empty host and path. Keys
    may be null or repeated; other columns are not read, whatever their names. An empty table gives an empty result.
    """
    kind = literature.schema[key].dataType.simpleString()
    fixed, globs = tuple(tuple(r) for r in rules), tuple(blocked)

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"key": rows["key"], **link_judge(fixed, globs).judge(rows["link"])}

    return per_batch(literature, {"key": key, "link": link}, f"key {kind}, host string, path string, rule string, verdict string", work).withColumnRenamed("key", key)
