"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays: every code point gets a class, look-ahead turns classes into
symbols, and the automaton of the split pattern is run by an associative scan: each block of
symbols is reduced to the transition function it applies (a map from state to state), functions
are composed from block to block, and a second pass reads the token starts. No text is matched
by a regex; the class table alone, made once a process, takes three of the library's.
The slices found are hashed; each distinct slice is merged once and kept in a bounded cache.
Offsets (tokens per piece, bytes per token) are kept, and decoding gathers the bytes back.

A cache hit by a hash collision would decode to other bytes, so every run of rows is decoded and
compared with its input; rows that differ are encoded again without the cache.

Defined cases: null text is empty (no token); text of any length is encoded whole; a row with a
null key is kept; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import slices

# Fixed value: the split pattern that the automaton below states.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Classes of code points.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE = range(6)
# Symbols: a class with what follows it. _LAST: white space before something else.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_BLANK_LAST, S_SPACE, S_SPACE_LAST, S_QUOTE2, S_QUOTE3 = range(9)
# States after a code point. OPEN: nothing can be added to the token. LEFT1, LEFT2: so many code points of a contraction follow.
OPEN, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, IN_SPACE, LEFT1, LEFT2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and token start by (symbol, state); symbols from 9 on open a row of the table."""
    to, start = np.zeros((18, 8), np.uint8), np.ones((18, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTER), (S_NUMBER, IN_NUMBER), (S_OTHER, IN_OTHER)):
        to[symbol] = state
        start[symbol, [state, AFTER_BLANK]] = False
    to[[S_BLANK, S_SPACE]] = IN_SPACE
    start[[S_BLANK, S_SPACE], IN_SPACE] = False
    to[S_BLANK_LAST], to[S_SPACE_LAST] = AFTER_BLANK, OPEN
    to[S_QUOTE2], to[S_QUOTE3] = LEFT1, LEFT2
    for symbol in (S_QUOTE2, S_QUOTE3):  # inside a run of symbols, or after a blank, it is one of them
        to[symbol, [IN_OTHER, AFTER_BLANK]] = IN_OTHER
        start[symbol, [IN_OTHER, AFTER_BLANK]] = False
    to[:9, LEFT2], to[:9, LEFT1] = LEFT1, OPEN
    start[:9, [LEFT1, LEFT2]] = False
    to[9:], start[9:] = to[:9, [OPEN]], True
    return to, start


_TO, _START = _automaton()


@cache
def _classes() -> np.ndarray:
    """Class of every code point, as the installed tokenizer library's own Unicode tables have it.

    An encoder without merges drops what its pattern doesn't match, so it filters a text of all code points.
    """
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        kept = tiktoken._tiktoken.CoreBPE(single, {}, pattern).encode_ordinary
        for first in range(0, 0x110000, 1 << 14):  # a list of ids takes eight times the bytes
            block = "".join(chr(c) for c in range(first, first + (1 << 14)) if not 0xD800 <= c < 0xE000)
            out[ta.codepoints(np.frombuffer(bytes(kept(block)), np.uint8))] = kind
    out[32], out[39] = BLANK, QUOTE
    return out


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of code points; firsts: where rows of the table begin."""
    n = len(points)
    kind = _classes()[points]
    white = (kind == BLANK) | (kind == SPACE)
    begins = np.zeros(n + 3, bool)
    begins[firsts] = True
    begins[n:] = True
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_OTHER], np.uint8)[kind]
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~white[1:]
    solid_next &= ~begins[1 : n + 1]
    out[white & solid_next] += 1  # S_BLANK_LAST, S_SPACE_LAST
    at = np.flatnonzero(kind == QUOTE)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        near, far = ~begins[at + 1], ~begins[at + 1] & ~begins[at + 2]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        long = far & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[at[short]], out[at[long]] = S_QUOTE2, S_QUOTE3
    out[firsts] += 9
    return out


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where tokens start, by the scan over blocks of transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    flat, begin = _TO.ravel(), _START.ravel()
    length = max(1, int(n**0.5))
    count = -(-n // length)
    grid = np.zeros(count * length, np.intp)
    grid[:n] = symbols(points, firsts).astype(np.intp) * 8
    grid = np.ascontiguousarray(grid.reshape(count, length).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (count, 1))
    for column in grid:
        maps = flat[column[:, None] + maps]
    entry, state = np.empty(count, np.uint8), OPEN
    for k, row in enumerate(maps.tolist()):
        entry[k] = state
        state = row[state]
    found = np.empty(grid.shape, bool)
    state = entry
    for j, column in enumerate(grid):
        at = column + state
        found[j] = begin[at]
        state = flat[at]
    return np.flatnonzero(found.T.ravel()[:n])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: its own if it has one, else what is left when no two neighbours can be joined.

    The pair of least rank goes first, of equal ones the leftmost. A heap holds the pairs, so a slice of n
    bytes takes n log n steps; an entry whose pair has changed since is passed over.
    """
    if (own := ranks.get(piece)) is not None:
        return [own]
    n = len(piece)
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n))
    pair = array("q", [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1])
    heap = [rank * n + i for i, rank in enumerate(pair) if rank >= 0]
    heapify(heap)
    while heap:
        rank, at = divmod(heappop(heap), n)
        if pair[at] != rank:
            continue
        pair[after[at]] = -1
        after[at] = after[after[at]]
        before[after[at]] = at
        for left in (before[at], at):
            if left >= 0 and after[left] < n:
                pair[left] = ranks.get(piece[left : after[after[left]]], -1)
                if pair[left] >= 0:
                    heappush(heap, pair[left] * n + left)
            elif left >= 0:
                pair[left] = -1
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Codec:
    """Encoder and decoder for one file of ranks."""

    #: Distinct slices kept; when there are more, the cache starts anew.
    KEPT = 400_000

    def __init__(self, content: bytes):
        pairs = [line.split() for line in content.splitlines() if line]
        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(ranks.values()) + 1
        self.lengths, self.places = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.places[1:] = np.cumsum(self.lengths)[:-1]
        self.table = np.zeros(int(self.lengths.sum()), np.uint8)
        for token, rank in ranks.items():
            self.table[self.places[rank] : self.places[rank] + len(token)] = np.frombuffer(token, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.counts, self.offsets = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _room(self, slots: int, tokens: int) -> None:
        while len(self.counts) < slots:
            self.counts, self.offsets = (np.concatenate([a, np.zeros_like(a)]) for a in (self.counts, self.offsets))
        while len(self.pool) < tokens:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the pieces of all rows."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        if data.max() < 128:
            starts = token_starts(data, inner)
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte place of each code point
            starts = lead[token_starts(ta.codepoints(data), np.searchsorted(lead, inner))]
        return starts, np.append(starts[1:], len(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows; for each row its first id; tokens of each piece."""
        starts, ends = self.pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        distinct, where, which = np.unique(ta.run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.slots) + len(distinct) > self.KEPT:
            self.clear()
        slots = np.fromiter(map(self.slots.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            body, first = data.tobytes(), len(self.slots)
            found = [merged(body[a:b], self.ranks) for a, b in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)]
            sizes = np.array([len(x) for x in found])
            self._room(first + len(fresh), self.used + int(sizes.sum()))
            self.counts[first : first + len(fresh)] = sizes
            self.offsets[first : first + len(fresh)] = self.used + np.cumsum(sizes) - sizes
            self.pool[self.used : self.used + int(sizes.sum())] = np.concatenate([np.array(x, np.uint32) for x in found])
            self.used += int(sizes.sum())
            slots[fresh] = np.arange(first, first + len(fresh))
            self.slots.update(zip(distinct[fresh].tolist(), slots[fresh].tolist(), strict=True))
        slots = slots[which]
        counts = self.counts[slots]
        until = np.cumsum(counts)
        ids = self.pool[np.repeat(self.offsets[slots] - (until - counts), counts) + np.arange(until[-1])]
        return ids, np.concatenate([[0], until])[np.searchsorted(starts, offsets)], counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, and the place after each id's bytes."""
        sizes = self.lengths[ids]
        until = np.cumsum(sizes)
        return self.table[np.repeat(self.places[ids] - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)], until

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, decoded bytes) of each row; what doesn't decode to its input is merged without the cache."""
        for first, last in slices(offsets, ta.SLICE):
            part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            ids, heads, _ = self.encode(part, at)
            back, until = self.decode(ids)
            if not np.array_equal(back, part):
                self.clear()
                for a, b in zip(at[:-1], at[1:], strict=True):
                    starts, ends = self.pieces(part[a:b], np.array([0, b - a]))
                    own = [np.array(merged(part[a + x : a + y].tobytes(), self.ranks), np.uint32) for x, y in zip(starts, ends, strict=True)]
                    own = np.concatenate([np.zeros(0, np.uint32), *own])
                    yield own, self.decode(own)[0]
                continue
            places = np.concatenate([[0], until])
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                yield ids[a:b], back[places[a] : places[b]]


@cache
def codec(content: bytes) -> Codec:
    return Codec(content)


def _content(docs: DataFrame, ranks: str):
    """The rank file's bytes (a fixed file of under 1 MB), sent once to each executor."""
    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the automaton states another split pattern than the vocabulary's")
    with open(ranks, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _mapped(docs: DataFrame, ranks: str, key: str, text: str, row, names: list[str], kinds: list, schema: str) -> DataFrame:
    content = _content(docs, ranks)
    kept = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))

    def run(batches):
        own = codec(content.value)
        for batch in batches:
            rows = [row(ids, back) for ids, back in own.rows(*ta.buffers(batch.column(1)))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [key, *names])

    return kept.mapInArrow(run, f"{key} long, {schema}")


def encode_digests(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded bytes."""

    def row(ids, back):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.tobytes()).hexdigest()

    return _mapped(docs, ranks, key, text, row, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text."""
    return _mapped(docs, ranks, key, text, lambda ids, back: (ids.astype(np.int32),), ["ids"], [pa.list_(pa.int32())], "ids array<int>")


def token_counts(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every whole text."""
    return _mapped(docs, ranks, key, text, lambda ids, back: (len(ids),), ["n_tokens"], [pa.int64()], "n_tokens long")


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text, ends): the text of each list of ids, and for each id the byte offset after it."""
    content = _content(encoded, ranks)
    kept = encoded.select(F.col(key).cast("long").alias(key), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches):
        own = codec(content.value)
        for batch in batches:
            back = [own.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes().decode("utf-8", "replace") for b, _ in back], pa.string()), pa.array([u for _, u in back], pa.list_(pa.int64()))], [key, "text", "ends"])

    return kept.mapInArrow(run, f"{key} long, text string, ends array<long>")
