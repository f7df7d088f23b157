"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves whole pre-tokens that are vocabulary entries by a minimal perfect hash (hash and displace), for
all pre-tokens of a block of texts at once. Tier two merges the others with a heap over linked bytes. The
pre-tokens are cut by code-point classes, as the splitting pattern of the vocabulary's public tokenizer would.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import trimmed

#: Texts are cut and looked up in blocks of about this many characters.
BLOCK_CHARS = 1 << 18
#: Distinct merged pre-tokens that a task remembers before it starts anew; they go when the task ends.
MEMO = 600_000
#: Rows that go back at once: their ids, as 32-bit numbers, are all that is held of them.
ROWS = 500

_EDGE = re.compile("[A-Za-z](?= )")

OTHER, LETTER, NUMBER, SPACE = range(4)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):  # White_Space
        out[c] = SPACE
    return out


def _stir(h: np.ndarray, x: np.ndarray | np.uint64) -> np.ndarray:
    h = (h ^ x) * _MUL
    return h ^ (h >> np.uint64(29))


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """h spread over 0 .. n-1."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Words:
    """Byte strings inside a buffer, read eight bytes at a time."""

    def __init__(self, data: bytes, starts: np.ndarray, lengths: np.ndarray):
        padded = data + bytes(8)
        self.words = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
        self.starts, self.lengths = starts, lengths

    def word(self, k: int, of: np.ndarray) -> np.ndarray:
        return self.words[self.starts[of] + 8 * k] & _MASK[np.minimum(self.lengths[of] - 8 * k, 8)]

    def hashes(self, of: np.ndarray) -> np.ndarray:
        h = _stir(np.full(len(of), 0x1234567, np.uint64), self.lengths[of].astype(np.uint64))
        for k in range(int(-(-self.lengths[of].max(initial=0) // 8))):
            at = np.flatnonzero(self.lengths[of] > 8 * k)
            h[at] = _stir(h[at], self.word(k, of[at]))
        return h


@dataclass
class PerfectHash:
    """A minimal perfect hash of n distinct byte strings: slot in 0 .. n-1, with the strings kept to confirm a hit."""

    n: int
    shift: np.ndarray
    ids: np.ndarray  # by slot
    lengths: np.ndarray  # by slot
    text: np.ndarray  # by slot and word
    longest: int

    @staticmethod
    def slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return _range(_stir(_stir(h, shift), _MUL), n)

    @classmethod
    def build(cls, keys: list[bytes], ids: list[int]) -> PerfectHash:
        n, lengths = len(keys), np.array([len(k) for k in keys], np.int64)
        words = Words(b"".join(keys), np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        h = words.hashes(np.arange(n))
        if len(np.unique(h)) < n:
            raise ValueError("two vocabulary entries share a 64-bit hash")
        buckets = max(1, n // 4)
        bucket = _range(h, buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        taken, shift, slot = np.zeros(n, bool), np.zeros(buckets, np.uint64), np.zeros(n, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            own = order[edges[b] : edges[b + 1]]
            if not len(own):
                break
            base = np.uint64(0)
            while True:
                at = cls.slots(h[own][None, :], (tries + base)[:, None], n).astype(np.int64)
                good = ~taken[at].any(1)
                if len(own) > 1:
                    s = np.sort(at, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    break
                base += np.uint64(256)
            shift[b], slot[own] = tries[k] + base, at[k]
            taken[at[k]] = True
        by_slot = np.argsort(slot)
        width = int(-(-lengths.max() // 8))
        text = np.zeros((n, width), np.uint64)
        for k in range(width):
            at = np.flatnonzero(lengths > 8 * k)
            text[at, k] = words.word(k, at)
        return cls(n, shift, np.array(ids, np.int32)[by_slot], lengths[by_slot], text[by_slot], int(lengths.max()))

    def find(self, words: Words) -> np.ndarray:
        """The id of each word, or -1."""
        out = np.full(len(words.starts), -1, np.int32)
        of = np.flatnonzero((words.lengths <= self.longest) & (words.lengths > 0))
        h = words.hashes(of)
        slot = self.slots(h, self.shift[_range(h, len(self.shift)).astype(np.int64)], self.n).astype(np.int64)
        same = self.lengths[slot] == words.lengths[of]
        of, slot = of[same], slot[same]
        for k in range(self.text.shape[1]):
            at = np.flatnonzero(words.lengths[of] > 8 * k)
            if not len(at):
                break
            bad = at[self.text[slot[at], k] != words.word(k, of[at])]
            if len(bad):
                keep = np.ones(len(of), bool)
                keep[bad] = False
                of, slot = of[keep], slot[keep]
        out[of] = self.ids[slot]
        return out


def pretokens(cp: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of several texts laid end to end; ends: where each text ends."""
    n = len(cp)
    kind = table[cp]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    stop = np.append(runs[1:], n)
    # The last white space before something else is left over; a plain space then goes with what follows.
    gap = np.flatnonzero((kind[runs] == SPACE) & ~first[stop])
    last = stop[gap] - 1
    start[last] = True
    plain = last[cp[last] == 0x20] + 1
    start[plain] = False
    # A lone apostrophe without a space before it takes the letters of a contraction.
    mark = np.flatnonzero((kind[runs] == OTHER) & (cp[runs] == 0x27) & (stop - runs == 1) & start[runs] & ~first[stop])
    mark = mark[kind[stop[mark]] == LETTER]
    if len(mark):
        at, left = stop[mark], stop[mark + 1] - stop[mark]
        a, b = cp[at], np.where(left > 1, cp[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        took = one + 2 * (two & ~one)
        at, took = at[took > 0], took[took > 0]
        start[at] = False
        rest = at + took
        rest = rest[rest < n]
        start[rest] = True
    return np.flatnonzero(start)


def merge(piece: bytes, single: list[int], joins: dict[int, int], first: list[int] | None = None) -> list[int]:
    """The ids of a pre-token that is not an entry: the pair of the lowest rank is joined first, leftmost on ties.

    single: the id of each byte; joins: a << 32 | b -> the id of the two entries' concatenation; first: what joins has for
    two bytes, by a << 8 | b, -1 for none.
    """
    ids = [single[x] for x in piece]
    n, get = len(ids), joins.get
    if first is None:
        first = byte_joins(single, joins)
    # The id that each place and what follows it join to now; a place of the heap that says another one is stale.
    at = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
    at.append(-1)
    width = n.bit_length()
    low = (1 << width) - 1
    heap = [r << width | i for i, r in enumerate(at) if r >= 0]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        x = heappop(heap)
        i, r = x & low, x >> width
        if at[i] != r:
            continue
        j = after[i]
        ids[i], ids[j], at[j] = r, -1, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            q = at[i] = get(r << 32 | ids[k], -1)
            if q >= 0:
                heappush(heap, q << width | i)
        else:
            at[i] = -1
        h = before[i]
        if h >= 0:
            q = at[h] = get(ids[h] << 32 | r, -1)
            if q >= 0:
                heappush(heap, q << width | h)
    return [x for x in ids if x >= 0]


def byte_joins(single: list[int], joins: dict[int, int]) -> list[int]:
    return [joins.get(a << 32 | b, -1) for a in single for b in single]


class Memo:
    """What the merging of pre-tokens has given: known: bytes -> k; flat[edges[k]:edges[k + 1]]: the ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.edges = array("i"), array("q", [0])


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about a block each. Behind a letter and before a space a pre-token always starts, and what
    stands before it does not change how the rest is cut."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        edge = _EDGE.search(text, at + BLOCK_CHARS - 1)
        if not edge:
            break
        yield text[at : edge.start() + 1]
        at = edge.start() + 1
    yield text[at:]


@dataclass
class Tokenizer:
    """Encodes and decodes by the ranks of a vocabulary; every single byte must be an entry."""

    ranks: dict[bytes, int]
    table: np.ndarray = field(default_factory=classes, repr=False)

    def __post_init__(self) -> None:
        self.hash = PerfectHash.build(list(self.ranks), list(self.ranks.values()))
        self.entries = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([x])] for x in range(256)]
        self.joins = {}
        for entry, r in self.ranks.items():
            for k in range(1, len(entry)):
                a, b = self.ranks.get(entry[:k]), self.ranks.get(entry[k:])
                if a is not None and b is not None:
                    self.joins[a << 32 | b] = r
        self.first = byte_joins(self.single, self.joins)
        self.memo = Memo()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.memo = Memo()

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merged(self, pieces: list[bytes]) -> np.ndarray:
        """For each piece its place in the memo."""
        memo = self.memo
        if len(memo.known) > MEMO:
            memo.clear()
        out = list(map(memo.known.get, pieces))
        if None in out:
            known = memo.known
            for at in [i for i, k in enumerate(out) if k is None]:
                p = pieces[at]
                k = known.get(p)
                if k is None:
                    k = known[p] = len(memo.edges) - 1
                    memo.flat.extend(merge(p, self.single, self.joins, self.first))
                    memo.edges.append(len(memo.flat))
                out[at] = k
        return np.array(out, np.int64)

    def hash_of_entries(self) -> np.ndarray:
        keys = list(self.ranks)
        lengths = np.array([len(k) for k in keys], np.int64)
        return Words(b"".join(keys), np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths).hashes(np.arange(len(keys)))

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        data = "".join(texts)
        cp = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(cp):
            return [np.zeros(0, np.int32) for _ in texts]
        at = pretokens(cp, ends, self.table)
        raw = data.encode("utf-8")
        if len(raw) == len(cp):
            place = at
        else:
            width = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
            place = np.concatenate(([0], np.cumsum(width)))[at]
        lengths = np.diff(np.append(place, len(raw)))
        ids = self.hash.find(Words(raw, place, lengths))
        miss = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        if len(miss):
            a = place[miss]
            memo = self._merged([raw[i:j] for i, j in zip(a.tolist(), (a + lengths[miss]).tolist(), strict=True)])
            edges = np.array(self.memo.edges)
            counts[miss] = edges[memo + 1] - edges[memo]
        to = np.concatenate(([0], np.cumsum(counts)))
        out = np.repeat(ids, counts)
        if len(miss):
            n = counts[miss]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[miss], n) + step] = np.array(self.memo.flat)[np.repeat(edges[memo], n) + step]
        return np.split(out, to[np.searchsorted(at, ends[:-1])])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a text longer than a block is cut where no pre-token can reach across."""
        block: list[str] = []
        size = 0
        for t in texts:
            if len(t) > BLOCK_CHARS:
                yield from self.encode_block(block) if block else ()
                block, size = [], 0
                yield np.concatenate([self.encode_block([x])[0] for x in parts(t)])
                continue
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, size = [], 0
        if block:
            yield from self.encode_block(block)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def _loaded(path: str) -> Tokenizer:
    """The driver's one copy of a vocabulary, however often a query is built."""
    return Tokenizer.load(path)


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, (ids array<int> if with_ids,) n_tokens, ids_sha256, decoded_sha256.

    path: a rank file on the driver, sent to the tasks. Null and empty texts have no tokens; the digests are then
    those of the empty string. Repeated rows and null ids come back as they are; an empty table gives an empty
    result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_loaded(path))  # as large as the vocabulary, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = sent.value  # a worker process keeps it from task to task, but not what it remembers
        entries = [tok.entries.get(v, b"") for v in range(max(tok.entries) + 1)]
        words = [b"%d" % v for v in range(len(entries))]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, ids_sha, text_sha, kept = [], [], [], [np.zeros(0, np.int32)]
                for ids in tok.encode([t or "" for t in batch.column(1).to_pylist()]):
                    each = ids.tolist()
                    n.append(len(each))
                    ids_sha.append(hashlib.sha256(b" ".join(map(words.__getitem__, each))).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(entries.__getitem__, each))).hexdigest())
                    kept += [ids] if with_ids else []
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(kept), pa.int32()))] if with_ids else []
                arrays = [batch.column(0), *lists, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id"] + ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"])
        tok.memo.clear()
        trimmed()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, " + "ids array<int>, " * with_ids + SCHEMA)
