"""Hierarchical packing of documents into sequences of several lengths, without padding.

A task tokenizes its documents and packs them as they come, window by window, so that no ids are shuffled and any task can
be run again by itself. Whole stretches of the longest length stand alone. What is left of a document goes to the shortest
tier that holds it. Tiers are packed from the longest on: each sequence opens with the longest piece left, its gap takes
the longest shorter pieces that fit, and the last filler is cut. Where nothing is left to fill with, the open sequence is
split at powers of two. Sequences of one length are dealt to step groups so that these cost about the same.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from adlens.llm.common import trimmed

LENGTH = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids that are packed together; a window ends behind the document that reaches it.
WINDOW_IDS = 4_000_000
#: Sequences of a step group.
GROUP = 8
#: Words that a worker remembers, in each of two generations.
MEMO_WORDS = 400_000
#: Longer texts are tokenized in parts, cut at a space.
PART_CHARS = 2_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


#: A full stop or a comma behind a letter and before a space is a token of its own; set apart, it leaves fewer different words.
#: The patterns begin with the mark, so that only marks are looked at.
_STOP, _COMMA = re.compile(r"\. (?<=[A-Za-z]\. )"), re.compile(r", (?<=[A-Za-z], )")
#: Latin-1 letters and then ASCII marks: the splitter parts the two, unless an apostrophe is among the marks.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


#: How byte-level vocabularies show the bytes that have no printable character of their own in Latin-1.
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _stored(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """The ids of space-separated words, as bytes. No token crosses white space, so a text's ids are those of its words."""

    @staticmethod
    def of(text: str) -> list[str]:
        return _COMMA.sub(" , ", _STOP.sub(" . ", text.replace("\n", " "))).split(" ")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._coded(word)
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _coded(self, word: str) -> bytes:
        # A word of Latin-1 letters is composed, has a plain lower case and is one token of the splitter: only the merges are left.
        if word.isalpha() and (word.isascii() or max(word) <= "ÿ"):
            low = word.lower()
            if low != word and (ids := self.get(low)) is not None:
                return ids
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(_SHOWN)
            return _stored([t.id for t in self.model.tokenize(shown)])
        if marked := _MARKED.fullmatch(word):
            return self[marked[1]] + self[marked[2]]
        return _stored(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def parts(text: str) -> Iterator[str]:
    """text in parts of about PART_CHARS, cut at spaces; one without a space stays whole."""
    at = 0
    while len(text) - at > PART_CHARS:
        end = text.find(" ", at + PART_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Pool:
    """Pieces by length, with the longest piece up to a length found from a bit mask."""

    def __init__(self) -> None:
        self.of: list[list[tuple[int, int]]] = [[] for _ in range(LENGTH)]
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.of[length].append((doc, start))
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        doc, start = self.of[length].pop()
        if not self.of[length]:
            self.mask &= ~(1 << length)
        return doc, start

    def longest(self, most: int) -> int:
        """The length of the longest piece of at most `most`, or 0."""
        return max((self.mask & ((2 << most) - 1)).bit_length() - 1, 0)

    def shortest_above(self, least: int) -> int:
        """The length of the shortest piece of more than `least`, or 0."""
        rest = self.mask >> (least + 1)
        return least + 1 + (rest & -rest).bit_length() - 1 if rest else 0


def pack(lengths: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """lengths of documents -> sequences (length, pieces (document, start, length)), each as long as a power of two."""
    pool = Pool()
    for doc, n in enumerate(lengths):
        whole = n // LENGTH * LENGTH
        for start in range(0, whole, LENGTH):
            yield LENGTH, [(doc, start, LENGTH)]
        if n > whole:
            pool.put(doc, whole, n - whole)
    while pool.mask:
        length = pool.longest(LENGTH - 1)
        tier = next(t for t in TIERS if t >= length)
        pieces, gap = [(*pool.take(length), length)], tier - length
        while gap and pool.mask:
            length = pool.longest(gap)
            if length:
                pieces.append((*pool.take(length), length))
            else:  # all that is left is longer: the shortest is cut, and its rest goes back
                rest = pool.shortest_above(gap)
                doc, start = pool.take(rest)
                length = gap
                pieces.append((doc, start, gap))
                pool.put(doc, start + gap, rest - gap)
            gap -= length
        if not gap:
            yield tier, pieces
        else:
            yield from _split(pieces)


def _split(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces of an open sequence as sequences of the powers of two that make up their length."""
    total = sum(n for _, _, n in pieces)
    left = list(reversed(pieces))
    while total:
        length = 1 << (total.bit_length() - 1)
        total -= length
        own, room = [], length
        while room:
            doc, start, n = left.pop()
            own.append((doc, start, min(n, room)))
            if n > room:
                left.append((doc, start + room, n - room))
            room -= own[-1][2]
        yield length, own


def grouped(sequences: list[tuple[int, list]]) -> list[int]:
    """A step group for each sequence: groups hold GROUP sequences of one length, dealt back and forth by falling cost (the
    attention over their pieces), so that the groups of a length cost about the same."""
    cost = [sum(n * n for _, _, n in pieces) for _, pieces in sequences]
    groups, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        own = sorted((k for k, (t, _) in enumerate(sequences) if t == tier), key=lambda k: -cost[k])
        n = -(-len(own) // GROUP)
        for place, k in enumerate(own):
            turn, at = divmod(place, n)
            groups[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def _packed(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words = _words(path)
    base, groups = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32
    ids: list[np.ndarray] = []
    names: list[int | None] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal base, groups
        sequences = list(pack([len(x) for x in ids]))
        steps = grouped(sequences)
        rows = []
        for k, (tier, pieces) in enumerate(sequences):
            offset = 0
            for doc, start, n in pieces:
                rows.append((names[doc], start, n, zlib.crc32(ids[doc][start : start + n]), len(ids[doc]), base + k, offset, tier, groups + steps[k]))
                offset += n
        base, groups = base + len(sequences), groups + max(steps, default=-1) + 1
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 20_000], strict=True)], schema=schema)
        ids.clear()
        names.clear()

    held = 0
    for batch in batches:
        doc_ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 500):
            found = [x or "" for x in texts.slice(at, 500).to_pylist()]
            for name, text in zip(doc_ids.slice(at, 500).to_pylist(), found, strict=True):
                coded = b"".join(words.encode(words.of(p)) for p in parts(text))
                ids.append(np.frombuffer(coded + END_ID.to_bytes(4, "little"), "<u4"))
                names.append(name)
                held += len(ids[-1])
                if held >= WINDOW_IDS:
                    yield from flush()
                    held = 0
    yield from flush()
    trimmed()


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> one row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier (the sequence's length) and step_group.

    tokenizer is the path of a `tokenizers` file whose tokens do not cross white space. Every document ends in END_ID; null
    and empty texts are that id alone. Strings of special tokens are ordinary text. Repeated rows and rows without an id are
    packed like any others; an empty table gives no pieces. Sequence and group numbers are unique, with gaps, and hang on how the input is
    partitioned; the pieces of a document cover its ids once in any case. Every sequence is as long as a power of two.
    """
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _packed(batches, tokenizer, schema), PIECES)
