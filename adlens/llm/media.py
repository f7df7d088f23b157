"""Media columns: signature sniffing, structure validation, declared types corrected, embedded media carved.

An Aho-Corasick automaton finds the magic bytes of every known format in one pass over the stored bytes; a
validator for each format then reads its structure and gives its length, so that a magic alone decides nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import free_name

BLOCK = 576
PAD = b"\xff"
RATE = 8000


@dataclass(frozen=True)
class Found:
    """A confirmed piece of media: its type, where it lies in the bytes, and the span of its payload."""

    kind: str
    start: int
    length: int
    payload: tuple[int, int] | None = None


class Data(bytes):
    """Bytes in which the next place of a mark is remembered, so that asking at rising places reads them once."""

    def after(self, mark: bytes, at: int) -> int:
        places = self.__dict__.setdefault("places", {})
        asked, found = places.get(mark, (0, 0))
        if mark not in places or not (asked <= at and (found < 0 or at <= found)):
            found = self.find(mark, at)
            places[mark] = (at, found)
        return found


def _wav(b: Data, at: int) -> Found | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    k, fmt, data = at + 12, False, None
    while k + 8 <= min(end, len(b)):
        name, n = struct.unpack_from("<4sI", b, k)
        fmt |= name == b"fmt " and n >= 16
        if name == b"data":
            data = (k + 8, k + 8 + n)
        k += 8 + n + n % 2
    return Found("audio/wav", at, end - at, data) if fmt and data and data[1] <= end <= len(b) and k >= end else None


def _png(b: Data, at: int) -> Found | None:
    k = at + 8
    while k + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, k)
        if k + 12 + n > len(b) or zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return None
        k += 12 + n
        if name == b"IEND":
            return Found("image/png", at, k - at)
    return None


def _gif(b: Data, at: int) -> Found | None:
    if len(b) < at + 13:
        return None
    k = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while k < len(b):
        tag = b[k]
        if tag == 0x3B:
            return Found("image/gif", at, k + 1 - at)
        if tag == 0x21:
            k += 2
        elif tag == 0x2C and k + 10 <= len(b):
            k += 11 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 0x80 else 0)
        else:
            return None
        while k < len(b) and b[k]:
            k += b[k] + 1
        k += 1
    return None


def _jpeg(b: Data, at: int) -> Found | None:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        mark = b[k + 1]
        if mark == 0xDA:
            end = b.after(b"\xff\xd9", k)
            return Found("image/jpeg", at, end + 2 - at) if end >= 0 else None
        if mark in (0x00, 0x01, 0xFF) or 0xD0 <= mark <= 0xD9:
            return None
        k += 2 + struct.unpack_from(">H", b, k + 2)[0]
    return None


def _bmp(b: Data, at: int) -> Found | None:
    if len(b) < at + 30:
        return None
    size, gap, data, head = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return Found("image/bmp", at, size, (at + data, at + size)) if not gap and head in (12, 40, 52, 56, 108, 124) and planes == 1 and 26 <= data <= size <= len(b) - at else None


def _pdf(b: Data, at: int) -> Found | None:
    end, table = b.after(b"%%EOF", at), b.after(b"startxref", at)
    return Found("application/pdf", at, end + 5 - at) if 0 <= table <= end - 9 else None


def _gzip(b: Data, at: int) -> Found | None:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    unzip = zlib.decompressobj(31)
    try:
        k = at
        while k < len(b) and not unzip.eof:  # in pieces, and what comes out is not kept
            unzip.decompress(unzip.unconsumed_tail or b[k : k + 65536], 1 << 20)
            k += 0 if unzip.unconsumed_tail else 65536
    except zlib.error:
        return None
    return Found("application/gzip", at, min(k, len(b)) - len(unzip.unused_data) - at) if unzip.eof else None


def _zip(b: Data, at: int) -> Found | None:
    end = b.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    return Found("application/zip", at, end + 22 + note - at) if at + offset + size == end and b[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(b) else None


def _flac(b: Data, at: int) -> Found | None:
    k, first = at + 4, True
    while k + 4 <= len(b):
        kind, n = b[k], int.from_bytes(b[k + 1 : k + 4], "big")
        if first and (kind & 0x7F or n != 34):
            return None
        k, first = k + 4 + n, False
        if kind & 0x80:
            return Found("audio/flac", at, len(b) - at) if k + 2 <= len(b) and b[k] == 0xFF and b[k + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(b: Data, at: int) -> Found | None:
    k = at
    while k + 27 <= len(b) and b[k : k + 5] == b"OggS\x00":
        segments = b[k + 26]
        k += 27 + segments + sum(b[k + 27 : k + 27 + segments])
        if k > len(b):
            return None
    return Found("audio/ogg", at, k - at) if k > at else None


def _midi(b: Data, at: int) -> Found | None:
    if len(b) < at + 14 or struct.unpack_from(">I", b, at + 4)[0] != 6:
        return None
    k = at + 14
    for _ in range(struct.unpack_from(">H", b, at + 10)[0]):
        if b[k : k + 4] != b"MTrk" or k + 8 > len(b):
            return None
        k += 8 + struct.unpack_from(">I", b, k + 4)[0]
    return Found("audio/midi", at, k - at) if k <= len(b) else None


def _mp4(b: Data, magic: int) -> Found | None:
    at = k = magic - 4
    seen = set()
    while at >= 0 and k + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, k)
        if n < 8 or k + n > len(b) or not name.isalnum():
            break
        seen.add(name)
        k += n
    return Found("video/mp4", at, k - at) if {b"ftyp", b"moov"} <= seen else None


FORMATS: dict[bytes, Callable[[Data, int], Found | None]] = {
    b"RIFF": _wav, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg, b"BM": _bmp, b"%PDF-": _pdf,
    b"\x1f\x8b\x08": _gzip, b"PK\x03\x04": _zip, b"fLaC": _flac, b"OggS": _ogg, b"MThd": _midi, b"ftyp": _mp4,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes, magics: ahocorasick.Automaton) -> list[Found]:
    """Confirmed media in data, outermost first by place; what starts inside a sibling is carved from it as well,
    but a second piece that only overlaps the end of one is not reported."""
    found: list[Found] = []
    around: list[Found] = []  # what is still open at a place, the first to end last
    data = Data(data)
    for last, magic in magics.iter(data.decode("latin-1")):
        x = FORMATS[magic](data, last - len(magic) + 1)
        if x is None:
            continue
        end = x.start + x.length
        while around and around[-1].start + around[-1].length <= x.start:
            around.pop()
        innermost = next((y for y in reversed(around) if y.start < x.start), None)
        if innermost is None or innermost.start + innermost.length >= end:
            found.append(x)
            k = len(around)
            while k and around[k - 1].start + around[k - 1].length < end:
                k -= 1
            around.insert(k, x)
    return sorted(found, key=lambda x: (x.start, -x.length))


def correct(declared: str | None, found: list[Found], size: int) -> str:
    """The true type: that of media which fills the bytes; else text or bytes, as declared if nothing speaks against it."""
    whole = next((x.kind for x in found if x.start == 0 and x.length == size), None)
    return whole or (declared if declared and not declared.startswith(("image/", "audio/", "video/")) else "application/octet-stream")


CARVED = "media_type string, carved array<struct<kind: string, start: long, length: long, body: binary>>"


def sniffed(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """df, which has a binary column of media and a string column of their declared types, with the true media_type and
    carved put in: the confirmed media inside each value, with their bytes, in order of place, the value itself left out.

    A null value keeps its declared type and has nothing carved; an empty one has no media. Equal rows get equal answers,
    an empty table gives an empty result. All other columns are kept; columns of those two names are replaced.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        magics = automaton()
        for media, declared in batches:
            types, carved = [], []
            for value, said in zip(media, declared.to_pylist(), strict=True):
                data = value.as_py()
                found = sniff(data, magics) if data else []
                types.append(said if data is None else correct(said, found, len(data)))
                inside = [x for x in found if x.start or x.length != len(data)]
                carved.append([{"kind": x.kind, "start": x.start, "length": x.length, "body": data[x.start : x.start + x.length]} for x in inside])
            yield pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(carved, pa.list_(kind))], ["media_type", "carved"])

    df = df.drop("media_type", "carved")
    name = free_name(df, "sniffed")
    found = F.arrow_udf(run, CARVED)(F.col(media_col).cast("binary"), F.col(declared_col).cast("string"))
    return df.withColumn(name, found).select(*df.columns, f"{name}.media_type", f"{name}.carved")


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)


def store(payload: bytes) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload."""
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def features(kind: str, samples: np.ndarray, inside: list[Found]) -> str:
    """Type, duration, mean level, energy, sign changes, peak and the carved media of a stored recording."""
    x = samples.astype(np.int64) - 128
    turns = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    carved = ",".join(f"{f.kind}@{f.start}+{f.length}" for f in inside) or "none"
    return f"type={kind};samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns};peak={int(np.abs(x).max())};carved={carved}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string"


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Each text stored as a recording, found again by its signature, checked, carved and read back.

    One row per row of docs, repeated rows and null ids included. A null text counts as empty; the payload is then
    one block of padding. Equal texts give equal values. An empty table gives an empty result; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magics = automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                media = store(payload_of(raw))
                found = sniff(media, magics)
                whole = next(x for x in found if x.start == 0 and x.payload)
                back = media[slice(*whole.payload)]
                kind = correct(declared, found, len(media))
                rows.append(
                    (
                        doc_id, len((raw or "").encode("utf-8", "replace")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(),
                        features(kind, np.frombuffer(back, np.uint8), [x for x in found if x is not whole]), declared, kind,
                    )
                )
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
