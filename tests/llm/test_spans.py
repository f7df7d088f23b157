"""PII and licenses against plain Python on hard texts; media round trips and carving."""

import hashlib
import re
import struct
import zlib

from adlens.llm import licenses, media, pii

TEXTS = [
    "mail a@b.c@d.e and x_y@z.co.uk, a@b.c_x@d.e ip 1.2.3.4.5.6.7.8 300.1.1.1 007.1.2.3", "card 4111 1111 1111 1111 1 and 4111-1111-1111-1111 +49 (30) 1234567-89 x", None, "",
    "é😀 +1 555 123 4567 a@b.co IBAN GB82 WEST 1234 5698 7654 32 ok", "1 " * 20000, "Licensed under the Apache License, Version 2.0. MIT License CC BY 4.0 cc-by-sa GNU General Public License",
    "The  GNU\nGeneral PUBLIC license; ccé by, cc... BY mit LICENSE mit license", 'ssn 123-45-6789 token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "a@b.cc " * 700,
]


def frame(spark, texts=TEXTS):
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(None, texts[0], None), (0, texts[0], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_email string")


def base(text):
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, (kind, rule) in enumerate(zip(("email", "ip", "card", "phone"), rules, strict=True)):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {0: True, 1: all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else False, 2: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, 3: 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_pii_base_spans(spark):
    rows = pii.report(frame(spark)).collect()
    texts = [r.text for r in frame(spark).collect()]
    assert [r.base_sha256 for r in rows] == [hashlib.sha256(base(t).encode()).hexdigest() for t in texts]
    assert "iban:31:58" in rows[4].spans and "secret:16:65" in rows[8].spans
    assert rows[9].n_email == 700 and rows[2].spans == "" and rows[2].max_score is None


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_license_base(spark):
    rows = licenses.scan(frame(spark)).collect()
    for r, text in zip(rows, [x.text for x in frame(spark).collect()], strict=True):
        w, places, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_rules_and_suppression(spark):
    assert len(licenses.rules()) > 200
    texts = ["SPDX-License-Identifier: MPL-2.0", "under the GNU Affero General Public License", "https://creativecommons.org/licenses/by-nc/4.0", "nothing here"]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].labels == "mpl" and rows[0].score == 0.99
    assert rows[1].labels == "agpl" and rows[1].base_labels == ""
    assert "cc-by-nc" in rows[2].labels and rows[3].labels == ""
    named = {
        "License: BSD-3-Clause": "bsd-3-clause", "Released under GPL-3.0-only.": "gpl", "dual licensed MIT/Apache-2.0": "apache,mit", "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache,mit", "SPDX-License-Identifier: (LGPL-2.1-or-later AND Zlib)": "lgpl,zlib",
        "license = 'ISC'": "", "licensed as ISC, or WTFPL": "isc,wtfpl", "The licence gives it to Ruby, mit Dank": "", "license: mitten": "", "license: MIT-0": "mit", "a license" + " x" * 200_000 + " License: ISC": "isc",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(named)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(named.values()))


def test_context_on_either_side(spark):
    texts = ["192.0.2.1 is my server ip", "the server ip is 192.0.2.1", "192.0.2.1 stands alone", "123-45-6789 is my social security number", "123-45-6789 is a number", "x" * 60 + " 192.0.2.1 " + "y" * 60 + " server"]
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k].max_score for k in (0, 1, 2, 5)] == [1.0, 1.0, 0.7, 0.7]
    assert rows[3].spans == "ssn:0:11" and rows[4].spans == ""


def test_media_round_trip(spark):
    rows = media.stored_media(frame(spark)).collect()
    for r, text in zip(rows, [x.text for x in frame(spark).collect()], strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.store(payload)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_type == "audio/wav"
    assert rows[0].feature == rows[-1].feature


def png():
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_carving():
    import gzip

    magics, image = media.automaton(), png()
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    data = b"junk BM RIFF" + image + b"--" + gif + gzip.compress(b"x" * 99) + media.store(b"\x80" * 576)
    kinds = [(f.kind, data[f.start : f.start + f.length]) for f in media.sniff(data, magics)]
    assert [k for k, _ in kinds] == ["image/png", "image/gif", "application/gzip", "audio/wav"] and kinds[0][1] == image and kinds[1][1] == gif
    broken = bytearray(image)
    broken[20] ^= 1
    assert media.sniff(bytes(broken), magics) == [] and media.sniff(image[:-3], magics) == []
    assert media.correct("image/png", media.sniff(gif, magics), len(gif)) == "image/gif" and media.correct("image/png", [], 9) == "application/octet-stream"


def test_sniffed_column(spark):
    image, sound = png(), media.store(b"\x80" * 576)
    rows = [(1, image, "audio/wav", "x"), (2, b"--" + image + sound, "image/png", "x"), (3, None, "image/gif", None), (4, b"", None, "x"), (5, b"plain", "text/plain", "x"), (5, b"plain", "text/plain", "x"), (6, sound, None, "x")]
    schema = "id long, media binary, declared string, sniffed string"
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.id, r.media_type, [(c.kind, bytes(c.body)) for c in r.carved]) for r in media.sniffed(df).collect())
    other, text = "application/octet-stream", (5, "text/plain", [])
    assert got == [(1, "image/png", []), (2, other, [("image/png", image), ("audio/wav", sound)]), (3, "image/gif", []), (4, other, []), text, text, (6, "audio/wav", [])]
    assert media.sniffed(df).columns == [*df.columns, "media_type", "carved"] and media.sniffed(spark.createDataFrame([], schema)).count() == 0


def test_many_magics_are_read_once():
    magics = media.automaton()
    assert media.sniff(b"%PDF-" * 200_000 + b"PK\x03\x04" * 100_000, magics) == []
    body = b"%PDF-1.4 a %PDF-1.4 startxref 9 %%EOF %PDF-1.4 %%EOF"
    assert [(f.start, f.length) for f in media.sniff(body, magics)] == [(0, 37), (11, 26)]
