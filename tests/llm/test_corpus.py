"""Operators over whole corpora against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from adlens.llm import bpe, langid, lines, mixing, neighbours, simhash, suffix
from adlens.llm.components import components


class Sets:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, i):
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, a, b):
        self.of[self.find(a)] = self.find(b)


def none_last(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    s = Sets(200)
    for a, b in links:
        if a is not None:
            s.join(a, b)
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    least = {}
    for x in nodes:
        least[s.find(x)] = min(least.get(s.find(x), x), x)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
    assert got == {x: least[s.find(x)] for x in nodes}
    assert components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_simhash(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(60)]
    long = rng.choices(words, k=400)
    for _ in range(20):
        x = list(long)
        x[rng.randrange(400)] = "CHANGED"
        texts.append("  ".join(x))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[5]), (900, None), (901, " \n ")]

    def plain(t):
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0

    f = [plain(t) for _, t in rows]
    s = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if bin(f[i] ^ f[j]).count("1") <= 2:
                s.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[s.find(i)] = min(least.get(s.find(i), d), d)
    want = none_last((d, f"{f[i]:016x}", least[s.find(i)]) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    assert none_last((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1500, 3])
def test_suffix(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 20_000)
    rng, length = random.Random(3), 100
    pieces = ["the", "ing é", "a", "zuch", "ha", "re"]

    def text(n):
        return " ".join(rng.choice(pieces) + rng.choice("abcdefgh") for _ in range(n))

    shared = [text(60) for _ in range(5)]
    docs = [(i, " ".join([text(rng.randint(0, 40)), *[p[rng.randint(0, 60) :][: rng.randint(20, 300)] + text(3) for p in rng.choices(shared, k=rng.randint(0, 3))]])) for i in range(60)]
    docs += [(500, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (600, None), (601, ""), (602, "ab" * 200), (603, "x" * 300), (604, text(30) + "x" * 150)]
    near = text(150)
    docs += [(700 + i, near[: 7 * i] + "#" + near[7 * i + 1 :]) for i in range(20)]
    seen = collections.Counter(b[i : i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    want = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, spans string")
    got = [tuple(r) for r in suffix.strip(df, length=length).collect()]
    assert none_last(got) == none_last(want) and sum(w[2] for w in want)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        pairs.append((a, "".join(b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", *[lines.within(F.col("a"), F.col("b"), e).alias(f"e{e}") for e in (1, 2)]).collect():
        assert (r.e1, r.e2) == (distance(r.a, r.b) <= 1, distance(r.a, r.b) <= 2), r


@pytest.mark.parametrize(("edits", "hot"), [(1, 2500), (1, 3), (2, 2500)])
def test_lines(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(5)

    def change(x):
        i, r = rng.randrange(len(x)), rng.random()
        return x[:i] + (rng.choice("abc") + x[i + 1 :] if r < 0.5 else x[i + 1 :] if r < 0.75 else "z" + x[i:])

    pool = ["".join(rng.choices("abcdefgh ", k=rng.randint(20, 50))) for _ in range(25)]
    docs = []
    for i in range(50):
        own = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(pool)
            for _ in range(rng.randint(0, 3)):
                x = change(x)
            own.append(x)
        docs.append((i, "\n".join([*own, change(pool[0]), "short"])))
    docs += [(None, None), (200, ""), (7, docs[7][1]), (None, docs[3][1])]
    df = spark.createDataFrame([(a, b, 5) for a, b in docs], "doc_id long, text string, n_lines int")
    hashes = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    at = [((-1 if i is None else i, hashes[i, t], k), x) for i, t in set(docs) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    names = sorted({x for _, x in at})
    s, place = Sets(len(names)), {x: k for k, x in enumerate(names)}
    for i, a in enumerate(names):
        for j in range(i):
            if min(len(a), len(names[j])) >= lines.MIN_CHARS and abs(len(a) - len(names[j])) <= edits and distance(a, names[j]) <= edits:
                s.join(i, j)
    first = {}
    for k, x in at:
        first[s.find(place[x])] = min(first.get(s.find(place[x]), k), k)
    gone = {k for k, x in at if first[s.find(place[x])] != k}
    want = []
    for i, t in docs:
        own = (t or "").split("\n")
        left = [x for k, x in enumerate(own) if (-1 if i is None else i, hashes[i, t], k) not in gone]
        want.append((i, None if t is None else "\n".join(left), 0 if t is None else len(own), len(own) - len(left)))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(df, max_edits=edits).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and gone


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 8))
    rows = [(i, (base[rng.integers(20)] + rng.standard_normal(8) * 0.25 * rng.random()).tolist(), int(rng.integers(3))) for i in range(200)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [None] + [1.0] * 7, 1), (1003, [float("nan")] * 8, 1), (1004, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2]), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [], 1)]
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(15)]
    s, n = Sets(len(rows)), [0] * len(rows)
    good = [r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[i] += 1
                    s.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[s.find(i)] = min(least.get(s.find(i), r[0]), r[0])
    want = none_last((r[0], n[i], least.get(s.find(i))) for i, r in enumerate(rows))
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert none_last((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_targets_and_flow():
    assert mixing.targets([10, 100, 1000], [5, 2, 1], 1110.0) == [30.0, 300.0, 780.0]
    assert mixing.targets([], [], 0.0) == []
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randint(1, 4)
        patterns = [(tuple(sorted(rng.sample(range(n), rng.randint(1, n)))), rng.randint(0, 50)) for _ in range(rng.randint(1, 6))]
        want = [rng.randint(0, 80) for _ in range(n)]
        given = mixing.flow(patterns, want)
        assert all(0 <= g <= 3 * c for g, (_, c) in zip(given, patterns, strict=True))
        # The largest flow is the smallest cut over sets of sources, and cheaper copies are used up first.
        for copies in (1, 2, 3):
            best = min(sum(copies * c for p, c in patterns if set(p) & set(x)) + sum(w for k, w in enumerate(want) if k not in x) for m in range(1 << n) for x in [[k for k in range(n) if m >> k & 1]])
            assert sum(min(g, copies * c) for g, (_, c) in zip(given, patterns, strict=True)) == best


def test_mix(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", None])) for i in range(300)] + [(None, None, "c"), (5, "w w", "c"), (5, "w w", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, F.array("source")).collect()
    assert len(rows) == len(docs) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    for p in {r.pattern[0] for r in rows}:
        own = [r for r in rows if r.pattern[0] == p]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 and own[0].source_size == sum(r.size for r in own)
    again = mixing.mix(df.repartition(7), F.array("source")).collect()
    assert sorted((r.id or -1, r.size, r.taken) for r in rows) == sorted((r.id or -1, r.size, r.taken) for r in again)
    assert mixing.mix(df.limit(0), F.array("source")).count() == 0
    # Cutting the buckets at a cut by further bits of the hash changes nothing.
    few, mixing.FEW = mixing.FEW, 0
    finer = mixing.mix(df.union(df.limit(0)), F.array("source")).collect()
    mixing.FEW = few
    assert sorted((r.id or -1, r.size, r.taken) for r in rows) == sorted((r.id or -1, r.size, r.taken) for r in finer)


def test_bpe_matches_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    tok = bpe.Tokenizer.load(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})
    rng = random.Random(9)
    letters = list(" \n\t'stredlvmabcéñ漢😀1٣½.,!- 　\x1c\x1f\x85́ـ")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)] + ["we'll they've 'S don't", "a" * 5000, " " * 300, "<|endoftext|>"]
    got = list(tok.encode(texts))
    assert [g.tolist() for g in got] == [enc.encode_ordinary(t) for t in texts]
    assert all(tok.decode(g) == t.encode() for g, t in zip(got, texts, strict=True))
    slots = sorted(tok.hash.slots(tok.hash_of_entries(), tok.hash.shift[bpe._range(tok.hash_of_entries(), len(tok.hash.shift)).astype(int)], tok.hash.n).tolist())
    assert slots == list(range(len(tok.ranks)))  # perfect and minimal
    rows = bpe.encoded(spark.createDataFrame([(1, None), (None, "héllo wörld"), (1, "")], "doc_id long, text string"), path, with_ids=True).collect()
    assert [r.n_tokens for r in rows] == [0, len(enc.encode_ordinary("héllo wörld")), 0] and rows[1].ids == enc.encode_ordinary("héllo wörld")
    assert rows[1].decoded_sha256 == hashlib.sha256("héllo wörld".encode()).hexdigest()


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.predict(docs.union(spark.createDataFrame([(9001, None, "en"), (9002, "12 ..!", "en"), (None, "the and that", "en")], "doc_id long, text string, lang string"))).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in rows}
    assert by[9001].lang_pred == by[9002].lang_pred == "und" and by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(docs.limit(0)).count() == 0
