"""The transaction log, packing and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from adlens.llm import packing, prefixtrie, scans, translog


def test_scans(spark, monkeypatch):
    monkeypatch.setattr(scans, "FAN", 3)
    rng = random.Random(1)
    rows = [(k, b, rng.choice([None, b * 10 + k]), rng.randrange(9), rng.randrange(99)) for k in range(3) for b in range(40) if rng.random() < 0.7]
    got = scans.carried(spark.createDataFrame(rows, "k long, b long, v long, s long, x long"), ["k"], "b", {"v": "last", "s": "sum", "x": "xor"}, 40).collect()
    assert len(got) == len(rows)
    for r in got:
        before = sorted(x for x in rows if x[0] == r.k and x[1] < r.b)
        held = [x[2] for x in before if x[2] is not None]
        xor = 0
        for x in before:
            xor ^= x[4]
        assert r.before_v == (held[-1] if held else None)
        assert (r.before_s or 0) == sum(x[3] for x in before) and (r.before_x or 0) == xor


def replayed(log, commits):
    """log: (id, source, kind, key, value) in order -> rows of the contract's kind, with the store after every epoch."""
    live, marks, store, out, stores, n = defaultdict(list), {}, {}, [], [], 0
    for i, source, kind, key, value in log:
        if kind == "change":
            live[source].append((i, key, value))
        elif kind == "savepoint":
            marks[source] = len(live[source])
        elif kind == "rollback":
            at = marks.get(source, 0)
            out += [("rollback", c[0], i, c[1]) for c in live[source][at:]]
            del live[source][at:]
        else:
            if kind == "abort":
                out += [("abort", c[0], i, c[1]) for c in live[source]]
            else:
                for _, k, v in live[source]:
                    store.pop(k, None) if v is None else store.update({k: v})
                n += 1
                if n % commits == 0:
                    stores.append(dict(store))
            live[source], marks[source] = [], 0
    out += [("abort", c[0], None, c[1]) for own in live.values() for c in own]
    if n % commits:
        stores.append(dict(store))
    return out, stores


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize(("fan", "per"), [(1024, 32), (2, 1)])
def test_log(spark, monkeypatch, fan, per):
    monkeypatch.setattr(scans, "FAN", fan)
    monkeypatch.setattr(translog, "EPOCHS_PER_BLOCK", per)
    monkeypatch.setattr(scans, "ROWS_PER_BLOCK", 60)
    rng = random.Random(2)
    kinds = ["commit", "abort", "savepoint", "savepoint", "rollback", *["change"] * 8]
    log = [(i * 3, rng.choice(["a", "a", "a", "b", None, ""]), rng.choice(kinds), rng.randrange(12), rng.choice([None, 5, 6, i])) for i in range(900)]
    log += [(5000 + i, "slow", "change", i % 5, i) for i in range(40)] + [(6000, "slow", "commit", None, None), (6001, "late", "change", None, 7), (6002, "late", "change", 1, 7)]
    want, stores = replayed(log, 4)
    rows = log + [(None, "a", "commit", 1, 1), (7, "a", None, 1, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, source string, kind string, key long, value long, block string")
    found = translog.reassemble(df, len(rows), 4)
    assert ordered((r.why, r.id, r.by, r.key) for r in found.undone.collect()) == ordered(want)
    got = {r.epoch: (r.n, r.total) for r in translog.replay(found, "value * 2").collect()}
    assert got == {k + 1: (len(s), 2 * sum(s.values())) for k, s in enumerate(stores)} and len(got) > 10
    for epoch in (1, len(stores) // 2, len(stores)):
        assert {r.key: r.value for r in translog.store_after(found, epoch).collect()} == stores[epoch - 1]


def test_log_edges(spark):
    schema = "doc_id long, text string, source string, kind string"
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    empty = translog.reassemble(translog.log_of(spark.createDataFrame([], schema), labels), 0)
    assert empty.undone.count() == 0 and translog.replay(empty).count() == 0
    docs = [(i, f"t{i}", None if i % 3 else "s", "k") for i in range(200)] + [(None, "x", "s", "k"), (7, "t7", "s", "k"), (7, "t7", "s", "k"), (900, None, None, None), (901, "", "s", "k"), (902, "w " * 400_000, None, "k")]
    rows = []
    for i, text, source, _ in sorted((d for d in docs if d[0] is not None), key=lambda d: (d[0], d[2] or "", d[1] or "")):
        h = zlib.crc32(str(i).encode())
        kind = ["commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback"][h % 41] if h % 41 < 7 else "change"
        key = h // 100 % 3000
        rows.append((i, source, kind, key, None if text is None or i == 3 else zlib.crc32(f"{key}:{text}".encode())))
    want, stores = replayed(rows, 16)
    found = translog.reassemble(translog.log_of(spark.createDataFrame(docs, schema), labels), len(docs))
    assert ordered((r.why, r.id, r.by, r.key) for r in found.undone.collect()) == ordered(want)
    assert {r.epoch: (r.n, r.total) for r in translog.replay(found).collect()} == {k + 1: (len(s), sum(s.values())) for k, s in enumerate(stores)}


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, t


def test_packing(spark, monkeypatch):
    path, t = tokenizer()
    rng = random.Random(3)
    words = ["plain", "Words", "don't", "é", "12", "...", "naïve,", " x", "á", "İ", "ΣΑΣ", "\x1c", "<|endoftext|>", "\n", "\t", "", "日本", "end.", "end..", "it's,", "a.b", "é,", "x.,"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([3, 40, 300, 2500, 9000]))), 1, "x") for i in range(60)]
    docs += [(None, "no id", 1, "x"), (100, None, 1, "x"), (101, "", 1, "x"), (7, docs[7][1], 1, "x"), (102, "y" * 5000, 1, "x")]
    for window, part in ((4_000_000, 2_000_000), (3000, 100)):
        monkeypatch.setattr(packing, "WINDOW_IDS", window)
        monkeypatch.setattr(packing, "PART_CHARS", part)
        monkeypatch.setattr(packing, "MEMO_WORDS", 6)
        packing._WORDS.clear()
        df = spark.createDataFrame(docs, "doc_id long, text string, length int, tier string").coalesce(2)
        schema = packing.pa.schema([(c.split()[0], packing.pa.int64()) for c in packing.PIECES.split(", ")])

        class At:
            get = staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 3)}))

        monkeypatch.setattr(packing, "TaskContext", At)
        batch = packing.pa.RecordBatch.from_pylist([{"doc_id": d[0], "text": d[1]} for d in docs])
        local = [r for b in packing._packed(iter([batch]), path, schema) for r in b.to_pylist()]
        monkeypatch.undo()
        for got in (local, [r.asDict() for r in packing.packed(df, path).collect()]):
            left = defaultdict(int)
            for i, text, *_ in docs:
                left[i] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
            ids = {i: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4") for i, text, *_ in docs}
            sequences = defaultdict(list)
            for r in got:
                assert r["doc_tokens"] == len(ids[r["doc_id"]])
                assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
                left[r["doc_id"]] -= r["length"]
                sequences[r["sequence_id"]].append(r)
            assert not any(left.values())
            once = [r for r in got if r["doc_id"] != 7]  # which stands twice
            assert len({(r["doc_id"], r["start"]) for r in once}) == len(once)
            for own in sequences.values():
                at = 0
                for r in sorted(own, key=lambda r: r["offset"]):
                    assert r["offset"] == at and r["length"] > 0
                    at += r["length"]
                assert at == own[0]["tier"] and at & (at - 1) == 0 and at <= 2048
                assert len({r["step_group"] for r in own}) == 1
    assert packing.packed(df.limit(0), path).count() == 0


def test_packing_tiers():
    rng = random.Random(4)
    lengths = [rng.choice([0, 1, 5, 200, 256, 300, 900, 2047, 2048, 2049, 5000, rng.randrange(4000)]) for _ in range(500)]
    sequences = list(packing.pack(lengths))
    assert sum(n for _, own in sequences for *_, n in own) == sum(lengths) == sum(t for t, _ in sequences)
    # Tiers are kept: most sequences are of a tier's length, and short documents do not all end up in the longest.
    assert sum(t not in packing.TIERS for t, _ in sequences) <= 11
    steps = packing.grouped(sequences)
    of = defaultdict(list)
    for (tier, own), g in zip(sequences, steps, strict=True):
        of[g].append((tier, sum(n * n for *_, n in own)))
    assert all(len({t for t, _ in own}) == 1 and len(own) <= packing.GROUP for own in of.values())
    assert list(packing.pack([])) == [] and packing.grouped([]) == []


def trie_of(conversations):
    """conversations: id -> turns -> contract rows."""
    nodes = defaultdict(list)
    for c, own in conversations.items():
        for d in range(len(own) + 1):
            nodes[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * (len(path[-1][1].split()) if path else 0)
        below = [out[c] for c in children[path]]
        ends = ",".join(str(c) for c in sorted(c for c in nodes[path] if len(conversations[c]) == len(path)))
        out[path] = (min(nodes[path]), len(path), min(nodes[path[:-1]]) if path else None, len(nodes[path]), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return ordered(out.values())


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:
        for module, name, value in ((prefixtrie, "SHARD_TURNS", 6), (prefixtrie, "SLAB", 2), (prefixtrie, "STRETCH_BITS", 2), (prefixtrie, "TASK_NODES", 20), (scans, "FAN", 2), (scans, "ROWS_PER_BLOCK", 30)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(5)
    texts = ["hello there", "a b c", "", "one more\ntime", "é"]
    rows = []
    for c in [*range(70), 140, 141, 145, -3, 20_000_000_000]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 12])):
            text = rng.choice(texts[: 2 if rng.random() < 0.8 else 5])
            rows.append((c, None if k == 0 and rng.random() < 0.3 else k, rng.choice(["user", "user", "user", None]), None if text == "" else text))
    rows += [(c, k, "user", f"t {k}") for c in (300, 301, 302, 303, 307) for k in range(15)]
    rows += [rows[5], rows[5], (None, 1, "user", "x"), (400, None, None, None), (401, 1, "user", "w " * 300_000)]
    conversations = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        conversations[c].append((role or "", text or ""))
    rebuilt = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = conversations.get(base, [])[:h] + own[h:]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, words string")
    trie = prefixtrie.build(*prefixtrie.spliced(*prefixtrie.turns_of(df, len(rows))))
    got = ordered(tuple(r) for r in prefixtrie.rollups(trie).collect())
    assert got == trie_of(rebuilt) and len(got) > 100
    shards = trie.shards().collect()
    assert sum(s.n_nodes for s in shards) + trie.heavy.count() + 1 == len(got)
    for s in shards:
        bits = np.unpackbits(np.frombuffer(s.louds, np.uint8))[: 2 * s.n_nodes + 1]
        assert bits.sum() == s.n_nodes and len(s.labels) == 16 * s.n_nodes


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.rollups(prefixtrie.build(*prefixtrie.spliced(*prefixtrie.turns_of(spark.createDataFrame([], schema), 0)))).count() == 0
    # Conversation 1 has three heads to take and none to take them from: it keeps no turn, and the root is a leaf.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    df = spark.createDataFrame([(c, 1, "user", "x"), (c, 2, "user", "y")], schema)
    got = [tuple(r) for r in prefixtrie.rollups(prefixtrie.build(*prefixtrie.spliced(*prefixtrie.turns_of(df, 2)))).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_louds_navigates():
    rng = np.random.default_rng(6)
    above = np.array([-1, -1, *[rng.integers(0, k) for k in range(2, 200)]])
    level = np.zeros(200, np.int64)
    for k in range(2, 200):
        level[k] = level[above[k]] + 1
    trie = prefixtrie.Louds.build(above, level, np.arange(200))
    place = np.empty(200, np.int64)
    place[trie.order] = np.arange(200)
    assert [(-1 if a < 0 else place[a]) for a in above[trie.order]] == trie.parent.tolist()
    sums = trie.rolled_up(np.ones(200, np.int64))
    below = np.ones(200, np.int64)
    for k in range(199, 1, -1):
        below[above[k]] += below[k]
    assert sums.tolist() == below[trie.order].tolist()




@pytest.mark.parametrize("name", ["op11_translog", "op13_prefixtrie"])
def test_against_sql(spark, name):
    import duckdb

    from adlens.llm.queries import ORACLES, QUERIES

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    df, rel = QUERIES[name](spark, d), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall())
