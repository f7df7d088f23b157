"""Empty tables, clashing columns, long texts and crowded neighbours."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from adlens.llm import bpe, langid, licenses, lines, media, mixing, neighbours, pii, simhash, similar, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["dh", "h1", "h2", "row", "doc", "drop", "n_drop", "line_dedup_doc", "LINE_DEDUP_HASH", "found_language", "spans", "want", "pii", "key", "size", "target", "p", "bucket", "fp", "id", "component", "copies", "n_lines"]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

OPERATORS = {
    "pii": pii.report, "licenses": licenses.scan, "media": media.stored_media, "suffix": suffix.strip, "lines": lines.dedup, "mixing": lambda d: mixing.mix(d, F.array("source")), "simhash": simhash.near_duplicates, "bpe": lambda d: bpe.encoded(d, RANKS),
    "langid": lambda d: langid.identify(d, langid.train(d)), "similar": lambda d: similar.similar(d.withColumn("row", F.monotonically_increasing_id())),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


def test_empty_embeddings(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_empty_pipeline(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    rows = [(k, t, "en", f"s{k % 2}", 1) for k, t in enumerate(["a line of more than twenty characters\nshort", "a line of more than twenty characters", None, "", "short\nshort"])]
    plain = spark.createDataFrame(rows, DOCS)
    if name == "similar":
        taken = [c for c in CLASH if c != "row"]
    else:
        taken = CLASH
    odd = plain.select("*", *[F.lit("x").alias(c) for c in taken])
    a, b = OPERATORS[name](plain), OPERATORS[name](odd)
    own = [c for c in a.columns if c in b.columns]
    assert sorted(map(str, a.select(own).collect())) == sorted(map(str, b.select(own).collect()))


def test_short_lines_go_by_equality(spark):
    df = spark.createDataFrame([(1, "yes\nno\n\n}", "x"), (2, "no\nmaybe\n\n}", "x"), (3, "nn", "x")], "doc_id long, text string, dh string")
    assert [(r.text, r.n_removed, r.dh) for r in lines.dedup(df).orderBy("doc_id").collect()] == [("yes\nno\n\n}", 0, "x"), ("maybe\n", 2, "x"), ("nn", 0, "x")]


def test_language_needs_a_letter(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 4, "text string, lang string")
    model = langid.train(train)
    asked = spark.createDataFrame([("² ½ Ⅳ 12",), (None,), ("",), ("the dog",), ("und die",), ("x² le chat",)], "text string")
    assert [r.lang_pred for r in langid.identify(asked, model).collect()] == ["und", "und", "und", "en", "de", "fr"]


def test_a_rare_language_keeps_its_words(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_WORDS", 20)
    rows = [(" ".join(f"w{chr(97 + (k * 7 + j) % 26)}" for j in range(26)), "en") for k in range(200)] + [("seltene worte hier", "de")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert {"seltene", "worte", "hier"} <= set(model.words)


def test_long_text_in_parts(monkeypatch):
    tok = bpe.Tokenizer.load(RANKS)
    text = ("Some words, and 12 numbers; it's   a text\n\n with  gaps  " * 40) + "é" * 50 + " end's "
    whole = tok.encode_block([text])[0].tolist()
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 64)
    assert len(list(bpe.parts(text))) > 20 and "".join(bpe.parts(text)) == text
    assert next(iter(tok.encode([text]))).tolist() == whole


def test_crowded_neighbours(spark):
    """Two groups of close vectors whose members reach each other only across, a crowd wider than any list, and many others."""
    rng = np.random.default_rng(3)
    dim, rows = 24, []

    def turned(x, to):  # a vector at cosine `to` from x
        y = rng.standard_normal(dim)
        y -= (y @ x) * x
        return to * x + np.sqrt(1 - to * to) * y / np.linalg.norm(y)

    unit = lambda x: x / np.linalg.norm(x)
    a = unit(rng.standard_normal(dim))
    b = turned(a, 0.945)
    rows += [unit(c + 0.02 * rng.standard_normal(dim)) for c in (a, b) for _ in range(14)]
    crowd = unit(rng.standard_normal(dim))
    rows += [unit(crowd + 0.05 * rng.standard_normal(dim)) for _ in range(180)]
    rows += [unit(rng.standard_normal(dim)) for _ in range(1500)]
    x = np.array(rows)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    of = np.arange(len(x))
    while True:
        low = np.minimum(of, np.where(near, of[None, :], len(x)).min(1))
        if (low == of).all():
            break
        of = low
    got = neighbours.near_duplicates(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (int(near[k].sum()), int(of[k])) for k in range(len(x))}
    assert got[0].audited_recall >= 0.9 and sum(r.saturated for r in got) >= 100 and of[14] == 0
