"""Stages of the corpus pipeline against brute force."""

import random

import corpus_pipeline
import pytest

from adlens.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def groups(texts):
    """The component of each text: links at a Jaccard similarity of 0.8 on five-word shingles."""

    def bag(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    bags, of = [bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(bags[i] & bags[j]) >= 4 * len(bags[i] | bags[j]):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    return of


@pytest.mark.parametrize(("crowd", "sample"), [(64, 16), (3, 16), (1, 16), (3, 1), (1, 1)])
def test_near_copies(spark, monkeypatch, crowd, sample):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "SAMPLE", sample)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, " \n", "a b", "A  b", "a c"]
    common = rng.choices(words, k=30)
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(20, 160)) + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 9)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = "changed"
            texts.append(" ".join(x))
    for k in range(40):  # a common passage with ever more words of its own, and without its first words
        texts.append(" ".join([*common[k % 3 :], *(f"own{k}.{i}" for i in range(k // 5))]))
    of = groups(texts)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want = sorted(min(i for i, y in enumerate(of) if y == x) for x in set(of))
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got) == want and len(want) < len({t for t in texts})
    assert corpus_pipeline.without_near_copies(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_near_copies_by_row(spark):
    rows = [(None, "one text without an id", "en", "s", 1), (None, "another text without an id", None, None, 1), (7, "these are the words of a text", "en", "s", 1), (7, "quite different words under one id", "de", "t", 1)]
    rows += [(8, "these are the words of a text", "en", "s", 1), (None, "a text of two rows only", "en", "s", 1), (9, "a text of two rows only", "en", "s", 1), (5, "a repeated row is kept once", "en", None, 1)]
    rows += [(5, "a repeated row is kept once", "en", None, 1), (6, "one id and text from two sources", "en", "b", 1), (6, "one id and text from two sources", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {rows[k] for k in (0, 1, 2, 3, 6, 7, 10)}
    for docs in (df, df.repartition(5), df.orderBy("text", ascending=False)):
        got = [tuple(r) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
        assert len(got) == len(want) and set(got) == want
