"""Repeated passages against brute force."""

import random
from collections import defaultdict

from adlens.llm import queries, suffix


def marked(texts, words):
    """For each text, the words in a passage of so many that another text has too."""
    own = [(t or "").split() for t in texts]
    at = defaultdict(set)
    for i, w in enumerate(own):
        for k in range(len(w) - words + 1):
            at[tuple(w[k : k + words])].add(i)
    return [len({k + j for k in range(len(w) - words + 1) if len(at[tuple(w[k : k + words])]) > 1 for j in range(words)}) for w in own]


def texts_of(rng, words):
    def own(n):
        if rng.random() < 0.3:
            return [rng.choice("abcdefgh") for _ in range(n)]  # words of one letter, eight bytes of which reach far
        return [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]

    planted, other = own(words + 5), own(3 * words)
    texts = [None, "", "one two", " ".join(planted)]
    for k in range(30):
        w = own(rng.randint(5, 4 * words))
        if k % 3 == 0:
            p = rng.randint(0, len(w))
            w[p:p] = planted[rng.randint(0, 8) :]
        if k % 5 == 0:
            a = rng.randint(0, len(other) - words)
            w += other[a : a + rng.randint(words - 2, 2 * words)]
        texts.append(("\n" if k % 2 else " ").join(w))
    twice = own(words + 1)
    return [*texts, texts[7], " ".join([*twice, "x", *twice])]  # a whole copy, and a passage that repeats in its own text only


def test_passages(spark):
    rng = random.Random(4)
    for words in (50, 12, 8):
        texts = texts_of(rng, words)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = {r.doc_id: r.n_passage_words for r in suffix.strip(df, words=words).collect()}
        want = marked(texts, words)
        assert [got[i] for i in range(len(texts))] == want and sum(x > 0 for x in want) > 8 and want[-1] == 0


def test_query_marks_short_passages(spark, tmp_path):
    texts = texts_of(random.Random(5), 50)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_suffix(spark, str(tmp_path)).collect()}
    assert [got[i].n_passage_words for i in range(len(texts))] == marked(texts, 50)
    assert got[3].n_removed == 0 < got[3].n_passage_words  # shorter than 400 bytes: marked and not removed
