"""Mixing where documents differ much in length."""

import random

from pyspark.sql import functions as F

from adlens.llm import mixing


def test_overlong_documents_leave_no_gap(spark):
    rng = random.Random(12)
    # Every source has far more words behind an overlong document at the cut than a few dozen documents hold.
    docs = [(i, "w " * rng.choice([1, 2, 3, 5, 8]), rng.choice("abcdefgh")) for i in range(24000)]
    docs += [(5000 + i, "w " * rng.randint(800, 900), "abcdefgh"[i % 8]) for i in range(160)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), F.array("source"), weights=(2.0, 4.0, 3.0, 3.5)).collect()
    assert len(rows) == len(docs)
    for p in "abcdefgh":
        own = [r for r in rows if r.pattern == [p]]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1, p
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
