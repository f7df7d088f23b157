"""Rows without an id in the pipeline's first stage."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_labels_of_rows_without_an_id_are_learnt(spark):
    said = {"en": "the house and the garden were quiet", "de": "das Haus und der Garten waren still"}
    rows = [(None, f"{x} {k}", lang, "s", 1) for lang, x in said.items() for k in range(5)] + [(None, "the quiet house", None, None, 1), (None, "12 34", "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.by_language(spark, docs, "").collect()
    assert sorted((r.text, r.lang or "") for r in kept) == sorted((x[1], x[2] or "") for x in rows[:11])
