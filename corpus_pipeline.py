"""The corpus pipeline: language ID, line dedup, near-dedup by shingles, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return
the columns of documents; n_chars follows the text. Empty tables give empty results throughout, further columns are not
kept, and rows without an id take part like any others. The near-copy stage is tested against brute force, the others by
the tests of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import bpe, langid, lines, mixing, similar
from adlens.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of which the language is less certain than this are rejected, like those without one.
MIN_SCORE = 0.5

#: No SQL: the stages fit a classifier, hash shingles with XXH64 and encode by ranks.
ORACLE_SQL: str | None = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; the classifier learns from the labels that are not held out, those of rows
    without an id among them. Null texts and texts without a letter go; a null label is not learnt from; repeated rows are judged alike; ties go to the more frequent language."""
    found = langid.identify(docs, langid.train(docs.filter(~langid.held_out())))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand earlier in the corpus, and documents of which every line goes. A null text has no lines and
    stays; earlier is by id (null first), then text, then place, so of equal rows all keep the same lines."""
    left = lines.dedup(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest id (null last), then the least of the other columns."""
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    # The row number decides among rows that agree in everything, so it does not matter which of them stays.
    text = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *[x.alias(f"h{k}") for k, x in enumerate(text)], "source", "lang", "n_chars", "row")
    first = rows.select("row", order.alias("at")).join(similar.similar(rows), "row").groupBy("component").agg(F.min("at").alias("at"))
    return rows.join(first.select("at.row"), "row", "left_semi").select(*COLUMNS)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as it is taken, 3 times at most. A null source is a source; texts without words bring
    none and come as often as the plan repeats their source. Ties are broken by a seeded hash, then the row."""
    mixed = mixing.mix(docs, F.array("source"), keep=("text", "lang", "source", "n_chars"))
    taken = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(F.col("id").alias("doc_id"), "text", "lang", "source", "n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids and digests of every document of the mix; null and empty texts have no tokens, repeated rows
    each come back."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language", by_language),
    ("lines", without_repeated_lines),
    ("simhash", without_near_copies),
    ("mixing", to_target_weights),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    from adlens.llm.common import table

    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs, f"pipeline-{name}") if k + 1 < len(STAGES) else docs
    return docs
