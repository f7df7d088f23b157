"""One query per operator, with production parameters, over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import bpe, langid, licenses, lines, media, mixing, neighbours, packing, pii, prefixtrie, simhash, suffix, translog
from adlens.llm.common import table
from adlens.llm.oracles import ORACLES


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.strip(table(spark, sf_dir, "documents"), words=suffix.WORDS)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op11_translog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = translog.reassemble(translog.log_of(docs, table(spark, sf_dir, "labels")), docs.count())
    states = translog.replay(found).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", F.col("total").alias("value"))
    return states.unionByName(found.undone.select(F.col("why").alias("kind"), "id", F.col("by").alias("n"), F.col("key").alias("value")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = prefixtrie.spliced(*prefixtrie.turns_of(conversations, conversations.count()))
    return prefixtrie.rollups(prefixtrie.build(*turns))


_ALL = (op1_pii, op2_licenses, op3_media, op4_suffix, op5_lines, op6_neighbours, op7_mixing, op8_simhash, op9_bpe, op10_langid, op11_translog, op12_packing, op13_prefixtrie)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

