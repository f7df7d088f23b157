"""Language identification with word-first backoff.

A known word is scored by its log frequency in each language; an unseen word falls back to its character n-grams,
from the longest down to single letters, and is scored by the first length of which any n-gram is known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import cut, free_name, trimmed

UNKNOWN = "und"
#: The classifier is fitted on about this many labelled documents of each language, chosen by a hash of their text.
SAMPLE_PER_LANGUAGE = 3000
#: Words kept for each language, and n-grams for each language and length, the most frequent first.
MAX_WORDS = 30_000
MAX_GRAMS = 8_000
LONGEST = 5
#: Words of a document that count at most towards its certainty.
CERTAIN = 20
#: Distinct words whose scores a task remembers before it starts anew; they go when the task ends.
MEMO = 40_000
#: Texts that a task turns into Python strings at once.
TEXTS = 256

_ASCII_WORD = re.compile("[a-z]+")
_WORD = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """languages, most frequent first; words, and grams by length: key -> row of logs, the log frequencies in each
    language."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    logs: np.ndarray

    def score_word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return self.logs[found]
        padded = f"^{word}$"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            own = self.grams[n]
            hits = [v for k in range(len(padded) - n + 1) if (v := own.get(padded[k : k + n])) is not None]
            if hits:
                return self.logs[hits].sum(0) / len(hits)
        return np.zeros(len(self.languages))


def _logs(keys: list[str], counts: np.ndarray, at: int) -> tuple[dict[str, int], np.ndarray]:
    """Rows from `at` on, of the log frequencies of each key in each language, add-half smoothed. counts: by key and language."""
    total = counts.sum(0) + 0.5 * len(keys)
    return {key: at + k for k, key in enumerate(keys)}, np.log((counts + 0.5) / np.where(total > 0, total, 1.0))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from labelled rows; rows without text or label are left out. What reaches the driver is bounded by
    MAX_WORDS and MAX_GRAMS for each language. A key kept for one language is counted in all of them."""
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, [{} for _ in range(LONGEST + 1)], np.zeros((0, 0)))
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    share = F.create_map(*[F.lit(y) for x in languages for y in (x, max(1.0, sizes[x] / per_language))])
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < (1 << 20) / share[F.col("lang")])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    words = cut(words, "language-words")
    padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))

    grams = (
        words.select("lang", "n", *[F.when(F.length(padded) >= n, pieces(n)).alias(f"g{n}") for n in range(1, LONGEST + 1)])
        .select("lang", "n", F.explode(F.concat(*[F.coalesce(f"g{n}", F.array().cast("array<string>")) for n in range(1, LONGEST + 1)])).alias("key"))
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )

    def top(counts: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
        """The keys among the `most` most frequent of any language (and length), and how often each language has them."""
        each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(languages)]
        place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "key"))
        ranked = counts.withColumn("place", place)
        found = ranked.groupBy("key").agg(F.min("place").alias("place"), *each).filter(F.col("place") <= most).orderBy("key").drop("place").toArrow()
        return found["key"].to_pylist(), np.stack([found[f"n{k}"].to_numpy() for k in range(len(languages))], 1).astype(float)

    keys, counts = top(words.withColumn("size", F.lit(0)), MAX_WORDS)
    words_at, logs = _logs(keys, counts, 0)
    keys, counts = top(grams.withColumn("size", F.length("key")), MAX_GRAMS)
    size = np.array([len(k) for k in keys], int)
    grams_at = []
    for n in range(LONGEST + 1):
        own, more = _logs([k for k in keys if len(k) == n], counts[size == n], len(logs))
        grams_at.append(own)
        logs = np.concatenate((logs, more))
    return Model(languages, words_at, grams_at, logs)


class _Memo(dict):
    """word -> row of a growing matrix of scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[k] = self.model.score_word(word)
        return k


def decide(model: Model, text: str | None, memo: _Memo) -> tuple[str, float]:
    low = (text or "").lower()
    words = _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
    if not words or not model.languages:
        return UNKNOWN, 0.0
    total = np.zeros(len(model.languages))
    for k in range(0, len(words), 65536):
        rows = list(map(memo.__getitem__, words[k : k + 65536]))
        total += memo.rows[rows].sum(0)
    mean = total / len(words)
    best = int(mean.argmax())
    return model.languages[best], 1 / sum(math.exp(max(-700.0, (x - mean[best]) * min(len(words), CERTAIN))) for x in mean.tolist())


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is in the fold that is never learnt from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (0 to 1, the share of the best language) put in.

    A text that is null or has no letter gets "und" and score 0, as does every text if nothing could be learnt.
    All other columns are kept; columns of those two names are replaced. Ties go to the more frequent language.
    Repeated rows get equal answers; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS and MAX_GRAMS

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _Memo(sent.value)
        for batch in batches:
            langs, scores = [], []
            for k in range(0, len(batch), TEXTS):
                for t in batch.slice(k, TEXTS).to_pylist():
                    if len(memo) > MEMO:
                        memo = _Memo(sent.value)
                    lang, score = decide(sent.value, t, memo)
                    langs.append(lang)
                    scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        del memo
        trimmed()

    found = F.arrow_udf(run, "lang_pred string, score double")
    docs = docs.drop("lang_pred", "score")
    name = free_name(docs, "found_language")
    return docs.withColumn(name, found(F.col(text_col).cast("string"))).select(*docs.columns, f"{name}.lang_pred", f"{name}.score")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents, learnt from the rows that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs.filter(fold != 0))).drop("text")
