"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two fingerprints within the radius always
share one. Variants are shuffled, the fingerprints that meet on one are linked to the smallest of them (all that
meet lie within the radius of each other, so a star keeps the connectivity), and the links are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import cut
from adlens.llm.components import components

SEED = 42
BITS = 64
_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, least bit first."""
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE
        total += (np.bincount(part.ravel(), minlength=2048).reshape(8, 256) @ _OF_BYTE).ravel()
    return total


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    to = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), to.tolist(), strict=True)], dtype=np.uint64)
    on = _set_bits(hashes) * 2 > n
    return int((on.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _ball(fp: Column, radius: int) -> Column:
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    return F.array(*[fp.bitwiseXOR(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")) for m in masks])


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps (fp distinct) -> (u, v): links within an even radius that keep the connectivity of all of them."""
    if radius % 2:
        raise ValueError("the radius must be even")
    met = fps.select("fp", F.explode(_ball(F.col("fp"), radius // 2)).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    return (
        met.withColumn("v", least)
        .filter("fp != v")
        .select(F.col("fp").alias("u"), "v")
        .distinct()
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id long, fingerprint string, component_id long.

    Null, empty and white-space texts have fingerprint zero and are linked to each other like any others. Repeated
    rows each come back. A row whose id is null belongs to its component; a component of null ids only has a null
    component_id. An empty table gives an empty result; further columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    found = components(fingerprint_links(fps.select("fp"), radius), "simhash")
    member = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    first = member.groupBy("c").agg(F.min("least").alias("component_id"))
    of_fp = member.join(first, "c").select(F.col("fp").alias("f"), "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("f")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
