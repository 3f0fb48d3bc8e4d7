"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: each byte adds a fixed random number to the doubled hash, so after 32 bytes it
depends on those alone. A chunk ends where the hash has enough zero bits; the count is normalised: more bits are asked
for before the normal length and fewer after it, which keeps lengths close together. A boundary depends on the bytes
near it, so an insertion shifts text without changing chunks further on. The fingerprint is the set of chunk digests
with their lengths. The likeness of A to B is the containment: the length of A's chunks that B has, by all of A's.

Null texts count as empty. An empty text has the empty fingerprint; its likeness to an empty text is 1, to others 0.
Equal texts have equal fingerprints. Texts of any length are cut whole.

``fingerprint_edits`` pairs every document with the next one in descending order of doc_id (nulls last; rows with the
same doc_id by a hash of their text), after the last with the first. Documents are dealt to range buckets of doc_id and
streamed in order within each; a bucket also gets a copy of the first row of the next one. So texts are shuffled
once, and no task holds more than an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, rows_of

LEAST, NORMAL, MOST = 32, 96, 512
#: Zero bits asked for before and after the normal length.
STRICT_BITS, LOOSE_BITS = 8, 5
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, in order; the last is len(data)."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after these, h[i] holds the last 32 bytes
        doubled = h.copy()
        doubled[k:] += h[:-k] << np.uint32(k)
        h = doubled
    top = h >> np.uint32(32 - LOOSE_BITS)
    at = np.flatnonzero(top == 0)
    strict = (h[at] >> np.uint32(32 - STRICT_BITS)) == 0
    out, start = [], 0
    marks = [(p + 1, s) for p, s in zip(at.tolist(), strict.tolist(), strict=True)]
    i, count = 0, len(marks)
    while n - start > LEAST:
        end = min(n, start + MOST)
        while i < count and marks[i][0] < start + LEAST:
            i += 1
        j = i
        while j < count and marks[j][0] <= end:
            p, s = marks[j]
            if s or p >= start + NORMAL:
                end = p
                break
            j += 1
        out.append(end)
        start, i = end, j
    if start < n:
        out.append(n)
    return out


def chunks_of(text: str) -> dict[str, int]:
    """Digest of each distinct chunk: its length in bytes."""
    data, start, out = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in boundaries(data):
        out[xxhash.xxh3_64_hexdigest(data[start:end])] = end - start
        start = end
    return out


def written(chunks: dict[str, int]) -> str:
    return ",".join(f"{k}:{chunks[k]}" for k in sorted(chunks))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    if not a:
        return 0.0 if b else 1.0
    return sum(v for k, v in a.items() if k in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, copy, doc_id, text) in order; a row is written when the one after it in its bucket is there."""
    held = None
    for buckets, copies, ids, texts in rows_of(batches):
        out = []
        for bucket, copy, doc_id, text in zip(buckets, copies, ids, texts, strict=True):
            if copy and (held is None or held[0] != bucket):
                continue  # a further copy: repeated rows of one doc_id
            chunks = chunks_of(text)
            if held is not None and held[0] == bucket:
                _, old_id, old, own = held
                new = edited(old, text)
                changed = chunks_of(new)
                out.append((old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(changed), containment(own, changed), containment(own, chunks)))
            held = None if copy else (bucket, doc_id, text, chunks)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), EDITS, strict=True)], schema=EDITS)


def fingerprint_edits(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or 4 * partitions(spark)
    cuts = source.select("doc_id").filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cut = Bucketizer(splits=[float("-inf"), *sorted(set(cuts)), float("inf")], inputCol="at", outputCol="bucket")

    def dealt(df: DataFrame) -> DataFrame:  # null ids come last: below all others
        placed = df.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
        placed = cut.transform(placed) if cuts else placed.withColumn("bucket", F.lit(0))
        return placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("bucket").cast("int"))).drop("at")

    heads = {r[0]: r[1] for r in dealt(source.select("doc_id")).groupBy("bucket").agg(F.max("doc_id")).collect()}  # a row a bucket
    order = sorted(heads)
    copies = [(heads[b], order[i + 1] if i + 1 < len(order) else order[0]) for i, b in enumerate(order)]
    wanted = spark.createDataFrame(copies, "head bigint, goes int")
    rows = dealt(source).join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head")), "left")  # at most n rows
    own = F.struct(F.col("bucket"), F.lit(0).alias("copy"))
    both = F.array(own, F.struct(F.col("goes").alias("bucket"), F.lit(1).alias("copy")))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(both)).alias("to"))
    rows = rows.select("to.bucket", "to.copy", "doc_id", "text").repartition(partitions(spark), "bucket")
    rows = rows.sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.mapInArrow(_pairs, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
