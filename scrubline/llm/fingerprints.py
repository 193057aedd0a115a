"""Document fingerprints: MinHash values of word shingles, their likeness, and near duplicates through signature bands.

A fingerprint is PERMUTATIONS minima of 16 bits. Two fingerprints agree in the share of values that estimates the
Jaccard similarity of the shingle sets. ``near_duplicates`` joins bands in Spark and verifies the Jaccard similarity;
``with_successor`` streams rows in key order and compares each with the one after it.

Defined results: a null text is empty; a text without words has the fingerprint of nothing, alike only to that of other such
texts; null keys come first, equal keys are ordered by text; after the last row comes the first; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import classes
from .shingles import MinHash

PERMUTATIONS = 128
ROWS, BANDS = 4, 32
LOWEST = -(1 << 63)
GATHER = 1 << 22  # characters of texts handled together


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", permutations: int = PERMUTATIONS) -> DataFrame:
    """Add the fingerprint of a text as lowercase hex, four digits a value."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        values = MinHash(permutations)([(x or "").encode() for x in texts.to_pylist()])
        return pa.array([x.astype(">u2").tobytes().hex() for x in values], pa.string())

    return df.withColumn(out, run(F.col(text)))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per row of df: the key, class_id, n_copies and n_links, by bands and verified similarity."""
    return classes(df, key, text, ROWS, BANDS, threshold, None).select(F.col("id").alias(key), "class_id", "n_copies", "n_links")


def _ranges(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows (key, text, place, bucket, look): buckets are ranges of the key, and each also holds, marked, the head of the next one.

    One bound per partition and one head per bucket pass through the driver; texts are shuffled once.
    """
    spark = df.sparkSession
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(LOWEST))
    keys = df.select(place.alias("place"), place.cast("double").alias("x"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(keys.approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")] if cuts else [-float("inf"), 0.0, float("inf")], inputCol="x", outputCol="bucket")
    heads = [(int(r["bucket"]), r["head"]) for r in cutter.transform(keys).groupBy("bucket").agg(F.min("place").alias("head")).orderBy("bucket").collect()]
    rows = cutter.transform(df.withColumns({"place": place, "x": place.cast("double")})).withColumn("bucket", F.col("bucket").cast("int"))
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]  # the first row's head closes the last bucket
    looks = spark.createDataFrame(before or [(None, None)], "head bigint, before int")
    joined = rows.join(F.broadcast(looks), F.col("place") == F.col("head"), "left")  # a row per bucket
    copies = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("look")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("look")))))
    return joined.withColumn("copy", F.explode(copies)).select(key, "text", "place", "copy.bucket", "copy.look"), max(len(cuts) + 1, 2)


def with_successor(df: DataFrame, key: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """For every row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as much of the beginning of the next text. A task reads its range of keys in
    order and holds the texts of a few million characters.
    """
    own = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged, n = _ranges(own, "key")
    kind = {"key": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
            "near_edited": pa.float64(), "near_next": pa.float64()}
    schema = pa.schema(list(kind.items()))

    def compare(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Results of all rows but the last, which is only looked at."""
        hasher = MinHash(permutations)
        values = hasher([x.encode() for _, x in rows])
        edited = []
        for (_, a), (_, b) in zip(rows, rows[1:]):
            k = len(a) // 4
            edited.append((a[: len(a) - k] + b[:k]).encode())
        changed = hasher(edited)
        text_of = lambda v: v.astype(">u2").tobytes().hex()
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in rows[:-1]], pa.int64()), pa.array([len(x) for _, x in rows[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited]), pa.array([text_of(v) for v in values[:-1]]), pa.array([text_of(v) for v in changed]),
            pa.array((values[:-1] == changed).mean(1) if len(changed) else np.zeros(0)), pa.array((values[:-1] == values[1:]).mean(1))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, bucket = 0, None
        for batch in batches:
            for k, x, b, look in zip(*(batch[c].to_pylist() for c in ("key", "text", "bucket", "look"))):
                if look and b != bucket:
                    continue  # its bucket is closed, by an equal key
                if b != bucket and bucket is not None and held:
                    raise ValueError(f"range {bucket} has no row after its last")
                bucket = b
                held.append((k, x))
                size += len(x)
                if look or size > GATHER and len(held) > 1:
                    yield compare(held)
                    held = [] if look else held[-1:]
                    size = 0
                    bucket = None if look else b
        if held:
            raise ValueError(f"range {bucket} has no row after its last")

    dealt = ranged.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "look", "place", "text").drop("place")
    out = dealt.mapInArrow(run, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
