"""A store of document vectors that grows by batches: rows by batch and bucket of the movie, newest version on read.

Nothing is rewritten. A batch reads and writes only the buckets of its own movies, and decides by identities alone;
vectors are read where one is carried over to a newer version of the same text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmloom.operators.embedding import expected_vectors, stand_in_vectors
from filmloom.sources.folders import create_once, read_text

BUCKETS = 64
ROWS = "movie_id long, language string, version long, fingerprint string, text_sha256 string, vector array<float>"
_KEY = ["movie_id", "language"]


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Lay down an empty store; one that exists must have as many buckets."""
    create_once(spark, f"{path}/_layout.json", json.dumps({"buckets": buckets}))
    if json.loads(read_text(spark, f"{path}/_layout.json"))["buckets"] != buckets:
        raise ValueError("the store has another number of buckets")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("movie_id"), F.lit(buckets)).cast("int")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their `batch` and `bucket`, by which reads are pruned."""
    return spark.read.schema(f"{ROWS}, batch long, bucket int").parquet(path)


def heads(stored: DataFrame) -> DataFrame:
    """(movie_id, language, version, text_sha256, fingerprint, batch) of the newest row of each key; no vector is read.

    Of equal versions the greater text hash is the newer, so the order of arrival does not matter.
    """
    order = F.struct("version", "text_sha256", "batch", "fingerprint", "bucket")
    return stored.groupBy(*_KEY).agg(F.max(order).alias("r")).select(*_KEY, "r.*")


def current(spark: SparkSession, path: str) -> DataFrame:
    """One row per movie and language: the newest version with its vector."""
    stored = rows(spark, path)
    newest = heads(stored)
    return stored.join(newest.select(*_KEY, "bucket", "version", "text_sha256", "batch", "fingerprint"),
                       [*_KEY, "bucket", "version", "text_sha256", "batch", "fingerprint"]).select(
        *_KEY, "version", "fingerprint", "text_sha256", "vector")


def additions(stored: DataFrame, texts: DataFrame, profile: str, dimension: int, batch_id: int) -> DataFrame:
    """What a batch of one newest text per key adds to what is stored in its buckets.

    A stale text adds nothing, nor does one that is stored already. A newer version of the same text carries the vector
    over; without versions there is no need to. The rest is embedded.
    """
    versioned = "version" in texts.columns
    version = F.col("version").cast("long") if versioned else F.lit(batch_id).cast("long")
    asked = expected_vectors(texts.withColumn("version", version), profile).select(*_KEY, "version", "fingerprint", "text_sha256")
    known = heads(stored).select(*_KEY, F.col("version").alias("_v"), F.col("text_sha256").alias("_sha"), F.col("fingerprint").alias("_fp"),
                                 F.col("batch").alias("batch"))
    joined = asked.join(known, _KEY, "left")
    newer = F.col("_v").isNull() | (F.struct("version", "text_sha256") > F.struct("_v", "_sha")) | (
        (F.col("version") == F.col("_v")) & (F.col("text_sha256") == F.col("_sha")) & (F.col("fingerprint") != F.col("_fp")))
    same = F.coalesce((F.col("text_sha256") == F.col("_sha")) & (F.col("fingerprint") == F.col("_fp")), F.lit(False))
    fresh = joined.where(newer & ~same).select(*asked.columns)
    fresh = stand_in_vectors(fresh, dimension).select(*asked.columns, F.col("vector").cast("array<float>").alias("vector"))
    if not versioned:
        return fresh
    carried = joined.where(newer & same).select(*asked.columns, "_v", "batch")
    old = stored.select(*_KEY, F.col("version").alias("_v"), "text_sha256", "fingerprint", "batch", "vector")
    return fresh.unionByName(carried.join(old, [*_KEY, "_v", "text_sha256", "fingerprint", "batch"]).select(*asked.columns, "vector"))


def touched(spark: SparkSession, path: str, texts: DataFrame, batch_id: int, buckets: int) -> DataFrame:
    """Rows of earlier batches in the buckets of these texts; their numbers, at most `buckets`, pass the driver."""
    numbers = [r[0] for r in texts.select(bucket_of(buckets)).distinct().collect()]
    return rows(spark, path).where(F.col("bucket").isin(numbers) & (F.col("batch") < batch_id))


def add(texts: DataFrame, path: str, batch_id: int, profile: str, dimension: int, buckets: int = BUCKETS) -> None:
    """Write the additions of a batch into its folder, over what a failed attempt left there."""
    spark = texts.sparkSession
    held = texts.persist()
    try:
        new = additions(touched(spark, path, held, batch_id, buckets), held, profile, dimension, batch_id)
        (new.withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{path}/batch={batch_id}"))
    finally:
        held.unpersist()
