"""Reproducible stratified samples and review samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from filmloom.functions.text import stratum_key


def stratified_sample(movies: DataFrame, size: int, seed: str, key: str = "movie_id") -> DataFrame:
    """Round-robin over strata (year band and first genre), hash order inside, until `size` rows are taken.

    At most `size` rows of a stratum can be taken, so each is cut to that before the shuffle.
    """
    ranked = movies.select(key, "year", "genres").select(
        key, stratum_key(F.col("year"), F.col("genres")).alias("stratum"),
        F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256).alias("_hash"))
    w = Window.partitionBy("stratum").orderBy("_hash", key)
    rounds = ranked.withColumn("round", F.row_number().over(w)).where(F.col("round") <= size)
    return rounds.orderBy("round", "stratum").limit(size).select(key, "stratum", "round")


def review_sample(movies: DataFrame, named_ids: list[int], joint: tuple[str, str], key: str = "movie_id") -> DataFrame:
    """Named rows, the first row with both names, the first without a cast and the first three, each once."""
    ordered = lambda df, n: df.select(key).orderBy(key).limit(n)
    named = movies.where(F.col(key).isin(named_ids)).select(key)
    both = movies.where(F.array_contains("cast", joint[0]) & F.array_contains("cast", joint[1]))
    unknown = movies.where(F.col("cast").isNull())
    picked = named.unionAll(ordered(both, 1)).unionAll(ordered(unknown, 1)).unionAll(ordered(movies, 3))
    return picked.distinct()
