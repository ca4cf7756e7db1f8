"""Request stream: criteria rows in, at most ten movies per row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmloom.operators.filters import criteria_rules
from filmloom.operators.rules import failed_rules
from filmloom.operators.search import can_ask, recommend, route
from filmloom.session import materialize
from filmloom.sources import vector_store


def answer(requests: DataFrame, movies: DataFrame, serving: DataFrame, dimension: int | None = None) -> DataFrame:
    """Ranked rows of valid requests, and one row with rank 0 for each other: `invalid`, `alert` or `no_results`.

    A request is invalid when its criteria break a rule, or when it asks for a semantic search without a language or
    with a vector that cannot be compared (of the wrong length, if `dimension` is given).
    """
    way = route(requests)
    broken = F.size(failed_rules(criteria_rules())) > 0
    unasked = (way == "hybrid") & ~can_ask(dimension)
    checked = requests.withColumn("_route", F.when(broken | unasked, "invalid").when(way == "none", "alert").otherwise(way))
    asks = checked.where(~F.col("_route").isin("invalid", "alert"))
    ranked = materialize(recommend(movies, serving, asks.drop("_route")), "ranked")  # read twice below
    silent = checked.where(F.col("_route").isin("invalid", "alert")).select("query_id", F.col("_route").alias("route"))
    empty = asks.select(F.col("query_id").cast("string").alias("query_id")).join(
        ranked.where("rank = 1").select("query_id"), "query_id", "left_anti").select("query_id", F.lit("no_results").alias("route"))
    rows = silent.select(F.col("query_id").cast("string").alias("query_id"), "route").unionByName(empty)
    return ranked.unionByName(rows.select("query_id", "route", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("movie_id"),
                                          F.lit(None).cast("double").alias("distance")))


def serve(requests: DataFrame, movies: DataFrame, serving: DataFrame, out: str, checkpoint: str, dimension: int | None = None):
    """Start the stream. A batch writes its own folder with overwrite, so a retried batch gives the same rows."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            answer(held, movies, serving, dimension).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            held.unpersist()

    return (requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def newest(batch: DataFrame) -> DataFrame:
    """The row of the highest `version` of each movie and language; of equal versions that of the greater text."""
    fields = [c for c in batch.columns if c not in ("movie_id", "language")]
    order = F.struct(*[c for c in ("version", "text") if c in fields])
    best = batch.groupBy("movie_id", "language").agg(F.max_by(F.struct(*fields), order).alias("r"))
    return best.select("movie_id", "language", "r.*")


def serve_embeddings(versions: DataFrame, vectors_path: str, profile: str, dimension: int, checkpoint: str,
                     buckets: int = vector_store.BUCKETS):
    """New catalog texts in, missing vectors added to a store; `vector_store.current` reads one vector per movie and language.

    The newest version of a text wins, in whatever order versions arrive: an older one that comes later is neither
    embedded nor stored. Without a `version` column, the later batch is newer. A batch owns the folder `batch=<id>` and
    looks only at earlier ones, so a retried batch gives the same rows.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        vector_store.add(newest(batch), vectors_path, batch_id, profile, dimension, buckets)

    vector_store.create(versions.sparkSession, vectors_path, buckets)
    return (versions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
