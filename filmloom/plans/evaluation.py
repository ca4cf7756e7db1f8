"""Evaluation run: cases and judgments to one report row per case and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmloom.operators import evaluate as E
from filmloom.operators.filters import FIELDS
from filmloom.operators.search import batch_hard_only, batch_hybrid
from filmloom.session import materialize

METADATA = ["year", "runtime_minutes", "genres", "average_rating", "original_language"]


def search_runs(run_rows: DataFrame, movies: DataFrame, serving: DataFrame) -> DataFrame:
    """(query_id, mode, rank, movie_id): structured runs by the hard order, the others by distance."""
    applied = run_rows.select(F.concat_ws("\u0001", "query_id", "mode").alias("run"), "mode", "language", "query_vector",
                              *[F.col(f"applied_{f}").alias(f) for f in FIELDS]).withColumnRenamed("run", "query_id")
    hard = batch_hard_only(movies, applied.where("mode = 'structured'"))
    near = batch_hybrid(serving, applied.where("mode <> 'structured'")).drop("distance")
    parts = F.split("query_id", "\u0001")
    return hard.unionByName(near).select(parts[0].alias("query_id"), parts[1].alias("mode"), "rank", "movie_id")


def evaluate(cases: DataFrame, movies: DataFrame, serving: DataFrame, judgments: DataFrame | None) -> DataFrame:
    """`cases` hold query_id, language, query_vector, filters, semantic_query, applicableModes, expectedNoResults."""
    run_rows = E.runs(cases)
    found = materialize(search_runs(run_rows, movies, serving), "results")
    described = E.with_metadata(found, movies, METADATA)
    if described.where(~F.col("known")).limit(1).count():
        raise ValueError("a result has no metadata")
    checked = E.compliance(run_rows, described)
    if judgments is None:
        scored = found.withColumn("score", F.lit(None).cast("int"))
    else:
        scored = E.with_scores(found, judgments)
    return E.report(checked, E.relevance(scored, judgments))
