"""Catalog build: sources to a published bilingual catalog with cast, all gates on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmloom import schemas
from filmloom.functions.cast import with_cast
from filmloom.operators import catalog as C
from filmloom.operators.release import conserved
from filmloom.operators.rules import GateError, catalog_rules, duplicate_report, gate, violations
from filmloom.session import materialize
from filmloom.sources import readers


@dataclass
class Sources:
    tag_scores: DataFrame
    metadata: DataFrame
    links: DataFrame
    genres: DataFrame
    ratings: DataFrame
    details: DataFrame
    dictionary: DataFrame
    cast_overrides: DataFrame | None = None


def read_sources(spark: SparkSession, paths: dict[str, str]) -> Sources:
    """Read the files and refuse them when any row breaks a source rule."""
    frames = {"tag_scores": readers.read_tag_scores(spark, paths["tag_scores"]),
              "metadata": readers.read_metadata(spark, paths["metadata"]),
              "links": readers.read_links(spark, paths["links"]),
              "genres": readers.read_genres(spark, paths["genres"]),
              "ratings": readers.read_ratings(spark, paths["ratings"])}
    for name, frame in frames.items():
        broken = frame.where(F.size("failed_rules") > 0).select(F.explode("failed_rules").alias("rule"))
        gate(broken.groupBy("rule").agg(F.count(F.lit(1)).alias("violations")), name)
    clean = {name: frame.drop("failed_rules") for name, frame in frames.items()}
    gate(duplicate_report(clean["metadata"], {"item_id": ["item_id"]}), "metadata")
    gate(duplicate_report(clean["links"], {"movieId": ["movieId"]}), "links")
    gate(duplicate_report(clean["genres"], {"movieId": ["movieId"]}), "genres")
    gate(duplicate_report(clean["tag_scores"], {"item_id_tag": ["item_id", "tag"]}), "tag scores")
    return Sources(**clean, details=spark.read.parquet(paths["details"]), dictionary=spark.read.parquet(paths["dictionary"]))


def build(sources: Sources) -> tuple[DataFrame, DataFrame]:
    """(catalog with cast, excluded ids). Stages are written once, since several gates read each of them."""
    base = materialize(C.base_movies(sources.tag_scores, sources.metadata), "base")
    excluded = C.missing_metadata(sources.tag_scores, sources.metadata)
    semantic = C.semantic_movies(base, sources.tag_scores)
    enriched = materialize(C.enriched_movies(base, sources.links, sources.genres, sources.ratings, sources.details), "enriched")
    gate(violations(enriched, C.enrichment_rules()), "enrichment")

    merged, mismatches = C.merge_catalog(semantic, enriched.select(*schemas.ENRICHED_FIELDS))
    if mismatches.limit(1).count():
        raise GateError("semantic and enriched records differ")
    merged = materialize(merged, "merged")
    gate(violations(merged, catalog_rules()), "catalog")
    gate(duplicate_report(merged, {"id": ["movieLensId"], "imdb": ["imdbId"], "tmdb": ["tmdbId"]}), "catalog keys")

    bilingual = C.bilingual_catalog(merged, sources.dictionary)
    parsed = materialize(with_cast(bilingual, overrides=sources.cast_overrides), "cast")
    if parsed.where((F.col("missing") > 0) | F.col("cast_error").isNotNull()).limit(1).count():
        raise GateError("tags without a translation, or cast lists outside the reviewed grammar")
    texts = C.document_texts_v6(parsed)
    if texts.where(~F.col("rederived")).limit(1).count():
        raise GateError("stored document texts do not re-derive")
    final = (parsed.drop("semanticText", "semanticTextSr").join(texts.drop("rederived"), "movieLensId")
             .select(*schemas.CAST_FIELDS))
    kept = [f for f in schemas.CATALOG_FIELDS if f not in ("movieLensId", "semanticText")]
    if conserved(merged, final, "movieLensId", kept).limit(1).count():
        raise GateError("a source field changed on the way")
    return final, excluded


def serving_movies(catalog: DataFrame) -> DataFrame:
    """The catalog in the column names that filters and search use."""
    c = F.col
    return catalog.select(
        c("movieLensId").alias("movie_id"), c("imdbId").alias("imdb_id"), c("tmdbId").cast("bigint").alias("tmdb_id"),
        "title", "year", c("runtimeMinutes").alias("runtime_minutes"), c("originalLanguage").alias("original_language"),
        "genres", c("averageRating").alias("average_rating"), c("ratingCount").alias("rating_count"),
        c("posterPath").alias("poster_path"), "cast")


def document_rows(catalog: DataFrame) -> DataFrame:
    """(movie_id, language, text) for the encoder."""
    both = F.array(F.struct(F.lit("en").alias("language"), F.col("semanticText").alias("text")),
                   F.struct(F.lit("sr").alias("language"), F.col("semanticTextSr").alias("text")))
    return catalog.select(F.col("movieLensId").alias("movie_id"), F.explode(both).alias("d")).select("movie_id", "d.*")
