"""Closed schemas of the tables, as DDL. Nothing is inferred on read."""

from __future__ import annotations

TAG_SCORES_RAW = "tag STRING, item_id STRING, score STRING"
LINKS_RAW = "movieId STRING, imdbId STRING, tmdbId STRING"
GENRES_RAW = "movieId STRING, title STRING, genres STRING"
RATINGS_RAW = "userId STRING, movieId STRING, rating STRING, timestamp STRING"

BASE_FIELDS = ["movieLensId", "rawTitle", "title", "year", "imdbId", "movieLensAvgRating",
               "directedByRaw", "starringRaw"]
SEMANTIC_FIELDS = BASE_FIELDS + ["relevantTags", "semanticText"]
DETAIL_FIELDS = ["tmdbId", "genres", "averageRating", "ratingCount", "runtimeMinutes",
                 "originalLanguage", "posterPath"]
ENRICHED_FIELDS = BASE_FIELDS + DETAIL_FIELDS
CATALOG_FIELDS = SEMANTIC_FIELDS + DETAIL_FIELDS
BILINGUAL_FIELDS = CATALOG_FIELDS + ["tagsSr", "semanticTextSr"]
CAST_FIELDS = BILINGUAL_FIELDS + ["cast"]

_CATALOG_TYPES = {
    "movieLensId": "BIGINT", "rawTitle": "STRING", "title": "STRING", "year": "INT",
    "imdbId": "STRING", "movieLensAvgRating": "DECIMAL(28,18)", "directedByRaw": "STRING",
    "starringRaw": "STRING", "relevantTags": "ARRAY<STRUCT<name:STRING,score:DOUBLE>>",
    "semanticText": "STRING", "tmdbId": "INT", "genres": "ARRAY<STRING>",
    "averageRating": "DECIMAL(28,18)", "ratingCount": "BIGINT", "runtimeMinutes": "INT",
    "originalLanguage": "STRING", "posterPath": "STRING", "tagsSr": "ARRAY<STRING>",
    "semanticTextSr": "STRING", "cast": "ARRAY<STRING>",
}


def catalog_schema(fields: list[str]) -> str:
    return ", ".join(f"`{name}` {_CATALOG_TYPES[name]}" for name in fields)


METADATA = (
    "title STRING, directedBy STRING, starring STRING, avgRating DECIMAL(28,18), imdbId STRING, item_id BIGINT")
DETAIL_CACHE = (
    "version STRING, tmdbId INT, status STRING, runtimeMinutes INT, originalLanguage STRING, "
    "posterPath STRING, sha256 STRING")
VECTOR_ROW = (
    "movieLensId BIGINT, fingerprint STRING, semanticTextSha256 STRING, vector ARRAY<FLOAT>")
DICTIONARY_ENTRY = (
    "en STRING, machine STRING, sr STRING, reviewStatus STRING, manualOverride BOOLEAN")
REVIEW_SIMPLE = "en STRING, approvedSr STRING"
REVIEW_FULL = (
    "en STRING, approvedSr STRING, disposition STRING, rationale STRING, confidence STRING")

# One row per query; arrays are null when the group is not asked for.
CRITERIA = (
    "year_min INT, year_max INT, runtime_min INT, runtime_max INT, genres_all ARRAY<STRING>, "
    "genres_any ARRAY<STRING>, rating_min DECIMAL(28,18), rating_operator STRING, "
    "original_language STRING, actors_all ARRAY<STRING>, actors_any ARRAY<STRING>, "
    "actors_exclude ARRAY<STRING>")

EVALUATION_CASE = (
    "id STRING, language STRING, query STRING, category STRING, note STRING, parserEval BOOLEAN, "
    "retrievalEval BOOLEAN, parserExpected STRING, retrievalQuery STRUCT<hardFilters: STRUCT<"
    "yearMin: INT, yearMax: INT, runtimeMin: INT, runtimeMax: INT, genres: STRUCT<all: ARRAY<STRING>, "
    "any: ARRAY<STRING>>, ratingMin: DECIMAL(28,18), originalLanguage: STRING, ratingOperator: STRING, "
    "actors: STRUCT<all: ARRAY<STRING>, any: ARRAY<STRING>, exclude: ARRAY<STRING>>>, "
    "semanticQuery: STRING>, applicableModes ARRAY<STRING>, expectedNoResults BOOLEAN")
