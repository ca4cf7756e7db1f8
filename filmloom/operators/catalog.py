"""Catalog building: joins with reconciliation, rating aggregates, top tags and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from filmloom import schemas
from filmloom.functions.text import blank_to_null, canonical_digits, document_text, tag_names, title_parts
from filmloom.operators.rules import Rule, duplicates, one_row

TOP_TAGS = 10


def base_movies(scored_ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Scored ids with metadata, mapped to the base record. Rows whose title has no year keep null fields."""
    ids = scored_ids.select(F.col("item_id").alias("movieLensId")).distinct()
    source = metadata.select(
        F.col("item_id").alias("movieLensId"), F.col("title").alias("rawTitle"),
        title_parts(F.col("title")).alias("_t"), F.col("imdbId"), F.col("avgRating").alias("movieLensAvgRating"),
        blank_to_null(F.col("directedBy")).alias("directedByRaw"), blank_to_null(F.col("starring")).alias("starringRaw"))
    return ids.join(source, "movieLensId").select(
        "movieLensId", "rawTitle", F.col("_t.title").alias("title"), F.col("_t.year").alias("year"), "imdbId",
        "movieLensAvgRating", "directedByRaw", "starringRaw")


def missing_metadata(scored_ids: DataFrame, metadata: DataFrame) -> DataFrame:
    ids = scored_ids.select("item_id").distinct()
    return ids.join(metadata.select("item_id"), "item_id", "left_anti").select(
        F.col("item_id").alias("movieLensId"), F.lit("MISSING_METADATA").alias("reason"))


def keep_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of known movies. Members are one narrow column of unique ids, which Spark ships when it is small."""
    return rows.join(members.select(key), key, "left_semi")


def source_counts(scored: DataFrame, metadata: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: metadata_records, score_rows, scored_ids, joined, missing. Scores are reduced to ids first."""
    ids = scored.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    meta_ids = metadata.select(F.col(key).alias("_m")).distinct()
    joined = ids.join(meta_ids, ids[key] == meta_ids["_m"], "left")
    counts = joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("score_rows"), F.count(F.lit(1)).alias("scored_ids"),
                        F.count("_m").alias("joined"), F.count_if(F.col("_m").isNull()).alias("missing"))
    records = metadata.agg(F.count(F.lit(1)).alias("metadata_records"))
    return one_row(records, counts)


def rating_aggregates(ratings: DataFrame, members: DataFrame | None = None, key: str = "movieId") -> DataFrame:
    """(movie, rating_count, rating_sum): exact decimal sums with map-side partial aggregation."""
    rows = ratings if members is None else keep_members(ratings, members, key)
    kind = rows.schema["rating"].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 12:
        # Whole units of the last decimal place sum as longs, which stay in generated code.
        unit = F.lit(10 ** kind.scale)
        units = F.sum((F.col("rating") * unit).cast("bigint"))
        total = (units.cast("decimal(19,0)") / unit.cast("decimal(12,0)")).cast("decimal(28,10)")
    else:
        total = F.sum(F.col("rating").cast("decimal(28,10)"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rating_count"), total.alias("rating_sum"))


def average_rating(total: Column, count: Column) -> Column:
    """sum / count with twelve decimals. Sum and count stay the truth."""
    return F.try_divide(total.cast("decimal(25,6)"), count.cast("decimal(12,0)")).cast("decimal(28,12)")


def reconcile_ratings(ratings: DataFrame, members: DataFrame, aggregates: DataFrame, key: str = "movieId") -> DataFrame:
    """One row: selected rows, sum of the per-movie counts, and whether they agree."""
    selected = keep_members(ratings.select(key), members, key).agg(F.count(F.lit(1)).alias("selected_rows"))
    totals = aggregates.agg(F.coalesce(F.sum("rating_count"), F.lit(0)).alias("summed_counts"))
    return one_row(selected, totals).withColumn("ok", F.col("selected_rows") == F.col("summed_counts"))


def top_tags(scores: DataFrame, key: str = "movieLensId", limit: int = TOP_TAGS) -> DataFrame:
    """(movie, relevantTags): best tags by score, then by name in byte order.

    The rank limit is applied before the shuffle too, so a movie with many tags sends only `limit` per task.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("tag"))
    best = scores.select(key, "tag", "score").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("pos", F.col("tag").alias("name"), "score"))).alias("_t"))
    return lists.select(key, F.transform("_t", lambda t: F.struct(t["name"].alias("name"), t["score"].alias("score")))
                        .alias("relevantTags"))


def semantic_movies(base: DataFrame, scores: DataFrame) -> DataFrame:
    """Base record plus top tags (an empty list when there are none) and the English document text.

    Tags of unknown movies are cut to ten before the shuffle like all others and find no base record; a semi-join ahead
    of that would read and move the base once more.
    """
    tags = top_tags(scores.withColumnRenamed("item_id", "movieLensId"))
    none = F.array().cast("array<struct<name:string,score:double>>")
    joined = base.join(tags, "movieLensId", "left").withColumn("relevantTags", F.coalesce("relevantTags", none))
    text = document_text("en", F.col("title"), F.col("year"), F.col("directedByRaw"),
                         tag_names(F.col("relevantTags")), cast=F.col("starringRaw"))
    return joined.withColumn("semanticText", text).select(*schemas.SEMANTIC_FIELDS)


def link_movies(base: DataFrame, links: DataFrame) -> DataFrame:
    """Adds tmdbId, matched and imdb_ok (identity cross-check on digits without leading zeros)."""
    side = links.select(F.col("movieId").alias("movieLensId"), F.col("imdbId").alias("_imdb"), "tmdbId",
                        F.lit(True).alias("_hit"))
    joined = base.join(side, "movieLensId", "left")
    same = canonical_digits(F.col("imdbId")) == canonical_digits(F.col("_imdb"))
    return (joined.withColumn("matched", F.coalesce("_hit", F.lit(False)))
            .withColumn("imdb_ok", ~F.col("matched") | F.coalesce(same, F.lit(False))).drop("_imdb", "_hit"))


def attach_genres(linked: DataFrame, genres: DataFrame) -> DataFrame:
    """Adds genres and genre_row_ok: matched movies have a genre row, the others have none."""
    side = genres.select(F.col("movieId").alias("movieLensId"), "genres", F.lit(True).alias("_row"))
    joined = linked.join(side, "movieLensId", "left")
    has_row = F.coalesce("_row", F.lit(False))
    return joined.withColumn("genre_row_ok", has_row == F.col("matched")).drop("_row")


def attach_ratings(linked: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Matched movies without ratings get count 0 and no average; unmatched ones get neither."""
    side = aggregates.select(F.col("movieId").alias("movieLensId"), F.col("rating_count").alias("_n"),
                             F.col("rating_sum").alias("_s"))
    joined = linked.join(side, "movieLensId", "left")
    return joined.select(
        *linked.columns,
        F.when(F.col("matched") & (F.col("_n") > 0), average_rating(F.col("_s"), F.col("_n"))).alias("averageRating"),
        F.when(F.col("matched"), F.coalesce("_n", F.lit(0))).alias("ratingCount"))


def attach_details(linked: DataFrame, details: DataFrame) -> DataFrame:
    """Runtime, language and poster by tmdbId.

    Movies without a tmdbId look up a key of their own that matches nothing, so null keys do not meet in
    one task and the input is read once.
    """
    side = details.select(F.col("tmdbId").cast("bigint").alias("_key"), "runtimeMinutes", "originalLanguage", "posterPath")
    lookup = F.coalesce(F.col("tmdbId").cast("bigint"), -1 - F.col("movieLensId"))
    return linked.withColumn("_key", lookup).join(side, "_key", "left").drop("_key")


def enriched_movies(base: DataFrame, links: DataFrame, genres: DataFrame, ratings: DataFrame,
                    details: DataFrame) -> DataFrame:
    """The enriched record together with its check columns matched, imdb_ok and genre_row_ok.

    Ratings are summed for all movies, one row per movie and task before the shuffle, and join once; only matched movies
    take them. Reading the members first would plan the links and genres twice.
    """
    linked = attach_genres(link_movies(base, links), genres)
    rated = attach_ratings(linked, rating_aggregates(ratings))
    return attach_details(rated, details).select(*schemas.ENRICHED_FIELDS, "matched", "imdb_ok", "genre_row_ok")


def enrichment_rules() -> list[Rule]:
    return [Rule("imdb_identity", F.col("imdb_ok")), Rule("genre_row", F.col("genre_row_ok"))]


def pending_details(eligible: DataFrame, cache: DataFrame, refresh: DataFrame | None = None) -> DataFrame:
    """Distinct tmdb ids to fetch: not cached yet, or named for a refresh."""
    ids = eligible.where(F.col("tmdbId") > 0).select("tmdbId").distinct()
    missing = ids.join(cache.select("tmdbId"), "tmdbId", "left_anti")
    if refresh is None:
        return missing
    return missing.unionByName(ids.join(refresh.select("tmdbId"), "tmdbId", "left_semi")).distinct()


def merge_catalog(semantic: DataFrame, enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, mismatches): 1:1 merge of the two records; all shared fields must be equal."""
    shared = [f for f in schemas.BASE_FIELDS if f != "movieLensId"]
    s = semantic.withColumn("_in_s", F.lit(True))
    e = enriched.select("movieLensId", *[F.col(f).alias(f"_e_{f}") for f in shared], *schemas.DETAIL_FIELDS,
                        F.lit(True).alias("_in_e"))
    joined = s.join(e, "movieLensId", "full_outer")
    sides = F.col("_in_s").isNotNull() & F.col("_in_e").isNotNull()
    differing = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_e_{f}")), F.lit(f)) for f in shared]))
    checked = joined.withColumn("differing", F.when(sides, differing).otherwise(F.array(F.lit("missing side"))))
    catalog = checked.where(F.size("differing") == 0).select(*schemas.CATALOG_FIELDS)
    return catalog, checked.where(F.size("differing") > 0).select("movieLensId", "differing")


def translate_tags(movies: DataFrame, dictionary: DataFrame, key: str = "movieLensId",
                   tags: str = "tags") -> DataFrame:
    """(movie, tagsSr, missing): translated tags in source order with repeats, and the count of unknown tags.

    A list is rebuilt only from its own elements, so no group is larger than the list it came from.
    """
    words = dictionary.select(F.col("en").alias("_tag"), F.col("sr").alias("_sr"))
    parts = movies.select(key, F.posexplode_outer(tags).alias("pos", "_used"))
    # Movies without tags get a lookup key of their own, so that null keys do not meet in one task.
    lookup = F.coalesce("_used", F.concat(F.lit("\u0000"), F.col(key).cast("string")))
    found = parts.withColumn("_tag", lookup).join(words, "_tag", "left")
    lists = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_sr").isNotNull(), F.struct("pos", "_sr")))).alias("_l"),
        F.count_if(F.col("_used").isNotNull() & F.col("_sr").isNull()).alias("missing"))
    return lists.select(key, F.transform("_l", lambda t: t["_sr"]).alias("tagsSr"), "missing")


def bilingual_catalog(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The catalog with tagsSr and semanticTextSr appended; the source fields are not touched."""
    named = catalog.withColumn("_names", tag_names(F.col("relevantTags")))
    translated = translate_tags(named, dictionary, "movieLensId", "_names")
    joined = catalog.join(translated, "movieLensId")
    text = document_text("sr", F.col("title"), F.col("year"), F.col("directedByRaw"), F.col("tagsSr"),
                         cast=F.col("starringRaw"))
    return joined.withColumn("semanticTextSr", F.when(F.col("missing") == 0, text)).select(
        *catalog.columns, "tagsSr", "semanticTextSr", "missing")


def document_texts_v6(catalog: DataFrame) -> DataFrame:
    """(movie, en, sr, rederived): the texts without cast; the stored ones must re-derive exactly first."""
    names = tag_names(F.col("relevantTags"))
    c = F.col
    old_en = document_text("en", c("title"), c("year"), c("directedByRaw"), names,
                           cast=F.col("starringRaw"), empty_is_missing=True)
    old_sr = document_text("sr", c("title"), c("year"), c("directedByRaw"), c("tagsSr"),
                           cast=F.col("starringRaw"))
    return catalog.select(
        "movieLensId",
        document_text("en", c("title"), c("year"), c("directedByRaw"), names).alias("semanticText"),
        document_text("sr", c("title"), c("year"), c("directedByRaw"), c("tagsSr")).alias("semanticTextSr"),
        (c("semanticText").eqNullSafe(old_en) & c("semanticTextSr").eqNullSafe(old_sr)).alias("rederived"))


def tag_vocabulary(movies: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, uses) over all movies; partial counts run before the shuffle."""
    return movies.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))


def tag_totals(movies: DataFrame, tags: str = "tags") -> DataFrame:
    vocabulary = tag_vocabulary(movies, tags)
    return vocabulary.agg(F.count(F.lit(1)).alias("distinct_tags"),
                          F.coalesce(F.sum("uses"), F.lit(0)).alias("occurrences"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, null_count, present_count) from one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
                    *[F.count(F.col(c)).alias(f"p{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("null_count"),
                              F.col(f"p{i}").alias("present_count")) for i, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def failure_classes(failures: DataFrame, key: str = "tmdbId") -> tuple[DataFrame, DataFrame]:
    """((class, failures, ids), (class, id)): counts per class, and the distinct ids kept as rows."""
    ids = failures.groupBy("class", key).agg(F.count(F.lit(1)).alias("n"))
    counts = ids.groupBy("class").agg(F.sum("n").alias("failures"), F.count(F.lit(1)).alias("ids"))
    return counts, ids.select("class", key)


def status_counts(cache: DataFrame) -> DataFrame:
    return cache.groupBy("status").agg(F.count(F.lit(1)).alias("ids"))


def repeated_scores(scores: DataFrame) -> DataFrame:
    """(item_id, tag) pairs that occur more than once."""
    return duplicates(scores, "item_id", "tag")


def review_contexts(flagged: DataFrame, movies: DataFrame, per_tag: int = 3, key: str = "movieLensId",
                    tags: str = "tags") -> DataFrame:
    """(tag, movie, title, other_tags): the first movies of each flagged tag in id order.

    Only (tag, id) pairs pass the ranking; the wide columns are joined to the few that are left.
    """
    uses = movies.select(key, F.explode(tags).alias("tag")).distinct()
    wanted = uses.join(flagged.select("tag").distinct(), "tag", "left_semi")
    w = Window.partitionBy("tag").orderBy(key)
    first = wanted.withColumn("context", F.row_number().over(w)).where(F.col("context") <= per_tag)
    return first.join(movies.select(key, "title", tags), key).select(
        "tag", key, "context", "title", F.array_remove(F.col(tags), F.col("tag")).alias("other_tags"))
