"""Readers with closed schemas. Each row comes back typed, with the names of the rules it breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from filmloom import schemas, vocab
from filmloom.functions.text import is_blank
from filmloom.operators.rules import Rule, distinct_nonblank, failed_rules, is_finite
from filmloom.sources import json_arrays

CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Strict header, RFC-style quotes. Every field is read as text and cast by the caller."""
    return (spark.read.schema(f"{schema}, {CORRUPT} STRING").option("header", True).option("enforceSchema", False)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .option("nullValue", "\u0000").option("emptyValue", "")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def blank_lines(spark: SparkSession, path) -> DataFrame:
    """Blank data lines, which the CSV reader would skip silently."""
    return spark.read.text(path).where(F.length(F.trim("value")) == 0)


def _whole(column: str) -> Column:
    return F.when(F.col(column).rlike("^[0-9]+$"), F.expr(f"try_cast(`{column}` AS BIGINT)"))


def _safe_id(column: Column) -> Column:
    return column.between(1, vocab.MAX_SAFE_INTEGER)


def read_tag_scores(spark: SparkSession, path) -> DataFrame:
    """(tag, item_id, score, failed_rules) of `tag,item_id,score`. A blank data line is a row that fails `blank`."""
    raw = _csv(spark, path, schemas.TAG_SCORES_RAW)
    item = _whole("item_id")
    score = F.expr("try_cast(trim(score) AS DOUBLE)")
    rules = [Rule("fields", F.col(CORRUPT).isNull()), Rule("tag", F.length("tag") > 0),
             Rule("item_id", _safe_id(item)), Rule("score", is_finite(score))]
    # A line of spaces has too few fields; one with commas is a data line, whatever its fields hold.
    spaces = F.coalesce(F.col(CORRUPT).rlike(r"^\s*$"), F.lit(False))
    rows = raw.select("tag", item.alias("item_id"), score.alias("score"), failed_rules(rules).alias("failed_rules"), spaces.alias("_blank"))
    # Lines of one field that hold nothing or spaces come back from the text reader; the other reader skips them.
    blanks = blank_lines(spark, path).select(
        F.lit(None).cast("string").alias("tag"), F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("double").alias("score"),
        F.array(F.lit("blank")).alias("failed_rules"))
    return rows.where(~F.col("_blank")).drop("_blank").unionByName(blanks)


def read_links(spark: SparkSession, path) -> DataFrame:
    """(movieId, imdbId, tmdbId, failed_rules); an empty tmdbId is null."""
    raw = _csv(spark, path, schemas.LINKS_RAW)
    movie, tmdb = _whole("movieId"), F.expr("try_cast(tmdbId AS INT)")
    absent = F.col("tmdbId").isNull() | (F.col("tmdbId") == "")
    rules = [Rule("fields", F.col(CORRUPT).isNull()), Rule("movieId", movie > 0), Rule("imdbId", F.col("imdbId").rlike("^[0-9]+$")),
             Rule("tmdbId", absent | (F.col("tmdbId").rlike("^[0-9]+$") & (tmdb > 0)))]
    return raw.select(movie.alias("movieId"), "imdbId", F.when(~absent, tmdb).alias("tmdbId"),
                      failed_rules(rules).alias("failed_rules"))


def read_genres(spark: SparkSession, path) -> DataFrame:
    """(movieId, title, genres, failed_rules); `(no genres listed)` is null, source order is kept."""
    raw = _csv(spark, path, schemas.GENRES_RAW)
    movie = _whole("movieId")
    listed = F.when(F.col("genres") != "(no genres listed)", F.split("genres", r"\|", -1))
    rules = [Rule("fields", F.col(CORRUPT).isNull()), Rule("movieId", movie > 0),
             Rule("genres", listed.isNull() & F.col("genres").isNotNull() | distinct_nonblank(listed))]
    return raw.select(movie.alias("movieId"), "title", listed.alias("genres"), failed_rules(rules).alias("failed_rules"))


def read_ratings(spark: SparkSession, path, rating_type: str = "DECIMAL(10,3)") -> DataFrame:
    """(userId, movieId, rating, timestamp, failed_rules); every row is checked, selected or not."""
    raw = _csv(spark, path, schemas.RATINGS_RAW)
    user, movie, at = _whole("userId"), _whole("movieId"), _whole("timestamp")
    wide = F.when(F.col("rating").rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.expr("try_cast(rating AS DECIMAL(38,18))"))
    rating = F.when(wide.between(0, 5), wide.cast(rating_type))
    # A rating with more decimals than the type keeps is refused, not rounded into the range.
    exact = wide.between(0, 5) & (rating.cast("DECIMAL(38,18)") == wide) & (F.length(F.regexp_extract("rating", r"\.([0-9]*)", 1)) <= 18)
    rules = [Rule("fields", F.col(CORRUPT).isNull()), Rule("userId", user > 0), Rule("movieId", movie > 0),
             Rule("rating", exact), Rule("timestamp", at >= 0)]
    return raw.select(user.alias("userId"), movie.alias("movieId"), rating.alias("rating"), at.alias("timestamp"),
                      failed_rules(rules).alias("failed_rules"))


def _kind(path: str) -> Column:
    """JSON type of a field, null when it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{path}", "variant"))


_NUMBER = r"^(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))$"


def read_metadata(spark: SparkSession, path) -> DataFrame:
    """(item_id, title, imdbId, avgRating, directedBy, starring, failed_rules) of one JSON object per line.

    Lines are parsed as VARIANT, so numbers and texts are told apart and repeated keys are refused.
    Uniqueness over the file is `duplicates(df, 'item_id')`.
    """
    lines = spark.read.text(path).select(
        F.when(F.col("value").startswith("﻿"), F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("value"))
    v = lines.withColumn("_v", F.try_parse_json("value"))
    text = lambda name: F.when(_kind(name) == "STRING", F.try_variant_get(F.col("_v"), f"$.{name}", "string"))
    item = F.when(_kind("item_id") == "BIGINT", F.try_variant_get(F.col("_v"), "$.item_id", "bigint"))
    rating = F.when(_kind("avgRating").rlike(_NUMBER), F.try_variant_get(F.col("_v"), "$.avgRating", "decimal(28,18)"))
    rows = v.select("_v", item.alias("item_id"), *[text(n).alias(n) for n in ("title", "imdbId", "directedBy", "starring")],
                    rating.alias("avgRating"))
    rules = [Rule("object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False))),
             Rule("item_id", _safe_id(F.col("item_id"))), Rule("title", F.col("title").isNotNull()),
             Rule("imdbId", F.col("imdbId").rlike("^[0-9]+$")), Rule("avgRating", F.col("avgRating").between(0, 5)),
             Rule("directedBy", F.col("directedBy").isNotNull()), Rule("starring", F.col("starring").isNotNull())]
    return rows.withColumn("failed_rules", failed_rules(rules)).select(
        "item_id", "title", "imdbId", "avgRating", "directedBy", "starring", "failed_rules")


def _ordered_objects(texts: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Columns of the schema plus `shape_ok`: exactly its fields, in its order, none twice at any depth."""
    declared = T.StructType.fromDDL(schema).fields
    fields = F.array(*[F.lit(f.name) for f in declared])
    others = [c for c in texts.columns if c != text]
    parsed = texts.withColumn("_v", F.try_parse_json(text)).withColumn(
        "_r", F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"}))
    ok = (F.json_object_keys(text) == fields) & F.col("_v").isNotNull()
    for f in declared:
        ok = ok & _typed(F.col("_v"), f"$.{f.name}", f.dataType, F.col(f"_r.{f.name}"))
    return parsed.select(*others, "_r", F.coalesce(ok, F.lit(False)).alias("shape_ok")).select(
        *others, "_r.*", "shape_ok")


def _typed(document: Column, path: str, kind: T.DataType, value: Column) -> Column:
    """Whether the JSON value at a path is null or of the declared type; a wrong type must not become a null."""
    found = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    absent = F.coalesce(found == "VOID", F.lit(True))
    if isinstance(kind, T.StringType):
        # Nested documents are kept as text on purpose.
        return absent | found.startswith("STRING") | found.startswith("OBJECT") | found.startswith("ARRAY")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return absent | ((found == "BIGINT") & value.isNotNull())
    if isinstance(kind, T.BooleanType):
        return absent | (found == "BOOLEAN")
    if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
        return absent | (found.rlike(_NUMBER) & value.isNotNull())
    if isinstance(kind, T.ArrayType):
        return absent | (found.startswith("ARRAY") & value.isNotNull())
    return absent | (found.startswith("OBJECT") & value.isNotNull())


def read_catalog(spark: SparkSession, path, fields: Sequence[str]) -> DataFrame:
    """Catalog JSONL with exact ordered fields, plus shape_ok and the position columns of `ascending_problems`."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_position"))
    return _ordered_objects(lines, schemas.catalog_schema(list(fields)))


def ascending_problems(rows: DataFrame, key: str = "movieLensId") -> DataFrame:
    """Rows whose id does not rise along the file.

    Neighbours are compared inside one file split; the last id of a split is held against the first id of
    the next, so no window spans a file's rows.
    """
    inside = Window.partitionBy("_file", "_block").orderBy("_position")
    within = rows.withColumn("_before", F.lag(key).over(inside)).where(F.col(key) <= F.col("_before")).select("_file", key)
    edges = rows.groupBy("_file", "_block").agg(F.min_by(key, "_position").alias("_first"),
                                                F.max_by(key, "_position").alias("_last"))
    splits = Window.partitionBy("_file").orderBy("_block")
    across = (edges.withColumn("_end", F.lag("_last").over(splits)).where(F.col("_first") <= F.col("_end"))
              .select("_file", F.col("_first").alias(key)))
    return within.unionByName(across)


def _between_objects(text: Column) -> Column:
    """The text with a mark between objects that follow each other; braces inside strings are left alone.

    Escaped backslashes and quotes are set aside first, so that a string is a run between two quotes.
    """
    aside = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0002")), F.lit('\\"'), F.lit("\u0003"))
    tokens = F.regexp_extract_all(aside, F.lit(r'"[^"]*+"|\}\s*\{|[^"}]++|\}|"'), F.lit(0))
    joined = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\}\s*\{$"), F.lit("}\u0001{")).otherwise(t)), "")
    return F.replace(F.replace(joined, F.lit("\u0003"), F.lit('\\"')), F.lit("\u0002"), F.lit("\\\\"))


def read_tolerant(spark: SparkSession, path, schema: str, shape: str) -> DataFrame:
    """One JSON array ('array'), indented objects one after another ('sequence') or 'jsonl'.

    Objects of a sequence may stand anywhere, several on a line or one over many. A sequence is cut at every line that
    begins with a brace or ends one, so a file is read in splits, and each piece is then taken apart into its objects.
    Arrays are read in splits too; an element that is none, or a missing bracket at an end, is a row that is not shape_ok.
    """
    if shape == "jsonl":
        return _ordered_objects(spark.read.text(path), schema)
    if shape == "sequence":
        chunks = spark.read.option("lineSep", "\n}").text(path)
        # The separator takes the closing brace of an indented object with it; what lacks one gets it back.
        texts = chunks.select(F.explode(F.split(F.concat(_between_objects(F.col("value")), F.lit("\n}")), "\u0001")).alias("value"))
        whole = F.when(F.try_parse_json("value").isNull() & F.try_parse_json(F.regexp_replace("value", r"\s*\}$", "")).isNotNull(),
                       F.regexp_replace("value", r"\s*\}$", "")).otherwise(F.col("value"))
        return _ordered_objects(texts.select(whole.alias("value")).where(~F.col("value").rlike(r"^\s*\}?\s*$")), schema)
    if shape == "array":
        return _ordered_objects(json_arrays.read_elements(spark, path), schema)
    raise ValueError(f"unknown shape {shape}")


def detail_payload(version: Column, tmdb_id: Column, status: Column, runtime: Column, language: Column,
                   poster: Column) -> Column:
    """The JSON text whose hash a cache entry carries."""
    return F.to_json(F.struct(version.alias("version"), tmdb_id.alias("tmdbId"), status.alias("status"),
                              runtime.alias("runtimeMinutes"), language.alias("originalLanguage"),
                              poster.alias("posterPath")), {"ignoreNullFields": "false"})


def read_detail_cache(spark: SparkSession, path) -> DataFrame:
    """Cache entries named `<tmdbId>.json`, with failed_rules."""
    c = F.col
    names = spark.read.schema(schemas.DETAIL_CACHE).json(path).select("*", F.col("_metadata.file_name").alias("_name"))
    return _checked_cache(names, c("_name") == F.concat(c("tmdbId").cast("string"), F.lit(".json"))).drop("_name")


def check_detail_table(cache: DataFrame) -> DataFrame:
    """The same rules for the cache kept as one table, which is its form at scale."""
    return _checked_cache(cache, F.lit(True))


def _checked_cache(cache: DataFrame, key_ok: Column) -> DataFrame:
    c = F.col
    payload = detail_payload(c("version"), c("tmdbId"), c("status"), c("runtimeMinutes"), c("originalLanguage"), c("posterPath"))
    empty = c("runtimeMinutes").isNull() & c("originalLanguage").isNull() & c("posterPath").isNull()
    rules = [Rule("key", key_ok), Rule("version", c("version") == vocab.DETAIL_CACHE_VERSION),
             Rule("status", c("status").isin("success", "not_found")),
             Rule("runtime", c("runtimeMinutes").isNull() | (c("runtimeMinutes") > 0)),
             Rule("language", c("originalLanguage").isNull() | ~is_blank(c("originalLanguage"))),
             Rule("poster", c("posterPath").isNull() | c("posterPath").startswith("/")),
             Rule("not_found_empty", (c("status") != "not_found") | empty),
             Rule("hash", c("sha256") == F.sha2(payload, 256))]
    return cache.withColumn("failed_rules", failed_rules(rules))


def parse_details(responses: DataFrame, requested: str = "tmdbId", status: str = "http_status",
                  body: str = "body") -> DataFrame:
    """Raw detail responses to cache rows: (tmdbId, status, runtimeMinutes, originalLanguage, posterPath,
    sha256, class). `class` names a failure and is null for usable rows; 404 gives a not_found row."""
    v = responses.withColumn("_v", F.try_parse_json(body))
    kind = _kind
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(F.col("_v"), f"$.{name}", "string"))
    optional_text = lambda name: kind(name).isNull() | kind(name).isin("VOID", "STRING")
    runtime = F.when(kind("runtime") == "BIGINT", F.try_variant_get(F.col("_v"), "$.runtime", "int"))
    good = (F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False))
            & (kind("id") == "BIGINT") & (F.try_variant_get(F.col("_v"), "$.id", "bigint") == F.col(requested))
            & (kind("runtime").isNull() | (kind("runtime") == "VOID") | (runtime >= 0))
            & optional_text("original_language") & optional_text("poster_path")
            & (text("original_language").isNull() | ~is_blank(text("original_language")))
            & (text("poster_path").isNull() | text("poster_path").startswith("/")))
    found = F.col(status) == 200
    usable = found & F.coalesce(good, F.lit(False))
    rows = v.select(
        F.col(requested).cast("int").alias("tmdbId"), F.lit(vocab.DETAIL_CACHE_VERSION).alias("version"),
        F.when(usable, "success").when(F.col(status) == 404, "not_found").alias("status"),
        F.when(usable & (runtime > 0), runtime).alias("runtimeMinutes"),
        F.when(usable, text("original_language")).alias("originalLanguage"),
        F.when(usable, text("poster_path")).alias("posterPath"),
        F.when(found & ~usable, "invalid_response").when(~found & (F.col(status) != 404), "http_status").alias("class"))
    payload = detail_payload(*[F.col(n) for n in ("version", "tmdbId", "status", "runtimeMinutes", "originalLanguage", "posterPath")])
    return rows.withColumn("sha256", F.when(F.col("status").isNotNull(), F.sha2(payload, 256)))


def read_vector_rows(spark: SparkSession, path) -> DataFrame:
    """Vector artifact lines with exactly the four fields, plus shape_ok."""
    return _ordered_objects(spark.read.text(path), schemas.VECTOR_ROW)


def read_movies(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """Serving relation; only the asked columns are read."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def _document(spark: SparkSession, path, fields: dict[str, str], entries: str) -> DataFrame:
    """The objects of a document's last field as `value`, beside its other fields and document_ok.

    Documents are read in splits; ordered keys are checked on the text of the other fields.
    """
    frames, items = json_arrays.read_document(spark, path, entries)
    header = _ordered_objects(frames, ", ".join(f"{k} {t}" for k, t in {**fields, entries: "ARRAY<STRING>"}.items()), "frame")
    return items.join(header.drop(entries).withColumnRenamed("shape_ok", "document_ok"), "_file").drop("_file")


def read_cases(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Evaluation cases as rows, each with its schemaVersion. A file is a document; with `lines`, each of its lines is one.

    Many small documents belong in lines, since a file for each costs far more to open than to read.
    """
    case = T.StructType.fromDDL(schemas.EVALUATION_CASE).simpleString()
    whole = spark.read.text(path, wholetext=not lines)
    document = F.from_json(F.col("value"), f"struct<schemaVersion:string,cases:array<{case}>>")
    return whole.select(document.alias("d")).select("d.schemaVersion", F.explode("d.cases").alias("c")).select(
        "schemaVersion", "c.*")


def read_dictionary(spark: SparkSession, path) -> DataFrame:
    """Entries of a dictionary, proposal or baseline document with header fields and failed_rules."""
    entries = _document(spark, path, {"schemaVersion": "STRING", "sourceTagsSha256": "STRING", "translator": "STRING",
                                      "normalizationVersion": "STRING"}, "entries")
    rows = _ordered_objects(entries.drop("translator"), schemas.DICTIONARY_ENTRY)
    return with_entry_rules(rows)


def with_entry_rules(rows: DataFrame) -> DataFrame:
    c = F.col
    rules = [Rule("document", c("document_ok")), Rule("shape", c("shape_ok")), Rule("en", c("en").isNotNull()),
             Rule("machine", c("machine").isNotNull()), Rule("sr", c("sr").isNotNull()),
             Rule("status", c("reviewStatus").isin(vocab.REVIEW_STATUSES)), Rule("override", c("manualOverride").isNotNull())]
    return rows.withColumn("failed_rules", failed_rules(rules)).drop("document_ok", "shape_ok")


def read_review(spark: SparkSession, path, full: bool = False) -> DataFrame:
    """Decisions of a review document with shape_ok. The full form names the hashes it was made for."""
    if full:
        fields = {"schemaVersion": "STRING", "candidateSha256": "STRING", "baselineSha256": "STRING",
                  "proposalsSha256": "STRING", "sourceTagsSha256": "STRING"}
    else:
        fields = {}
    rows = _ordered_objects(_document(spark, path, fields, "decisions"), schemas.REVIEW_FULL if full else schemas.REVIEW_SIMPLE)
    return rows.withColumn("shape_ok", F.col("shape_ok") & F.col("document_ok")).drop("document_ok")


def review_identity(decisions: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Adds made_for_other: the names of the hashes for which a decision's document was not made."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.lit(v)), F.lit(n)) for n, v in expected.items()]))
    return decisions.withColumn("made_for_other", wrong)


def read_tags(spark: SparkSession, path) -> DataFrame:
    """(tag, blank, repeated) of a JSON string array, read in splits; what is no element of one is a null tag."""
    tags = json_arrays.read_elements(spark, path, json_arrays.VALUES).withColumnRenamed("value", "tag")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select(
        "tag", is_blank(F.col("tag")).alias("blank"), (F.col("n") > 1).alias("repeated"))
