"""How the driver tables stand in for movies, ratings, vectors, criteria and logs.

Every table is a row-local projection of a driver table, so work grows with the data. The SQL texts
define the same tables for the twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LABELS = ["Drama", "Comedy", "Action", "Thriller", "Sci-Fi", "Romance", "Horror"]
CODES = ["en", "fr", "de", "ja", "es", "sr"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = F.array_compact(F.array(
        text("Actor ", k % 50), F.when(k % 2 == 1, text("Actor ", 50 + (k * 7) % 50)),
        F.when(k % 5 == 0, text("Star ", k % 9))))
    rated = k % 19 != 0
    return table(spark, sf_dir, "part").select(
        k.alias("movie_id"), F.lpad((k + 1).cast("string"), 7, "0").alias("imdb_id"),
        F.when(k % 9 != 0, k + 100000).alias("tmdb_id"), F.col("p_name").alias("title"),
        (1950 + k % 75).cast("int").alias("year"), F.when(k % 11 != 0, F.col("p_size") + 60).alias("runtime_minutes"),
        F.when(k % 17 != 0, pick(CODES, k)).alias("original_language"),
        F.when(k % 13 != 0, F.array_distinct(F.array(pick(LABELS, F.col("p_size")), pick(LABELS, F.col("p_size") * 3 + 1))))
        .alias("genres"),
        F.when(rated, ((k * 37) % 501).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)"))
        .cast("decimal(16,12)").alias("average_rating"),
        F.when(rated, (k * 13) % 97).alias("rating_count"),
        F.when(k % 29 == 0, F.lit("//x.jpg")).when(k % 23 != 0, F.concat(F.lit("/"), "p_type", F.lit(".jpg"))).alias("poster_path"),
        F.when(k % 31 != 0, names).alias("cast"), F.col("p_brand").alias("director"))


_G1, _G2 = sql_pick(LABELS, "p_size"), sql_pick(LABELS, "p_size * 3 + 1")
MOVIES = f"""movies AS (SELECT p_partkey AS movie_id, lpad(CAST(p_partkey + 1 AS VARCHAR), 7, '0') AS imdb_id,
  CASE WHEN p_partkey % 9 <> 0 THEN p_partkey + 100000 END AS tmdb_id, p_name AS title,
  1950 + p_partkey % 75 AS year, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) + 60 END AS runtime_minutes,
  CASE WHEN p_partkey % 17 <> 0 THEN {sql_pick(CODES, 'p_partkey')} END AS original_language,
  CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN {_G1} = {_G2} THEN [{_G1}] ELSE [{_G1}, {_G2}] END END AS genres,
  CASE WHEN p_partkey % 19 <> 0 THEN CAST((p_partkey * 37) % 501 AS DECIMAL(10, 2)) / 100 END AS average_rating,
  CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey * 13) % 97 END AS rating_count,
  CASE WHEN p_partkey % 29 = 0 THEN '//x.jpg' WHEN p_partkey % 23 <> 0 THEN '/' || p_type || '.jpg' END AS poster_path,
  CASE WHEN p_partkey % 31 <> 0 THEN list_filter(['Actor ' || (p_partkey % 50),
    CASE WHEN p_partkey % 2 = 1 THEN 'Actor ' || (50 + (p_partkey * 7) % 50) END,
    CASE WHEN p_partkey % 5 = 0 THEN 'Star ' || (p_partkey % 9) END], lambda x: x IS NOT NULL) END AS "cast",
  p_brand AS director FROM part)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(F.struct(F.lit("en").alias("language"), F.col("embedding").alias("vector")),
                   F.struct(F.lit("sr").alias("language"), F.reverse("embedding").alias("vector")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie_id"), F.explode(both).alias("v")).select(
        "movie_id", "v.*")


VECTORS = """vectors AS (SELECT vec_id AS movie_id, 'en' AS language, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings
  UNION ALL SELECT vec_id, 'sr', CAST(list_reverse(embedding) AS DOUBLE[]) FROM embeddings)"""


def unclean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with zero, null, short, NaN and null-holding ones among them."""
    k, v = F.col("movie_id") % 20, F.col("vector")
    odd = (F.when(k == 0, F.transform(v, lambda x: F.lit(0.0).cast("float"))).when(k == 1, F.lit(None).cast("array<float>"))
           .when(k == 2, F.slice(v, 1, 10)).when(k == 3, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(v, 2, 63)))
           .when(k == 4, F.concat(F.array(F.lit(None).cast("float")), F.slice(v, 2, 63))).otherwise(v))
    return vectors(spark, sf_dir).withColumn("vector", odd)


def unclean_asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the same odd query vectors."""
    k, v = F.col("query_id").cast("bigint") % 15, F.col("query_vector")
    odd = (F.when(k == 0, F.transform(v, lambda x: F.lit(0.0).cast("float"))).when(k == 1, F.lit(None).cast("array<float>"))
           .when(k == 2, F.slice(v, 1, 10)).when(k == 3, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(v, 2, 63))).otherwise(v))
    return asking(spark, sf_dir).withColumn("query_vector", odd)


# What the odd vectors leave: short ones meet only the short query vectors, which the request rules refuse.
CLEAN_VECTORS = "clean_vectors AS (SELECT * FROM vectors WHERE movie_id % 20 > 4)"
CLEAN_ASKING = "clean_asking AS (SELECT * FROM asking WHERE c_custkey % 15 > 3)"


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter row per customer."""
    c = F.col("c_custkey")
    names = lambda *xs: F.array(*xs)
    return table(spark, sf_dir, "customer").select(
        c.cast("string").alias("query_id"), F.when(c % 2 == 0, "en").otherwise("sr").alias("language"),
        F.when(c % 2 == 0, 1950 + c % 40).cast("int").alias("year_min"),
        F.when(c % 3 == 0, 1990 + c % 35).cast("int").alias("year_max"),
        F.when(c % 5 == 0, 60 + c % 30).cast("int").alias("runtime_min"),
        F.when(c % 7 == 0, 90 + c % 20).cast("int").alias("runtime_max"),
        F.when(c % 6 == 1, names(pick(LABELS, c))).alias("genres_all"),
        F.when(c % 4 == 1, names(pick(LABELS, c), pick(LABELS, c + 2))).alias("genres_any"),
        F.when(c % 5 == 2, (c % 40).cast("decimal(10,0)") / F.lit(10).cast("decimal(10,0)")).cast("decimal(28,18)").alias("rating_min"),
        F.when(c % 5 == 2, F.when(c % 2 == 0, "gt").otherwise("gte")).alias("rating_operator"),
        F.when(c % 8 == 3, pick(CODES, c)).alias("original_language"),
        F.when(c % 16 == 5, names(text("Actor ", c % 50))).alias("actors_all"),
        F.when(c % 12 == 7, names(text("Actor ", c % 50), text("Star ", c % 9))).alias("actors_any"),
        F.when(c % 9 == 4, names(text("Actor ", 50 + c % 50), text("Actor ", (c + 1) % 50))).alias("actors_exclude"),
        F.when(c % 4 != 0, F.concat("c_mktsegment", F.lit(" story"))).alias("semantic_query"))


CRITERIA = f"""criteria AS (SELECT CAST(c_custkey AS VARCHAR) AS query_id, c_custkey,
  CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'sr' END AS language,
  CASE WHEN c_custkey % 2 = 0 THEN 1950 + c_custkey % 40 END AS year_min,
  CASE WHEN c_custkey % 3 = 0 THEN 1990 + c_custkey % 35 END AS year_max,
  CASE WHEN c_custkey % 5 = 0 THEN 60 + c_custkey % 30 END AS runtime_min,
  CASE WHEN c_custkey % 7 = 0 THEN 90 + c_custkey % 20 END AS runtime_max,
  CASE WHEN c_custkey % 6 = 1 THEN [{sql_pick(LABELS, 'c_custkey')}] END AS genres_all,
  CASE WHEN c_custkey % 4 = 1 THEN [{sql_pick(LABELS, 'c_custkey')}, {sql_pick(LABELS, 'c_custkey + 2')}] END AS genres_any,
  CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey % 40 AS DECIMAL(10, 1)) / 10 END AS rating_min,
  CASE WHEN c_custkey % 5 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'gt' ELSE 'gte' END END AS rating_operator,
  CASE WHEN c_custkey % 8 = 3 THEN {sql_pick(CODES, 'c_custkey')} END AS original_language,
  CASE WHEN c_custkey % 16 = 5 THEN ['Actor ' || (c_custkey % 50)] END AS actors_all,
  CASE WHEN c_custkey % 12 = 7 THEN ['Actor ' || (c_custkey % 50), 'Star ' || (c_custkey % 9)] END AS actors_any,
  CASE WHEN c_custkey % 9 = 4 THEN ['Actor ' || (50 + c_custkey % 50), 'Actor ' || ((c_custkey + 1) % 50)] END AS actors_exclude,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment || ' story' END AS semantic_query FROM customer)"""

_BASE = """(q.year_min IS NULL OR coalesce(m.year >= q.year_min, false))
  AND (q.year_max IS NULL OR coalesce(m.year <= q.year_max, false))
  AND (q.runtime_min IS NULL OR coalesce(m.runtime_minutes >= q.runtime_min, false))
  AND (q.runtime_max IS NULL OR coalesce(m.runtime_minutes <= q.runtime_max, false))
  AND (q.genres_all IS NULL OR coalesce(list_has_all(m.genres, q.genres_all), false))
  AND (q.genres_any IS NULL OR coalesce(list_has_any(m.genres, q.genres_any), false))
  AND (q.rating_min IS NULL OR coalesce(CASE WHEN q.rating_operator = 'gt' THEN m.average_rating > q.rating_min
       ELSE m.average_rating >= q.rating_min END, false))
  AND (q.original_language IS NULL OR coalesce(m.original_language = q.original_language, false))"""
MATCH_WITHOUT_ACTORS = f"({_BASE})"
MATCH = f"""({_BASE}
  AND (q.actors_all IS NULL OR coalesce(list_has_all(m."cast", q.actors_all), false))
  AND (q.actors_any IS NULL OR coalesce(list_has_any(m."cast", q.actors_any), false))
  AND (q.actors_exclude IS NULL OR coalesce(len(m."cast") > 0 AND NOT list_has_any(m."cast", q.actors_exclude), false)))"""
ACTIVE = """(q.year_min IS NOT NULL OR q.year_max IS NOT NULL OR q.runtime_min IS NOT NULL OR q.runtime_max IS NOT NULL
  OR q.genres_all IS NOT NULL OR q.genres_any IS NOT NULL OR q.rating_min IS NOT NULL OR q.original_language IS NOT NULL
  OR q.actors_all IS NOT NULL OR q.actors_any IS NOT NULL OR q.actors_exclude IS NOT NULL)"""


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria with the query vector of the embedding that has the customer's number."""
    wanted = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"),
                                                       F.col("embedding").alias("query_vector"))
    return criteria(spark, sf_dir).join(wanted, "query_id")


ASKING = """asking AS (SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS query_vector FROM criteria c
  JOIN embeddings e ON e.vec_id = c.c_custkey)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("userId"), F.col("l_partkey").alias("movieId"),
        (F.col("l_quantity").cast("decimal(10,0)") / F.lit(10).cast("decimal(10,0)")).cast("decimal(10,3)").alias("rating"))


RATINGS = """ratings AS (SELECT l_orderkey AS user_id, l_partkey AS movie_id,
  CAST(CAST(l_quantity AS DECIMAL(10, 1)) / 10 AS DECIMAL(10, 3)) AS rating FROM lineitem)"""


def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag, score): price of a part at a supplier, as whole cents so that ties are exact."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(cents).alias("cents"))
    return sums.select(F.col("l_partkey").alias("item_id"), text("tag ", F.col("l_suppkey")).alias("tag"),
                       (F.col("cents") / 100.0).alias("score"))


TAG_SCORES = """tag_scores AS (SELECT l_partkey AS item_id, 'tag ' || l_suppkey AS tag,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2)"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per supplier tag."""
    s = F.col("s_suppkey")
    sr = F.when(s % 10 == 3, text("oznaka ", s - s % 10)).otherwise(text("oznaka ", s))
    return table(spark, sf_dir, "supplier").select(
        text("tag ", s).alias("en"), F.when(s % 14 == 5, text("oznaka ((", s)).otherwise(sr).alias("machine"), sr.alias("sr"),
        F.when(s % 6 == 0, "reviewed").when(s % 6 == 1, "review_required").otherwise("auto_pass").alias("reviewStatus"),
        (s % 12 == 0).alias("manualOverride"))


DICTIONARY = """dictionary AS (SELECT 'tag ' || s_suppkey AS en,
  CASE WHEN s_suppkey % 14 = 5 THEN 'oznaka ((' || s_suppkey
       WHEN s_suppkey % 10 = 3 THEN 'oznaka ' || (s_suppkey - s_suppkey % 10) ELSE 'oznaka ' || s_suppkey END AS machine,
  CASE WHEN s_suppkey % 10 = 3 THEN 'oznaka ' || (s_suppkey - s_suppkey % 10) ELSE 'oznaka ' || s_suppkey END AS sr,
  CASE WHEN s_suppkey % 6 = 0 THEN 'reviewed' WHEN s_suppkey % 6 = 1 THEN 'review_required' ELSE 'auto_pass' END AS status,
  s_suppkey % 12 = 0 AS manual FROM supplier)"""


def base_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base records over the movies stand-in."""
    k = F.col("movie_id")
    return movies(spark, sf_dir).select(
        k.alias("movieLensId"), F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("rawTitle"),
        "title", "year", F.col("imdb_id").alias("imdbId"),
        F.coalesce("average_rating", F.lit(0)).cast("decimal(28,18)").alias("movieLensAvgRating"),
        F.when(k % 21 != 0, F.col("director")).alias("directedByRaw"), F.array_join("cast", ", ").alias("starringRaw"))


BASE = """base AS (SELECT movie_id, title || ' (' || year || ')' AS raw_title, title, year, imdb_id,
  CASE WHEN movie_id % 21 <> 0 THEN director END AS director, array_to_string("cast", ', ') AS starring, "cast" FROM movies)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "ts", (F.col("user_id") % 3).cast("string").alias("client"),
        F.floor(F.col("value")).cast("bigint").alias("tokens"))


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """A CSV folder's text files for lines of a `part` each: the header, then the lines of that part."""
    body = lines.groupBy("part").agg(F.collect_list("value").alias("_l"))
    return body.select(F.concat(F.lit(header + "\n"), F.array_join("_l", "\n")).alias("value"))


def with_sql(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"
