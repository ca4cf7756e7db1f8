"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom import vocab
from filmloom.bindings import model as M
from filmloom.bindings.registry import query
from filmloom.operators import filters as FL
from filmloom.operators.actors import registry_rules, vocabulary
from filmloom.operators.rules import with_failures

_IDS = M.with_sql(M.MOVIES) + "SELECT movie_id FROM movies WHERE "


def _literal(name: str, criteria: dict, condition: str) -> None:
    @query(name, _IDS + condition)
    def run(spark, sf_dir):
        return FL.filter_movies(M.movies(spark, sf_dir), criteria).select("movie_id")


_literal("F1_year_min", {"year_min": 2000}, "year >= 2000")
_literal("F2_year_max", {"year_max": 1975}, "year <= 1975")
_literal("F3_runtime_min", {"runtime_min": 100}, "runtime_minutes >= 100")
_literal("F4_runtime_max", {"runtime_max": 70}, "runtime_minutes <= 70")
_literal("F5_genres_all", {"genres_all": ["Drama", "Comedy"]}, "list_has_all(genres, ['Drama', 'Comedy'])")
_literal("F6_genres_any", {"genres_any": ["Horror", "Action"]}, "list_has_any(genres, ['Horror', 'Action'])")
_literal("F7_rating_gte", {"rating_min": 4, "rating_operator": "gte"}, "average_rating >= 4")
_literal("F7_rating_gt", {"rating_min": 4, "rating_operator": "gt"}, "average_rating > 4")
_literal("F8_original_language", {"original_language": "ja"}, "original_language = 'ja'")
_literal("F10_actors_all", {"actors_all": ["Actor 10", "Star 1"]}, "list_has_all(\"cast\", ['Actor 10', 'Star 1'])")
_literal("F11_actors_any", {"actors_any": ["Actor 3", "Star 4"]}, "list_has_any(\"cast\", ['Actor 3', 'Star 4'])")
_literal("F12_actors_exclude", {"actors_exclude": ["Actor 3", "Star 4"]},
         "len(\"cast\") > 0 AND NOT list_has_any(\"cast\", ['Actor 3', 'Star 4'])")
_literal("F13_conjunction", {"year_min": 1960, "year_max": 2015, "runtime_min": 65, "genres_any": ["Drama", "Comedy"],
                             "rating_min": 2, "original_language": "en", "actors_exclude": ["Actor 6"]},
         "year BETWEEN 1960 AND 2015 AND runtime_minutes >= 65 AND list_has_any(genres, ['Drama', 'Comedy']) "
         "AND average_rating >= 2 AND original_language = 'en' AND len(\"cast\") > 0 AND NOT list_has_any(\"cast\", ['Actor 6'])")


@query("F9_cast_known", _IDS + '"cast" IS NOT NULL AND len("cast") > 0')
def cast_known(spark, sf_dir):
    """An exclusion of nobody still asks for a known cast."""
    return FL.filter_movies(M.movies(spark, sf_dir), {"actors_exclude": [""]}).select("movie_id")


@query("F14_criteria_validity", M.with_sql(M.CRITERIA) + """, odd AS (SELECT query_id,
  CASE WHEN c_custkey % 50 = 0 THEN 999 ELSE year_min END AS year_min, year_max, runtime_min,
  CASE WHEN c_custkey % 35 = 0 THEN 0 ELSE runtime_max END AS runtime_max, rating_min,
  CASE WHEN c_custkey % 30 = 1 THEN 'gte' ELSE rating_operator END AS rating_operator,
  CASE WHEN c_custkey % 40 = 3 THEN 'cn' ELSE original_language END AS original_language,
  CASE WHEN c_custkey % 45 = 4 THEN actors_exclude ELSE actors_all END AS actors_all, actors_exclude FROM criteria)
SELECT query_id, array_to_string(list_filter([
  CASE WHEN year_min NOT BETWEEN 1000 AND 9999 THEN 'year_min' END,
  CASE WHEN year_min > year_max THEN 'year_order' END,
  CASE WHEN runtime_max < 1 THEN 'runtime_max' END,
  CASE WHEN runtime_min > runtime_max THEN 'runtime_order' END,
  CASE WHEN rating_operator IS NOT NULL AND rating_min IS NULL THEN 'rating_operator' END,
  CASE WHEN original_language = 'cn' THEN 'original_language' END,
  CASE WHEN coalesce(list_has_any(actors_all, actors_exclude), false) THEN 'actors_contradiction' END],
  lambda x: x IS NOT NULL), '|') AS failed FROM odd""")
def criteria_validity(spark, sf_dir):
    c = F.col("query_id").cast("bigint")
    odd = M.criteria(spark, sf_dir).withColumns({
        "year_min": F.when(c % 50 == 0, 999).otherwise(F.col("year_min")),
        "runtime_max": F.when(c % 35 == 0, 0).otherwise(F.col("runtime_max")),
        "rating_operator": F.when(c % 30 == 1, "gte").otherwise(F.col("rating_operator")),
        "original_language": F.when(c % 40 == 3, "cn").otherwise(F.col("original_language")),
        "actors_all": F.when(c % 45 == 4, F.col("actors_exclude")).otherwise(F.col("actors_all"))})
    return with_failures(odd, FL.criteria_rules(), "failed").select("query_id", "failed")


@query("F15_unknown_actors", M.with_sql(M.MOVIES, M.CRITERIA) + """, names AS (
  SELECT DISTINCT unnest("cast") AS name FROM movies), asked AS (
  SELECT query_id, unnest(list_concat(list_concat(coalesce(actors_all, []), coalesce(actors_any, [])),
    coalesce(actors_exclude, []))) AS name FROM criteria)
SELECT DISTINCT query_id, name FROM asked WHERE name NOT IN (SELECT name FROM names)""")
def unknown_actors(spark, sf_dir):
    names = vocabulary(M.movies(spark, sf_dir))
    return FL.unknown_actors(M.criteria(spark, sf_dir), names)


@query("F15_registry_rules", """SELECT doc_id, NOT (doc_id % 8 IN (1, 2, 3)) AS ok FROM documents""")
def registry_names(spark, sf_dir):
    """Names with a space around them, with a control character, and not composed."""
    k = F.col("doc_id")
    name = (F.when(k % 8 == 1, F.lit(" Uma Berg")).when(k % 8 == 2, F.lit("Uma\u0007Berg")).when(k % 8 == 3, F.lit("Nu\u0301ria"))
            .otherwise(F.concat(F.lit("N\u00faria "), k.cast("string"))))
    rows = M.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", registry_rules()[0].ok.alias("ok"))


@query("F16_applicable_modes", M.with_sql(M.CRITERIA) + f""", modes AS (SELECT unnest({M.sql_list(vocab.EVALUATION_MODES)}) AS mode)
SELECT query_id, mode FROM criteria q CROSS JOIN modes WHERE CASE mode WHEN 'structured' THEN {M.ACTIVE}
  WHEN 'semantic' THEN semantic_query IS NOT NULL ELSE {M.ACTIVE} AND semantic_query IS NOT NULL END""")
def applicable_modes(spark, sf_dir):
    modes = F.explode(F.array(*map(F.lit, vocab.EVALUATION_MODES)))
    rows = M.criteria(spark, sf_dir).withColumn("mode", modes)
    return rows.where(FL.applicable_mode(F.col("mode"), F.col("semantic_query"))).select("query_id", "mode")


@query("F17_by_ids", M.with_sql(M.MOVIES) + "SELECT movie_id, title FROM movies WHERE movie_id IN (SELECT vec_id FROM embeddings)")
def by_ids(spark, sf_dir):
    ids = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie_id"))
    return FL.by_ids(M.movies(spark, sf_dir), ids).select("movie_id", "title")


@query("F18_compliance_predicate", M.with_sql(M.MOVIES, M.CRITERIA) + f"""
SELECT m.movie_id, q.query_id, {M.MATCH_WITHOUT_ACTORS} AS complies FROM movies m JOIN criteria q ON q.c_custkey = m.movie_id""")
def compliance_predicate(spark, sf_dir):
    """One criteria row per movie, so the table of pairs is as long as the customer table."""
    pairs = M.criteria(spark, sf_dir).drop("language").withColumnRenamed("original_language", "wanted_language").join(
        M.movies(spark, sf_dir), F.col("query_id").cast("bigint") == F.col("movie_id"))
    operands = {f: F.col("wanted_language" if f == "original_language" else f) for f in FL.FIELDS}
    return pairs.select("movie_id", "query_id", FL.complies(operands).alias("complies"))


@query("F19_result_card", M.with_sql(M.MOVIES) + """SELECT movie_id, title, year,
  'https://www.imdb.com/title/tt' || imdb_id || '/' AS imdb_url,
  CASE WHEN poster_path NOT LIKE '//%' THEN 'https://image.tmdb.org/t/p/w500' || poster_path END AS poster_url FROM movies""")
def result_card(spark, sf_dir):
    return FL.result_card(M.movies(spark, sf_dir))
