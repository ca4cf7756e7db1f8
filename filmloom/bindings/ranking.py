"""Search, window and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.bindings import model as M
from filmloom.bindings.registry import query
from filmloom.functions.cast import first_occurrences
from filmloom.operators import catalog as C, dictionary as D, evaluate as E, sampling as SA, search as S
from filmloom.operators.rules import split_quarantine

_SINGLE = {"year_min": 1960, "genres_any": ["Drama", "Comedy", "Action"], "rating_min": 1}
_SINGLE_SQL = "m.year >= 1960 AND list_has_any(m.genres, ['Drama', 'Comedy', 'Action']) AND m.average_rating >= 1"
_DISTANCE = ("round(1 - list_dot_product(v.vector, q.query_vector) / (sqrt(list_dot_product(v.vector, v.vector)) * "
             "sqrt(list_dot_product(q.query_vector, q.query_vector))), 12)")


def _first_vector(spark, sf_dir):
    return M.table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


_ONE = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS query_vector FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("G1_hybrid_single", M.with_sql(M.MOVIES, M.VECTORS, _ONE) + f"""SELECT m.movie_id, m.title, round({_DISTANCE}, 6) + 0.0 AS distance
FROM movies m JOIN vectors v USING (movie_id), q WHERE v.language = 'en' AND {_SINGLE_SQL}
ORDER BY {_DISTANCE}, m.movie_id LIMIT 10""")
def hybrid_single(spark, sf_dir):
    found = S.search_hybrid(M.movies(spark, sf_dir), M.vectors(spark, sf_dir), _SINGLE, _first_vector(spark, sf_dir), "en")
    return found.select("movie_id", "title", "distance")


@query("G2_semantic_single", M.with_sql(M.MOVIES, M.VECTORS, _ONE) + f"""SELECT m.movie_id, round({_DISTANCE}, 6) + 0.0 AS distance
FROM movies m JOIN vectors v USING (movie_id), q WHERE v.language = 'sr' ORDER BY {_DISTANCE}, m.movie_id LIMIT 10""")
def semantic_single(spark, sf_dir):
    found = S.search_hybrid(M.movies(spark, sf_dir), M.vectors(spark, sf_dir), {}, _first_vector(spark, sf_dir), "sr")
    return found.select("movie_id", "distance")


@query("G3_hard_only_single", M.with_sql(M.MOVIES) + f"""SELECT movie_id, title, rating_count FROM movies m WHERE {_SINGLE_SQL}
ORDER BY rating_count DESC NULLS LAST, average_rating DESC NULLS LAST, movie_id LIMIT 10""")
def hard_only_single(spark, sf_dir):
    return S.search_hard_only(M.movies(spark, sf_dir), _SINGLE).select("movie_id", "title", "rating_count")


_RANKED_NEAR = f"""near AS (SELECT q.query_id, m.movie_id, {_DISTANCE} AS d, row_number() OVER (PARTITION BY q.query_id
  ORDER BY {_DISTANCE}, m.movie_id) AS rank FROM asking q JOIN vectors v ON v.language = q.language
  JOIN movies m USING (movie_id) WHERE {M.MATCH} QUALIFY rank <= 10)"""
_RANKED_HARD = f"""hard AS (SELECT q.query_id, m.movie_id, row_number() OVER (PARTITION BY q.query_id ORDER BY
  m.rating_count DESC NULLS LAST, m.average_rating DESC NULLS LAST, m.movie_id) AS rank FROM criteria q, movies m
  WHERE {M.ACTIVE} AND {M.MATCH} QUALIFY rank <= 10)"""


def _serving(spark, sf_dir):
    return S.serving_table(M.movies(spark, sf_dir), M.vectors(spark, sf_dir))


@query("N11_batch_hybrid", M.with_sql(M.MOVIES, M.VECTORS, M.CRITERIA, M.ASKING, _RANKED_NEAR)
       + "SELECT query_id, rank, movie_id, round(d, 6) + 0.0 AS distance FROM near")
def batch_hybrid(spark, sf_dir):
    return S.batch_hybrid(_serving(spark, sf_dir), M.asking(spark, sf_dir))


_CLEAN_NEAR = f"""near AS (SELECT q.query_id, m.movie_id, {_DISTANCE} AS d, row_number() OVER (PARTITION BY q.query_id
  ORDER BY {_DISTANCE}, m.movie_id) AS rank FROM {{}} q JOIN clean_vectors v ON v.language = q.language
  JOIN movies m USING (movie_id) WHERE {M.MATCH} QUALIFY rank <= 10)"""


@query("N11_unclean_vectors", M.with_sql(M.MOVIES, M.VECTORS, M.CRITERIA, M.ASKING, M.CLEAN_VECTORS, M.CLEAN_ASKING, _CLEAN_NEAR.format("clean_asking"))
       + "SELECT query_id, rank, movie_id, round(d, 6) + 0.0 AS distance FROM near")
def unclean_vectors(spark, sf_dir):
    """Zero, null, short and not finite vectors on both sides: full lists for all that can be compared."""
    asking = M.unclean_asking(spark, sf_dir)
    movies = S.serving_table(M.movies(spark, sf_dir), M.unclean_vectors(spark, sf_dir))
    return S.batch_hybrid(movies, asking.where(S.can_ask(64)))


@query("N11_unusable_vectors", "SELECT vec_id AS movie_id, language FROM embeddings, (SELECT unnest(['en', 'sr']) AS language) WHERE vec_id % 20 <= 4")
def unusable_vectors(spark, sf_dir):
    return S.unusable_vectors(M.unclean_vectors(spark, sf_dir), 64)


@query("G3_batch_hard_only", M.with_sql(M.MOVIES, M.CRITERIA, _RANKED_HARD) + "SELECT query_id, rank, movie_id FROM hard")
def batch_hard_only(spark, sf_dir):
    return S.batch_hard_only(M.movies(spark, sf_dir), M.criteria(spark, sf_dir))


_ROUTED = M.with_sql(M.MOVIES, M.VECTORS, M.CRITERIA, M.ASKING, _RANKED_NEAR.replace("WHERE", "WHERE q.semantic_query IS NOT NULL AND", 1),
                     _RANKED_HARD.replace("FROM criteria q", "FROM asking q").replace("WHERE", "WHERE q.semantic_query IS NULL AND", 1))


@query("G4_routed", _ROUTED + """SELECT query_id, 'hard_only' AS route, rank, movie_id, CAST(NULL AS DOUBLE) AS distance FROM hard
UNION ALL SELECT query_id, 'hybrid', rank, movie_id, round(d, 6) + 0.0 FROM near""")
def routed(spark, sf_dir):
    return S.recommend(M.movies(spark, sf_dir), _serving(spark, sf_dir), M.asking(spark, sf_dir))


@query("G5_result_guard", _ROUTED + """, found AS (SELECT query_id, movie_id FROM hard UNION ALL SELECT query_id, movie_id FROM near)
SELECT query_id, count(*) AS "rows", count(DISTINCT movie_id) AS ids, count(*) <= 10 AND count(DISTINCT movie_id) = count(*) AS ok
FROM found GROUP BY query_id""")
def result_guard(spark, sf_dir):
    return S.result_guard(S.recommend(M.movies(spark, sf_dir), _serving(spark, sf_dir), M.asking(spark, sf_dir)))


@query("G6_review_sample", M.with_sql(M.MOVIES) + """SELECT movie_id FROM movies WHERE movie_id IN (1, 32, 264)
UNION (SELECT movie_id FROM movies WHERE list_has_all("cast", ['Actor 5', 'Star 4']) ORDER BY movie_id LIMIT 1)
UNION (SELECT movie_id FROM movies WHERE "cast" IS NULL ORDER BY movie_id LIMIT 1)
UNION (SELECT movie_id FROM movies ORDER BY movie_id LIMIT 3)""")
def review_sample(spark, sf_dir):
    return SA.review_sample(M.movies(spark, sf_dir), [1, 32, 264], ("Actor 5", "Star 4"))


@query("G7_canonical_sort", M.with_sql(M.MOVIES) + """SELECT DISTINCT unnest("cast") AS name FROM movies ORDER BY name""")
def canonical_sort(spark, sf_dir):
    return M.movies(spark, sf_dir).select(F.explode("cast").alias("name")).distinct().orderBy("name")


@query("G1_query_vector_rules", """SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
  AND len(embedding) = 64 AND vec_id % 3 <> 0 AS usable FROM embeddings""")
def query_vector_rules(spark, sf_dir):
    """Every third vector is cut short, which the rule must find."""
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    rows = M.table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("query_vector"))
    return rows.select("vec_id", S.query_vector_rules(64)[0].ok.alias("usable"))


@query("W1_top_tags", M.with_sql(M.TAG_SCORES) + """SELECT item_id AS movie_id, pos, tag, score FROM (SELECT *, row_number()
  OVER (PARTITION BY item_id ORDER BY score DESC, tag) AS pos FROM tag_scores) WHERE pos <= 10""")
def top_tags(spark, sf_dir):
    tags = C.top_tags(M.tag_scores(spark, sf_dir).withColumnRenamed("item_id", "movie_id"), "movie_id")
    rows = tags.select("movie_id", F.posexplode("relevantTags").alias("i", "t"))
    return rows.select("movie_id", (F.col("i") + 1).alias("pos"), F.col("t.name").alias("tag"), F.col("t.score").alias("score"))


@query("W2_stratified_sample", M.with_sql(M.MOVIES) + """, keyed AS (SELECT movie_id, CASE WHEN year < 1960 THEN '0-pre1960'
  WHEN year <= 1979 THEN '1-1960-1979' WHEN year <= 1999 THEN '2-1980-1999' WHEN year <= 2009 THEN '3-2000-2009' ELSE '4-2010plus' END
  || '|' || coalesce(list_sort(genres)[1], '') AS stratum FROM movies), ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum
  ORDER BY sha256('sample-v1|' || movie_id), movie_id) AS round FROM keyed)
SELECT movie_id, stratum, round FROM ranked ORDER BY round, stratum LIMIT 150""")
def stratified_sample(spark, sf_dir):
    return SA.stratified_sample(M.movies(spark, sf_dir), 150, "sample-v1")


@query("W3_first_contexts", M.with_sql(M.TAG_SCORES) + """SELECT tag, item_id AS movie_id, context FROM (SELECT DISTINCT tag, item_id,
  row_number() OVER (PARTITION BY tag ORDER BY item_id) AS context FROM tag_scores) WHERE context <= 3""")
def first_contexts(spark, sf_dir):
    """All supplier tags count as flagged here; titles and other tags are shown by N15."""
    scores = M.tag_scores(spark, sf_dir)
    tagged = scores.select(F.col("item_id").alias("movieLensId"), F.array("tag").alias("tags"), F.lit("").alias("title"))
    contexts = C.review_contexts(scores.select("tag"), tagged)
    return contexts.select("tag", F.col("movieLensId").alias("movie_id"), "context").distinct()


@query("W4_rank_in_list", "SELECT CAST(label AS BIGINT) AS query_id, vec_id AS movie_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank "
       "FROM embeddings QUALIFY rank <= 10")
def rank_in_list(spark, sf_dir):
    """Lists of ten: the first vectors of each label."""
    rows = M.table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("movie_id"),
                                                       F.lit("semantic").alias("mode"))
    return E.ranked(rows, [F.asc("movie_id")]).where("rank <= 10").select("query_id", "movie_id", "rank")


_JUDGED = """judged AS (SELECT d.source AS query_id, d.doc_id AS movie_id, l.quality * 2 + (1 - l.toxic) AS score
  FROM documents d JOIN labels l USING (doc_id))"""


def judgments(spark, sf_dir):
    docs, labels = M.table(spark, sf_dir, "documents"), M.table(spark, sf_dir, "labels")
    score = F.col("quality") * 2 + (1 - F.col("toxic"))
    return docs.join(labels, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("movie_id"),
                                              score.alias("score"))


@query("W5_ideal_gain", M.with_sql(_JUDGED) + """SELECT query_id, round(sum((pow(2, score) - 1) / log2(r + 1)), 6) AS ideal FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS r FROM judged) WHERE r <= 10 GROUP BY 1""")
def ideal_gain(spark, sf_dir):
    return E.ideal_gain(judgments(spark, sf_dir))


@query("W6_first_occurrence", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY 1, 2)
SELECT doc_id, md5(string_agg(x, '|' ORDER BY i)) AS names, count(*) AS kept FROM f GROUP BY 1""")
def first_occurrence(spark, sf_dir):
    """Each word of whole texts where it occurs first, by the rule that removes repeats from a cast."""
    texts = M.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    kept = texts.select("doc_id", first_occurrences(F.col("words")).alias("names"))
    return kept.select("doc_id", F.md5(F.array_join("names", "|")).alias("names"), F.size("names").alias("kept"))


_PROPOSALS = """proposals AS (SELECT 'key ' || (event_id % 500) AS en, 'text ' || user_id AS machine, event_id AS seq,
  event_type <> 'error' AS completed FROM events)"""


def proposals(spark, sf_dir):
    e = F.col("event_id")
    return M.table(spark, sf_dir, "events").select(
        M.text("key ", e % 500).alias("en"), M.text("text ", F.col("user_id")).alias("machine"),
        M.text("tekst ", F.col("user_id")).alias("sr"), e.alias("seq"), (F.col("event_type") != "error").alias("completed"),
        F.when(F.col("event_type") == "error", "incomplete").alias("error"))


@query("W8_last_valid", M.with_sql(_PROPOSALS) + """SELECT en, arg_max(machine, seq) AS machine FROM proposals WHERE completed GROUP BY en""")
def last_valid(spark, sf_dir):
    return D.last_valid(proposals(spark, sf_dir)).select("en", "machine")


_A = "a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10)"
_B = "b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45)"


def _key_sets(spark, sf_dir):
    lines = M.table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey").alias("k")
    return (lines.where("l_returnflag = 'R' AND l_quantity < 10").select(k),
            lines.where("l_linestatus = 'F' AND l_quantity > 45").select(k))


@query("S1_key_set_equality", M.with_sql(_A, _B) + """SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_set_equality(spark, sf_dir):
    return D.key_differences(*_key_sets(spark, sf_dir), "k")


@query("S2_key_difference", M.with_sql(_A, _B) + "SELECT k FROM a EXCEPT SELECT k FROM b")
def key_difference(spark, sf_dir):
    return D.key_difference(*_key_sets(spark, sf_dir), "k")


@query("S3_key_intersection", M.with_sql(_A, _B) + "SELECT k FROM a INTERSECT SELECT k FROM b")
def key_intersection(spark, sf_dir):
    return D.key_intersection(*_key_sets(spark, sf_dir), "k")


@query("S4_key_union", M.with_sql(_A, _B) + "SELECT k FROM a UNION SELECT k FROM b")
def key_union(spark, sf_dir):
    return D.key_union(*_key_sets(spark, sf_dir))


@query("J1_quarantine", M.with_sql(M.MOVIES) + """SELECT movie_id, CASE WHEN "cast" IS NULL THEN 'cast' ELSE '' END ||
  CASE WHEN runtime_minutes IS NULL THEN CASE WHEN "cast" IS NULL THEN '|runtime' ELSE 'runtime' END ELSE '' END AS failed_rules
  FROM movies WHERE "cast" IS NULL OR runtime_minutes IS NULL""")
def quarantine(spark, sf_dir):
    from filmloom.operators.rules import Rule
    rules = [Rule("cast", F.col("cast").isNotNull()), Rule("runtime", F.col("runtime_minutes") > 0)]
    return split_quarantine(M.movies(spark, sf_dir), rules)[1].select("movie_id", "failed_rules")
