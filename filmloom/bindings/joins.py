"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.bindings import functions as FN, model as M
from filmloom.bindings.ranking import _JUDGED, judgments
from filmloom.bindings.registry import query
from filmloom.functions.cast import event_inventory, with_cast
from filmloom.operators import actors as AC, catalog as C, dictionary as D, embedding as EM, evaluate as E, release as R
from filmloom.operators import search as S
from filmloom.operators.rules import duplicate_report


def _scored(spark, sf_dir):
    return M.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"))


def _metadata(spark, sf_dir):
    """Metadata of every part but each tenth."""
    p = M.movies(spark, sf_dir).where("movie_id % 10 <> 0")
    return p.select(F.col("movie_id").alias("item_id"), F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("title"),
                    F.col("imdb_id").alias("imdbId"), F.coalesce("average_rating", F.lit(0)).cast("decimal(28,18)").alias("avgRating"),
                    F.col("director").alias("directedBy"), F.lit(" ").alias("starring"))


@query("N1_scored_with_metadata", M.with_sql(M.MOVIES) + """SELECT movie_id, title, year, director FROM movies
  WHERE movie_id % 10 <> 0 AND movie_id IN (SELECT l_partkey FROM lineitem)""")
def scored_with_metadata(spark, sf_dir):
    base = C.base_movies(_scored(spark, sf_dir), _metadata(spark, sf_dir))
    return base.select(F.col("movieLensId").alias("movie_id"), "title", "year", F.col("directedByRaw").alias("director"))


@query("N1_missing_metadata", """SELECT DISTINCT l_partkey AS movie_id, 'MISSING_METADATA' AS reason FROM lineitem WHERE l_partkey % 10 = 0""")
def missing_metadata(spark, sf_dir):
    return C.missing_metadata(_scored(spark, sf_dir), _metadata(spark, sf_dir)).withColumnRenamed("movieLensId", "movie_id")


@query("N2_membership", """SELECT l_partkey AS movie_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings)""")
def membership(spark, sf_dir):
    rows = M.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("movie_id"), "l_orderkey", "l_linenumber")
    return C.keep_members(rows, M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie_id")), "movie_id")


def _links(spark, sf_dir):
    """Links of every part but each eighth; each fiftieth names another imdb id."""
    k = F.col("movie_id")
    return M.movies(spark, sf_dir).where(k % 8 != 0).select(
        k.alias("movieId"), F.when(k % 50 == 1, F.lit("42")).otherwise((k + 1).cast("string")).alias("imdbId"),
        F.col("tmdb_id").cast("int").alias("tmdbId"))


def _genre_rows(spark, sf_dir):
    return M.movies(spark, sf_dir).where("movie_id % 8 <> 0 AND movie_id % 60 <> 7").select(F.col("movie_id").alias("movieId"), "genres")


_MATCHED = "movie_id % 8 <> 0"


@query("N3_link_identity", M.with_sql(M.MOVIES) + f"""SELECT movie_id, CASE WHEN {_MATCHED} THEN tmdb_id END AS tmdb_id, {_MATCHED} AS matched,
  NOT ({_MATCHED} AND movie_id % 50 = 1 AND movie_id <> 41) AS imdb_ok FROM movies""")
def link_identity(spark, sf_dir):
    linked = C.link_movies(M.base_movies(spark, sf_dir), _links(spark, sf_dir))
    return linked.select(F.col("movieLensId").alias("movie_id"), F.col("tmdbId").alias("tmdb_id"), "matched", "imdb_ok")


@query("N4_genre_rows", M.with_sql(M.MOVIES) + f"""SELECT movie_id, CASE WHEN {_MATCHED} AND movie_id % 60 <> 7 THEN array_to_string(genres, '|') END AS genres,
  NOT ({_MATCHED} AND movie_id % 60 = 7) AS ok FROM movies""")
def genre_rows(spark, sf_dir):
    rows = C.attach_genres(C.link_movies(M.base_movies(spark, sf_dir), _links(spark, sf_dir)), _genre_rows(spark, sf_dir))
    return rows.select(F.col("movieLensId").alias("movie_id"), "genres", F.col("genre_row_ok").alias("ok"))


_AGG = "agg AS (SELECT movie_id, count(*) AS n, sum(rating) AS s FROM ratings GROUP BY 1)"


def _few_ratings(spark, sf_dir):
    return M.ratings(spark, sf_dir).where("movieId % 3 <> 0")


@query("N5_attach_ratings", M.with_sql(M.MOVIES, M.RATINGS, _AGG) + f"""SELECT m.movie_id, CASE WHEN {_MATCHED.replace('movie_id', 'm.movie_id')}
  THEN coalesce(n, 0) END AS rating_count, CASE WHEN {_MATCHED.replace('movie_id', 'm.movie_id')} THEN round(CAST(s AS DOUBLE) / n, 6) END AS average
  FROM movies m LEFT JOIN agg a ON a.movie_id = m.movie_id AND m.movie_id % 3 <> 0""")
def attach_ratings(spark, sf_dir):
    linked = C.link_movies(M.base_movies(spark, sf_dir), _links(spark, sf_dir))
    rows = C.attach_ratings(linked, C.rating_aggregates(_few_ratings(spark, sf_dir)))
    return rows.select(F.col("movieLensId").alias("movie_id"), F.col("ratingCount").alias("rating_count"), F.col("averageRating").alias("average"))


def details(spark, sf_dir):
    """Detail cache of every part but each seventh."""
    return M.movies(spark, sf_dir).where("tmdb_id IS NOT NULL AND movie_id % 7 <> 0").select(
        F.col("tmdb_id").cast("int").alias("tmdbId"), F.col("runtime_minutes").cast("int").alias("runtimeMinutes"),
        F.col("original_language").alias("originalLanguage"), F.col("poster_path").alias("posterPath"))


@query("N6_attach_details", M.with_sql(M.MOVIES) + f"""SELECT movie_id, CASE WHEN ok THEN runtime_minutes END AS runtime, CASE WHEN ok THEN original_language END AS language,
  CASE WHEN ok THEN poster_path END AS poster FROM (SELECT *, {_MATCHED} AND tmdb_id IS NOT NULL AND movie_id % 7 <> 0 AS ok FROM movies)""")
def attach_details(spark, sf_dir):
    linked = C.link_movies(M.base_movies(spark, sf_dir), _links(spark, sf_dir))
    rows = C.attach_details(linked, details(spark, sf_dir))
    return rows.select(F.col("movieLensId").alias("movie_id"), F.col("runtimeMinutes").alias("runtime"),
                       F.col("originalLanguage").alias("language"), F.col("posterPath").alias("poster"))


@query("N7_pending_details", M.with_sql(M.MOVIES) + "SELECT tmdb_id FROM movies WHERE tmdb_id IS NOT NULL AND (movie_id % 7 = 0 OR movie_id % 100 = 3)")
def pending_details(spark, sf_dir):
    eligible = M.movies(spark, sf_dir).select(F.col("tmdb_id").cast("int").alias("tmdbId"), "movie_id")
    refresh = eligible.where("movie_id % 100 = 3").select("tmdbId")
    return C.pending_details(eligible, details(spark, sf_dir), refresh).select(F.col("tmdbId").alias("tmdb_id"))


def _enriched(spark, sf_dir):
    return C.enriched_movies(M.base_movies(spark, sf_dir), _links(spark, sf_dir), _genre_rows(spark, sf_dir),
                             _few_ratings(spark, sf_dir), details(spark, sf_dir))


@query("N8_catalog_merge", M.with_sql(M.MOVIES, M.BASE, M.TAG_SCORES, FN._TOP, M.RATINGS, _AGG) + f"""SELECT b.movie_id, b.title, coalesce(t.tags, 0) AS tags,
  CASE WHEN {_MATCHED.replace('movie_id', 'b.movie_id')} THEN coalesce(n, 0) END AS rating_count
  FROM base b LEFT JOIN (SELECT item_id, count(*) AS tags FROM top GROUP BY 1) t ON t.item_id = b.movie_id
  LEFT JOIN agg a ON a.movie_id = b.movie_id AND b.movie_id % 3 <> 0 WHERE b.movie_id % 30 <> 4""")
def catalog_merge(spark, sf_dir):
    """Enriched rows of each thirtieth movie carry another title and must be refused."""
    enriched = _enriched(spark, sf_dir).withColumn("title", F.when(F.col("movieLensId") % 30 == 4, F.lit("?")).otherwise(F.col("title")))
    catalog, _ = C.merge_catalog(FN.semantic(spark, sf_dir), enriched)
    return catalog.select(F.col("movieLensId").alias("movie_id"), "title", F.size("relevantTags").alias("tags"), F.col("ratingCount").alias("rating_count"))


@query("N8_merge_mismatches", M.with_sql(M.MOVIES) + "SELECT movie_id, 'title' AS differing FROM movies WHERE movie_id % 30 = 4")
def merge_mismatches(spark, sf_dir):
    base = M.base_movies(spark, sf_dir)
    enriched = _enriched(spark, sf_dir).withColumn("title", F.when(F.col("movieLensId") % 30 == 4, F.lit("?")).otherwise(F.col("title")))
    none = F.array().cast("array<struct<name:string,score:double>>")
    semantic = base.withColumn("relevantTags", none).withColumn("semanticText", F.lit(""))
    return C.merge_catalog(semantic, enriched)[1].select(F.col("movieLensId").alias("movie_id"), "differing")


@query("N9_translate_tags", M.with_sql(M.TAG_SCORES, M.DICTIONARY) + """SELECT item_id AS movie_id, coalesce(string_agg(CASE WHEN tag NOT LIKE '%7' THEN sr END, '|' ORDER BY score DESC, tag), '') AS tags_sr,
  count(*) FILTER (WHERE tag LIKE '%7') AS missing FROM tag_scores LEFT JOIN dictionary ON en = tag GROUP BY 1""")
def translate_tags(spark, sf_dir):
    """All tags of a part in score order, whatever their number; tags that end in 7 have no translation."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "tag")))
    lists = M.tag_scores(spark, sf_dir).groupBy(F.col("item_id").alias("movie_id")).agg(ordered.alias("listed"))
    named = lists.select("movie_id", F.transform("listed", lambda t: t["tag"]).alias("tags"))
    out = C.translate_tags(named, M.dictionary(spark, sf_dir).where("en NOT LIKE '%7'"), "movie_id")
    return out.select("movie_id", F.col("tagsSr").alias("tags_sr"), "missing")


@query("N10_language_vectors", M.with_sql(M.MOVIES, M.VECTORS) + """SELECT movie_id, title, round(vector[1], 6) AS first_value FROM movies JOIN vectors USING (movie_id) WHERE language = 'sr'""")
def language_vectors(spark, sf_dir):
    rows = S.serving_table(M.movies(spark, sf_dir), M.vectors(spark, sf_dir)).where("language = 'sr'")
    titles = M.movies(spark, sf_dir).select("movie_id", "title")
    return rows.join(titles, "movie_id").select("movie_id", "title", F.get("vector", F.lit(0)).alias("first_value"))


def results(spark, sf_dir):
    """Result lists: the first ten documents of each source, judged where labels exist."""
    docs = M.table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.lit("semantic").alias("mode"), F.col("doc_id").alias("movie_id"), "n_chars")
    return E.ranked(docs, [F.desc("n_chars"), F.asc("movie_id")]).where("rank <= 10").drop("n_chars")


_RESULTS = """results AS (SELECT source AS query_id, doc_id AS movie_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents QUALIFY rank <= 10)"""


@query("N12_results_with_judgments", M.with_sql(_JUDGED, _RESULTS) + "SELECT r.query_id, r.movie_id, rank, CAST(coalesce(score, -1) AS BIGINT) AS score FROM results r LEFT JOIN judged j USING (query_id, movie_id)")
def results_with_judgments(spark, sf_dir):
    rows = E.with_scores(results(spark, sf_dir), judgments(spark, sf_dir))
    return rows.select("query_id", "movie_id", "rank", F.coalesce("score", F.lit(-1)).alias("score"))


@query("N13_results_with_metadata", M.with_sql(M.MOVIES, _RESULTS) + "SELECT query_id, r.movie_id, m.movie_id IS NOT NULL AS known, year FROM results r LEFT JOIN movies m USING (movie_id)")
def results_with_metadata(spark, sf_dir):
    return E.with_metadata(results(spark, sf_dir), M.movies(spark, sf_dir), ["year"]).select("query_id", "movie_id", "known", "year")


def _texts(spark, sf_dir, edited: bool):
    """Documents as texts to embed; in the edited version each sixth one has changed."""
    d = M.table(spark, sf_dir, "documents")
    text = F.when((F.col("doc_id") % 6 == 0) & F.lit(edited), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("movie_id"), F.lit("en").alias("language"), text.alias("text"))


def _prior(spark, sf_dir):
    """Vectors of an earlier run over all documents but each fifth."""
    old = EM.expected_vectors(_texts(spark, sf_dir, False).where("movie_id % 5 <> 0"), "profile-1")
    return EM.stand_in_vectors(old, 16).select("movie_id", "language", "fingerprint", "text_sha256", "vector")


@query("N14_vector_reuse", """SELECT doc_id AS movie_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 6 <> 0 THEN 'kept' ELSE 'pending' END AS state FROM documents""")
def vector_reuse(spark, sf_dir):
    wanted = EM.expected_vectors(_texts(spark, sf_dir, True), "profile-1")
    matched = EM.match_prior(_prior(spark, sf_dir), wanted, 16)
    return matched.select("movie_id", F.when(F.col("vector").isNotNull(), "kept").otherwise("pending").alias("state"))


@query("N15_review_contexts", M.with_sql(M.TAG_SCORES, FN._TOP) + """, listed AS (SELECT item_id, list(tag ORDER BY pos) AS tags FROM top GROUP BY 1),
  first AS (SELECT tag, item_id, row_number() OVER (PARTITION BY tag ORDER BY item_id) AS context FROM top WHERE tag LIKE '%3' QUALIFY context <= 3)
SELECT tag, item_id AS movie_id, context, array_to_string(list_filter(tags, lambda t: t <> tag), '|') AS other_tags FROM first JOIN listed USING (item_id)""")
def review_contexts(spark, sf_dir):
    rows = FN.semantic(spark, sf_dir).select("movieLensId", "title", F.transform("relevantTags", lambda t: t["name"]).alias("tags"))
    flagged = M.dictionary(spark, sf_dir).where("en LIKE '%3'").select(F.col("en").alias("tag"))
    return C.review_contexts(flagged, rows).select("tag", F.col("movieLensId").alias("movie_id"), "context", "other_tags")


@query("N16_proper_name_risks", """SELECT upper(c_mktsegment) || c_custkey AS en FROM customer WHERE FALSE
UNION ALL SELECT DISTINCT en FROM (SELECT lower(p_name) AS en, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE 'ime' END AS machine FROM part) WHERE machine = 'ime'""")
def proper_name_risks(spark, sf_dir):
    """Part names are titles; every second translation keeps the name up to case and blanks."""
    k = F.col("movie_id")
    movies = M.base_movies(spark, sf_dir)
    kept = F.concat(F.lit(" "), F.upper("title"))
    entries = M.movies(spark, sf_dir).select(F.lower("title").alias("en"), F.when(k % 2 == 0, kept).otherwise(F.lit("ime")).alias("machine"),
                                             F.when(k % 2 == 0, F.replace(F.col("title"), F.lit(" "), F.lit(""))).otherwise(F.lit("ime")).alias("sr"))
    return D.proper_name_risks(entries, movies).select("en").distinct()


_KEYS = "SELECT 'tag ' || s_suppkey AS en, s_suppkey AS s FROM supplier"


@query("N17_dictionary_coverage", f"""SELECT en, CASE WHEN s % 10 = 1 THEN 'baseline and proposals overlap' WHEN s % 10 = 9 THEN 'not covered' ELSE 'candidate differs from source' END AS problem
  FROM ({_KEYS}) WHERE s % 10 IN (1, 9) OR s % 10 = 5""")
def dictionary_coverage(spark, sf_dir):
    s = F.col("s_suppkey") % 10
    keys = M.table(spark, sf_dir, "supplier").select("s_suppkey", M.text("tag ", F.col("s_suppkey")).alias("en"))
    return D.exact_coverage(keys, keys.where(s <= 4), keys.where((s >= 4) & (s <= 8) & (s != 4) | (s == 1)), keys.where(s != 5))


@query("N18_protected_rows", M.with_sql(M.DICTIONARY) + """SELECT en, CASE WHEN n % 9 = 0 THEN 'missing' ELSE 'sr' END AS differing FROM (SELECT *, CAST(substr(en, 5) AS BIGINT) AS n FROM dictionary)
  WHERE n % 9 = 0 OR n % 11 = 0""")
def protected_rows(spark, sf_dir):
    rows = M.dictionary(spark, sf_dir).withColumn("n", F.substr("en", F.lit(5)).cast("bigint"))
    candidate = rows.where("n % 9 <> 0").withColumn("sr", F.when(F.col("n") % 11 == 0, F.lit("x")).otherwise(F.col("sr")))
    return D.changed_rows(rows, candidate, "en", ["machine", "sr", "reviewStatus", "manualOverride"])


@query("N19_release_compare", """SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 1 THEN 'missing' WHEN o_orderkey % 100 = 2 THEN 'extra' WHEN o_orderkey % 100 = 3 THEN 'o_totalprice' ELSE 'repeated' END AS differing
  FROM orders WHERE o_orderkey % 100 IN (1, 2, 3, 4)""")
def release_compare(spark, sf_dir):
    """Missing, extra and changed orders, and orders that are stored twice with equal content."""
    k = F.col("o_orderkey") % 100
    o = M.table(spark, sf_dir, "orders")
    stored = o.where(k != 1).withColumn("o_totalprice", F.when(k == 3, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    stored = stored.unionByName(stored.where(k == 4))
    return R.compare_rows(stored, o.where(k != 2), "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


def identified_vectors(spark, sf_dir):
    rows = M.vectors(spark, sf_dir)
    key = F.concat_ws("|", F.col("movie_id").cast("string"), "language")
    return rows.withColumn("fingerprint", F.sha2(key, 256)).withColumn("text_sha256", F.md5(key))


@query("N20_vector_pairs", """SELECT vec_id AS movie_id, sha256(vec_id || '|en') AS fingerprint_en, sha256(vec_id || '|sr') AS fingerprint_sr FROM embeddings WHERE vec_id % 9 <> 0""")
def vector_pairs(spark, sf_dir):
    """Each ninth movie has no Serbian vector."""
    rows = identified_vectors(spark, sf_dir).where("language = 'en' OR movie_id % 9 <> 0")
    return R.pair_vectors(rows).select("movie_id", F.col("document_fingerprint").alias("fingerprint_en"), F.col("document_fingerprint_sr").alias("fingerprint_sr"))


@query("N21_corrections", M.with_sql(M.DICTIONARY) + """SELECT en, CASE WHEN n % 8 = 3 THEN 'ispravka ' || n ELSE sr END AS sr, CASE WHEN n % 8 = 3 THEN 'reviewed' ELSE status END AS status,
  CASE WHEN n % 8 = 3 THEN sr END AS previous FROM (SELECT *, CAST(substr(en, 5) AS BIGINT) AS n FROM dictionary)""")
def corrections(spark, sf_dir):
    rows = M.dictionary(spark, sf_dir)
    n = F.substr("en", F.lit(5)).cast("bigint")
    fixes = rows.where(n % 8 == 3).select("en", F.col("sr").alias("oldAccepted"), "machine", M.text("ispravka ", n).alias("proposedSr"))
    out = D.apply_corrections(rows, fixes)[0]
    return out.select("en", "sr", F.col("reviewStatus").alias("status"), F.col("previousAccepted").alias("previous"))


# --- aggregates -----------------------------------------------------------------------------------------

@query("D1_source_counts", """SELECT (SELECT count(*) FROM part WHERE p_partkey % 10 <> 0) AS metadata_records, count(*) AS score_rows, count(DISTINCT l_partkey) AS scored_ids,
  count(DISTINCT CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END) AS joined, count(DISTINCT CASE WHEN l_partkey % 10 = 0 THEN l_partkey END) AS missing FROM lineitem""")
def source_counts(spark, sf_dir):
    return C.source_counts(_scored(spark, sf_dir), _metadata(spark, sf_dir))


@query("D2_rating_aggregates", M.with_sql(M.RATINGS) + "SELECT movie_id, count(*) AS rating_count, CAST(sum(rating) AS DOUBLE) AS rating_sum, round(CAST(sum(rating) AS DOUBLE) / count(*), 6) AS average FROM ratings GROUP BY 1")
def rating_aggregates(spark, sf_dir):
    rows = C.rating_aggregates(M.ratings(spark, sf_dir))
    return rows.select(F.col("movieId").alias("movie_id"), "rating_count", "rating_sum", C.average_rating(F.col("rating_sum"), F.col("rating_count")).alias("average"))


@query("D3_reconciliation", """SELECT count(*) AS selected_rows, count(*) AS summed_counts, true AS ok FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings)""")
def reconciliation(spark, sf_dir):
    members = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movieId"))
    ratings = M.ratings(spark, sf_dir)
    return C.reconcile_ratings(ratings, members, C.rating_aggregates(ratings, members))


@query("D4_tag_vocabulary", M.with_sql(M.TAG_SCORES, FN._TOP) + "SELECT tag, count(*) AS uses FROM top GROUP BY 1")
def tag_vocabulary(spark, sf_dir):
    return C.tag_vocabulary(_tagged(spark, sf_dir))


def _tagged(spark, sf_dir):
    return C.top_tags(M.tag_scores(spark, sf_dir).withColumnRenamed("item_id", "movieLensId")).select("movieLensId", F.transform("relevantTags", lambda t: t["name"]).alias("tags"))


@query("D4_tag_totals", M.with_sql(M.TAG_SCORES, FN._TOP) + "SELECT count(DISTINCT tag) AS distinct_tags, count(*) AS occurrences FROM top")
def tag_totals(spark, sf_dir):
    return C.tag_totals(_tagged(spark, sf_dir))


_COVERED = ["tmdb_id", "runtime_minutes", "original_language", "genres", "average_rating", "rating_count", "poster_path", "cast"]


@query("D5_coverage", M.with_sql(M.MOVIES) + " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count(*) - count("{c}") AS null_count, count("{c}") AS present_count FROM movies""" for c in _COVERED))
def coverage(spark, sf_dir):
    return C.coverage(M.movies(spark, sf_dir), _COVERED)


@query("D6_case_collisions", M.with_sql(M.MOVIES) + """, uses AS (SELECT movie_id, CASE WHEN movie_id % 3 = 0 AND name LIKE '%5' THEN upper(name) ELSE name END AS name
  FROM (SELECT movie_id, unnest("cast") AS name FROM movies))
SELECT upper(name) AS folded, name, movie_id FROM uses WHERE upper(name) IN (SELECT upper(name) FROM uses GROUP BY 1 HAVING count(DISTINCT name) > 1)""")
def case_collisions(spark, sf_dir):
    shout = F.transform("cast", lambda n: F.when(n.endswith("5") & (F.col("movie_id") % 3 == 0), F.upper(n)).otherwise(n))
    return AC.case_collisions(M.movies(spark, sf_dir).select("movie_id", shout.alias("cast")))


@query("D7_actor_vocabulary", M.with_sql(M.MOVIES) + """SELECT DISTINCT unnest("cast") AS name FROM movies""")
def actor_vocabulary(spark, sf_dir):
    return AC.vocabulary(M.movies(spark, sf_dir))


@query("D8_tree_digest", """WITH h AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
  a AS (SELECT k // 4096 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM h GROUP BY k // 4096)
SELECT (SELECT count(*) FROM orders) AS "rows", sha256(string_agg(h, '' ORDER BY k)) AS digest FROM a GROUP BY k // 4096""")
def tree_digest(spark, sf_dir):
    """Digest of the ordered id set; at this scale factor two levels."""
    return R.tree_digest(M.table(spark, sf_dir, "orders"), "o_orderkey")


def _lane(i: int) -> str:
    return f"sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS DECIMAL(38, 0)))"


@query("D8_bag_digest", f"""SELECT o_orderstatus, count(*) AS "rows", sha256('bag-sha256-lanes-v1:' || count(*) || ':' || {" || ':' || ".join(_lane(i) for i in range(4))}) AS digest
  FROM (SELECT o_orderstatus, sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}}') AS h FROM orders) GROUP BY 1""")
def bag_digest(spark, sf_dir):
    """Content digests per order status in one pass."""
    return R.bag_digest(M.table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority"], by=["o_orderstatus"])


@query("D9_failure_classes", "SELECT event_type AS class, count(*) AS failures, count(DISTINCT user_id) AS ids FROM events GROUP BY 1")
def failure_classes(spark, sf_dir):
    return C.failure_classes(M.table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.col("user_id").alias("tmdbId")))[0]


@query("D9_failed_ids", "SELECT DISTINCT event_type AS class, user_id AS id FROM events")
def failed_ids(spark, sf_dir):
    rows = C.failure_classes(M.table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.col("user_id").alias("tmdbId")))[1]
    return rows.select("class", F.col("tmdbId").alias("id"))


@query("D10_status_counts", "SELECT o_orderstatus AS status, count(*) AS ids FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return C.status_counts(M.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


_RUNS = f"""runs AS (SELECT q.* REPLACE (query_id AS query_id), mode FROM criteria q, (SELECT unnest(['structured', 'semantic']) AS mode)),
  customers AS (SELECT count(*) AS n FROM criteria),
  found AS (SELECT q.query_id, q.mode, m.movie_id, {M.MATCH_WITHOUT_ACTORS} AS ok FROM runs q JOIN movies m ON (m.movie_id // 7) % (SELECT n FROM customers) = q.c_custkey)"""


def _runs(spark, sf_dir):
    modes = F.explode(F.array(F.lit("structured"), F.lit("semantic")))
    return M.criteria(spark, sf_dir).withColumn("mode", modes).withColumn("expectedNoResults", F.col("query_id").cast("bigint") % 2 == 0)


def _found(spark, sf_dir):
    """Sevens of neighbouring movies, dealt round the runs so that every movie is a result of one."""
    q = _runs(spark, sf_dir).select("query_id", "mode")
    customers = M.table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers"))
    m = M.movies(spark, sf_dir).join(F.broadcast(customers)).withColumn(
        "query_id", (F.floor(F.col("movie_id") / 7) % F.col("customers")).cast("string")).drop("customers")
    return q.join(m, "query_id").select("query_id", "mode", "movie_id", "year", "runtime_minutes", "genres", "average_rating", "original_language")


COMPLIANCE_SQL = M.with_sql(M.MOVIES, M.CRITERIA, _RUNS) + """SELECT r.query_id, r.mode, count(f.movie_id) AS results, {}
  FROM runs r LEFT JOIN found f ON f.query_id = r.query_id AND f.mode = r.mode GROUP BY 1, 2"""


@query("D11_compliance", COMPLIANCE_SQL.format("""count(*) FILTER (WHERE NOT f.ok) AS violations,
  CASE WHEN count(f.movie_id) > 0 THEN round(count(*) FILTER (WHERE f.ok) * 100.0 / count(f.movie_id), 6) END AS percent"""))
def compliance(spark, sf_dir):
    return E.compliance(_runs(spark, sf_dir), _found(spark, sf_dir)).select("query_id", "mode", "results", "violations", "percent")


@query("D15_expected_results", M.with_sql(M.MOVIES, M.CRITERIA, _RUNS) + """SELECT r.query_id, r.mode, count(f.movie_id) BETWEEN 1 AND 9 AS partial,
  (any_value(r.c_custkey) % 2 = 0) = (count(f.movie_id) = 0) AS expected_ok FROM runs r LEFT JOIN found f ON f.query_id = r.query_id AND f.mode = r.mode GROUP BY 1, 2""")
def expected_results(spark, sf_dir):
    return E.compliance(_runs(spark, sf_dir), _found(spark, sf_dir)).select("query_id", "mode", "partial", "expected_ok")


_METRIC = M.with_sql(_JUDGED) + """, listed AS (SELECT query_id, movie_id, score, row_number() OVER (PARTITION BY query_id ORDER BY movie_id DESC) AS rank FROM judged QUALIFY rank <= 10),
  ideal AS (SELECT query_id, sum((pow(2, score) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS r FROM judged)
  WHERE r <= 10 GROUP BY 1)
SELECT query_id, {} FROM listed JOIN ideal USING (query_id) GROUP BY query_id"""


def _metrics(spark, sf_dir):
    """Lists of the last ten judged documents of each source."""
    judged = judgments(spark, sf_dir)
    listed = E.ranked(judged.withColumn("mode", F.lit("semantic")), [F.desc("movie_id")]).where("rank <= 10")
    return E.relevance(listed, judged)


@query("D12_mean_relevance", _METRIC.format("round(avg(score), 6) AS mean_relevance"))
def mean_relevance(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", "mean_relevance")


@query("D13_precision_at_10", _METRIC.format("round(count(*) FILTER (WHERE score >= 2) / least(10, count(*)), 6) AS precision_at_10"))
def precision(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", "precision_at_10")


@query("D14_ndcg_at_10", _METRIC.format("round(CASE WHEN any_value(ideal) = 0 THEN 0 ELSE sum((pow(2, score) - 1) / log2(rank + 1)) / any_value(ideal) END, 6) AS ndcg_at_10"))
def ndcg(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", "ndcg_at_10")


@query("D16_text_collisions", M.with_sql(M.DICTIONARY) + "SELECT upper(sr) AS folded, count(DISTINCT en) AS keys FROM dictionary GROUP BY 1 HAVING count(DISTINCT en) > 1")
def text_collisions(spark, sf_dir):
    from filmloom.functions.normalize import with_serbian_latin
    return D.collisions(with_serbian_latin(M.dictionary(spark, sf_dir), "sr", "sr_normal"))


@query("D17_dictionary_summary", M.with_sql(M.DICTIONARY) + "SELECT status, count(*) AS entries, count(*) FILTER (WHERE manual) AS overridden FROM dictionary GROUP BY 1")
def dictionary_summary(spark, sf_dir):
    return D.summary(M.dictionary(spark, sf_dir)).withColumnRenamed("reviewStatus", "status")


@query("D18_token_audit", """SELECT lang AS language, count(*) AS documents, count(*) FILTER (WHERE t > 512) AS truncated, max(t) AS longest
  FROM (SELECT lang, (strlen(text) + 9 + 3) // 4 AS t FROM documents) GROUP BY 1""")
def token_audit(spark, sf_dir):
    return EM.token_audit(M.table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"))


@query("D19_event_inventory", M.with_sql(M.MOVIES) + """SELECT 'trailing-empty-separator' AS kind, count(*) AS events FROM movies WHERE "cast" IS NOT NULL AND movie_id % 37 = 0
UNION ALL SELECT 'exact-duplicate-suppression', count(*) FROM movies WHERE "cast" IS NOT NULL AND movie_id % 10 = 3""")
def event_counts(spark, sf_dir):
    k = F.col("movie_id")
    parts = F.when(k % 10 == 3, F.array_append("cast", F.get("cast", F.lit(0)))).otherwise(F.col("cast"))
    raw = F.concat(F.array_join(parts, ", "), F.when(k % 37 == 0, F.lit(", ")).otherwise(F.lit("")))
    return event_inventory(with_cast(M.movies(spark, sf_dir).select("movie_id", raw.alias("starringRaw")), key="movie_id"), "movie_id")


@query("D20_latency_percentiles", """SELECT event_type AS stage, p, value FROM (SELECT event_type, unnest([CAST(0.5 AS DOUBLE), 0.95]) AS p, unnest([quantile_disc(value, 0.5), quantile_disc(value, 0.95)]) AS value
  FROM events GROUP BY 1)""")
def latency_percentiles(spark, sf_dir):
    log = M.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("millis"))
    return E.latency_percentiles(log, [0.5, 0.95])


@query("D21_duplicate_keys", """SELECT 'order' AS rule, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'customer', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'customer_day', (SELECT count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(*) > 1))""")
def duplicate_keys(spark, sf_dir):
    return duplicate_report(M.table(spark, sf_dir, "orders"), {"order": ["o_orderkey"], "customer": ["o_custkey"], "customer_day": ["o_custkey", "o_orderdate"]})


@query("D22_vector_readiness", """SELECT language, count(*) AS vectors, count(*) FILTER (WHERE NOT cut) AS valid FROM (SELECT 'en' AS language, vec_id % 20 = 0 AS cut FROM embeddings
  UNION ALL SELECT 'sr', vec_id % 20 = 0 FROM embeddings) GROUP BY 1""")
def vector_readiness(spark, sf_dir):
    rows = M.vectors(spark, sf_dir).withColumn("vector", F.when(F.col("movie_id") % 20 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector")))
    return R.vector_readiness(rows, 64)
