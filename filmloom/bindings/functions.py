"""Queries of the scalar functions over the driver texts and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmloom.bindings import model as M
from filmloom.bindings.registry import query
from filmloom.functions import text as TX, vectors as V
from filmloom.functions.cast import with_cast
from filmloom.functions.guard import with_language_mismatch
from filmloom.functions.normalize import CYRILLIC, LATIN, with_nfc, with_serbian_latin
from filmloom.functions.translation import is_approved_serbian, with_entry_flags
from filmloom.operators import actors as AC, catalog as C, criteria as CR, dictionary as D, embedding as EM
from filmloom.operators.rules import distinct_nonblank, failed_rules
from filmloom.session import materialize

_SPACE = r"[\t-\r\x{85}\p{Z}]"


@query("H1_title_parts", """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title,
  CASE WHEN p_partkey % 5 <> 0 THEN 1900 + p_partkey % 120 END AS year FROM part""")
def title_parts(spark, sf_dir):
    k = F.col("p_partkey")
    suffix = F.when(k % 5 != 0, F.concat(F.lit(" ("), (1900 + k % 120).cast("string"), F.lit(")"))).otherwise(F.lit(" (19)"))
    raw = F.concat(F.lit("  "), "p_name", suffix, F.lit(" "))
    return M.table(spark, sf_dir, "part").select("p_partkey", TX.title_parts(raw).alias("t")).select("p_partkey", "t.title", "t.year")


@query("H2_canonical_digits", """SELECT o_orderkey, CAST(o_orderkey % 1000 AS VARCHAR) AS digits, o_orderkey % 1000 = o_custkey AS same
  FROM orders""")
def canonical_digits(spark, sf_dir):
    padded = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 9, "0")
    other = F.lpad(F.col("o_custkey").cast("string"), 12, "0")
    return M.table(spark, sf_dir, "orders").select(
        "o_orderkey", TX.canonical_digits(padded).alias("digits"),
        (TX.canonical_digits(padded) == TX.canonical_digits(other)).alias("same"))


@query("H3_blank_to_null", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS director FROM part")
def blank_to_null(spark, sf_dir):
    padded = F.when(F.col("p_partkey") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return M.table(spark, sf_dir, "part").select("p_partkey", TX.blank_to_null(padded).alias("director"))


_TAGS = "CASE WHEN len(genres) > 0 THEN array_to_string(genres, ', ') ELSE '{}' END"
_EN = ("'Title: ' || title || '. Year: ' || year || '. Director: ' || coalesce(director, 'unknown'){} || '. Tags: ' || "
       + _TAGS.format("none") + " || '.'")
_SR = ("'Naslov: ' || title || '. Godina: ' || year || '. Režija: ' || coalesce(director, 'nepoznato'){} || '. Tagovi: ' || "
       + _TAGS.format("nema") + " || '.'")
_TEXTS = M.with_sql(M.MOVIES, """named AS (SELECT *  REPLACE (CASE WHEN movie_id % 21 <> 0 THEN director END AS director),
  array_to_string("cast", ', ') AS starring FROM movies)""")


def _documents(spark, sf_dir, language, with_cast_sentence):
    rows = M.base_movies(spark, sf_dir).join(M.movies(spark, sf_dir).select(F.col("movie_id").alias("movieLensId"), "genres"), "movieLensId")
    cast = F.col("starringRaw") if with_cast_sentence else None
    text = TX.document_text(language, F.col("title"), F.col("year"), F.col("directedByRaw"), F.col("genres"), cast=cast)
    return rows.select(F.col("movieLensId").alias("movie_id"), text.alias("text"))


@query("H4_text_en_v1", _TEXTS + "SELECT movie_id, " + _EN.format(" || '. Cast: ' || coalesce(starring, 'unknown')") + " AS text FROM named")
def text_en_v1(spark, sf_dir):
    return _documents(spark, sf_dir, "en", True)


@query("H5_text_sr_v1", _TEXTS + "SELECT movie_id, " + _SR.format(" || '. Glumci: ' || coalesce(starring, 'nepoznato')") + " AS text FROM named")
def text_sr_v1(spark, sf_dir):
    return _documents(spark, sf_dir, "sr", True)


@query("H6_text_v6", _TEXTS + "SELECT movie_id, " + _EN.format("") + " AS en, " + _SR.format("") + " AS sr FROM named")
def text_v6(spark, sf_dir):
    en = _documents(spark, sf_dir, "en", False).withColumnRenamed("text", "en")
    return en.join(_documents(spark, sf_dir, "sr", False).withColumnRenamed("text", "sr"), "movie_id")


_TOP = """top AS (SELECT item_id, tag, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tag) AS pos
  FROM tag_scores) WHERE pos <= 10)"""


def semantic(spark, sf_dir):
    """Base records with top tags; the tag table is restricted to known movies by the operator."""
    return C.semantic_movies(M.base_movies(spark, sf_dir), M.tag_scores(spark, sf_dir))


@query("H7_bilingual_projection", M.with_sql(M.MOVIES, M.BASE, M.TAG_SCORES, _TOP, M.DICTIONARY) + """SELECT b.movie_id,
  coalesce(s.tags, '') AS tags_sr, 'Naslov: ' || title || '. Godina: ' || year || '. Režija: ' || coalesce(director, 'nepoznato')
  || '. Glumci: ' || coalesce(starring, 'nepoznato') || '. Tagovi: ' || coalesce(s.listed, 'nema') || '.' AS text_sr
FROM base b LEFT JOIN (SELECT item_id, string_agg(sr, '|' ORDER BY pos) AS tags, string_agg(sr, ', ' ORDER BY pos) AS listed
  FROM top JOIN dictionary ON en = tag GROUP BY 1) s ON s.item_id = b.movie_id""")
def bilingual_projection(spark, sf_dir):
    both = C.bilingual_catalog(semantic(spark, sf_dir), M.dictionary(spark, sf_dir))
    return both.select(F.col("movieLensId").alias("movie_id"), F.col("tagsSr").alias("tags_sr"), F.col("semanticTextSr").alias("text_sr"))


_COLLAPSED = f"trim(regexp_replace(nfc_normalize(text), '{_SPACE}+', ' ', 'g'))"


@query("H8_serbian_normalizer", f"SELECT doc_id, {_COLLAPSED} AS latin FROM documents")
def serbian_normalizer(spark, sf_dir):
    """Lower-case letters are first written in Cyrillic; the normalizer must bring all of them back."""
    cyrillic = F.col("text")
    for latin, letter in (("lj", "љ"), ("nj", "њ"), ("dž", "џ")):
        cyrillic = F.replace(cyrillic, F.lit(latin), F.lit(letter))
    docs = M.table(spark, sf_dir, "documents").select("doc_id", F.translate(cyrillic, LATIN, CYRILLIC).alias("text"))
    return with_serbian_latin(docs, "text", "latin").select("doc_id", "latin")


@query("H9_nfc", "SELECT doc_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS digest FROM documents")
def nfc_text(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("e"), F.lit("é")).alias("text"))
    return with_nfc(docs, "text", "text").select("doc_id", F.md5("text").alias("digest"))


@query("H10_cast_parser", M.with_sql(M.MOVIES) + """SELECT movie_id,
  CASE WHEN movie_id % 43 <> 0 AND "cast" IS NOT NULL THEN CASE WHEN movie_id % 41 = 0
    THEN array_to_string(list_concat(["cast"[1] || ', Jr.'], "cast"[2:]), '|') ELSE array_to_string("cast", '|') END END AS "cast",
  CASE WHEN movie_id % 43 = 0 AND "cast" IS NOT NULL THEN 'empty token' END AS error,
  CASE WHEN "cast" IS NULL OR movie_id % 43 = 0 THEN '' ELSE array_to_string(list_filter([
    CASE WHEN movie_id % 41 = 0 THEN 'suffix-attachment' END, CASE WHEN movie_id % 37 = 0 THEN 'trailing-empty-separator' END,
    CASE WHEN movie_id % 10 = 3 AND movie_id % 41 <> 0 THEN 'exact-duplicate-suppression' END], lambda x: x IS NOT NULL), '|') END AS events
FROM (SELECT * REPLACE (CASE WHEN movie_id % 10 = 3 AND movie_id % 41 = 0 THEN list_append("cast", "cast"[1]) ELSE "cast" END AS "cast") FROM movies)""")
def cast_parser(spark, sf_dir):
    k, names = F.col("movie_id"), F.col("cast")
    first = F.get(names, F.lit(0))
    parts = F.when(k % 41 == 0, F.concat(F.array(first, F.lit(" Jr.")), F.slice(names, F.lit(2), F.size(names)))).otherwise(names)
    parts = F.when(k % 10 == 3, F.array_append(parts, first)).otherwise(parts)
    parts = F.when(k % 43 == 0, F.concat(F.array(F.lit(" ")), parts)).otherwise(parts)
    raw = F.concat(F.array_join(parts, " , "), F.when(k % 37 == 0, F.lit(", ")).otherwise(F.lit("")))
    rows = M.movies(spark, sf_dir).select("movie_id", raw.alias("starringRaw"))
    parsed = with_cast(rows, key="movie_id")
    kinds = F.coalesce(F.transform("cast_events", lambda e: e["kind"]), F.array().cast("array<string>"))
    return parsed.select("movie_id", "cast", F.col("cast_error").alias("error"), kinds.alias("events"))


_NAMES = 'names AS (SELECT DISTINCT unnest("cast") AS name FROM movies)'


@query("H11_resolve_names", M.with_sql(M.MOVIES, _NAMES) + """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN a.target
  ELSE n.name END AS resolved FROM customer
  LEFT JOIN names n ON upper(n.name) = 'ACTOR ' || (c_custkey % 120) AND c_custkey % 4 <> 3
  LEFT JOIN (SELECT 'A' || n AS alias, 'Actor ' || n AS target FROM (SELECT unnest(range(50)) AS n) WHERE n % 2 = 1) a
    ON a.alias = 'A' || (c_custkey % 50)""")
def resolve_names(spark, sf_dir):
    c = F.col("c_custkey")
    n = (c % 120).cast("string")
    proposed = (F.when(c % 4 == 0, F.concat(F.lit("Actor "), n)).when(c % 4 == 1, F.concat(F.lit(" actor "), n, F.lit(" ")))
                .when(c % 4 == 2, F.concat(F.lit("ACTOR "), n)).otherwise(F.concat(F.lit(" a"), (c % 50).cast("string"))))
    rows = M.table(spark, sf_dir, "customer").select("c_custkey", proposed.alias("proposed"))
    names = AC.vocabulary(M.movies(spark, sf_dir))
    aliases = names.where("name LIKE 'Actor %'").select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("n"), F.col("name").alias("target")).where(
        (F.col("n") < 50) & (F.col("n") % 2 == 1)).select(F.concat(F.lit("A"), F.col("n").cast("string")).alias("alias"), "target")
    return AC.resolve_names(rows, names, aliases).select("c_custkey", "resolved")


@query("H12_resolve_groups", M.with_sql(M.MOVIES, _NAMES, M.CRITERIA) + """, q AS (SELECT query_id, c_custkey, actors_all, actors_any,
  CASE WHEN c_custkey % 45 = 4 THEN [actors_exclude[1], actors_exclude[1]] WHEN c_custkey % 36 = 4 THEN [actors_exclude[1], 'Nobody']
    ELSE actors_exclude END AS actors_exclude FROM criteria), asked AS (
  SELECT query_id, unnest(list_concat(list_concat(coalesce(actors_all, []), coalesce(actors_any, [])), coalesce(actors_exclude, []))) AS name
  FROM q), unknown AS (SELECT DISTINCT query_id FROM asked WHERE name NOT IN (SELECT name FROM names))
SELECT query_id, CASE WHEN c_custkey % 45 = 4 AND actors_exclude[1] IN (SELECT name FROM names) THEN 'invalid'
  WHEN query_id IN (SELECT query_id FROM unknown) OR coalesce(list_has_any(actors_all, actors_exclude), false)
    OR coalesce(list_has_all(actors_exclude, actors_any), false) THEN 'alert' ELSE 'query' END AS type,
  CASE WHEN NOT (c_custkey % 45 = 4 AND actors_exclude[1] IN (SELECT name FROM names)) AND (query_id IN (SELECT query_id FROM unknown)
    OR coalesce(list_has_any(actors_all, actors_exclude), false) OR coalesce(list_has_all(actors_exclude, actors_any), false))
    THEN 'QUERY_UNCLEAR' END AS alert_code,
  CASE WHEN c_custkey % 45 <> 4 AND query_id NOT IN (SELECT query_id FROM unknown) AND NOT coalesce(list_has_any(actors_all, actors_exclude), false)
    AND NOT coalesce(list_has_all(actors_exclude, actors_any), false) THEN array_to_string(actors_exclude, '|') END AS actors_exclude FROM q""")
def resolve_groups(spark, sf_dir):
    """Proposals are written in lower case; some groups repeat a person or name nobody of the catalog."""
    c, ex = F.col("query_id").cast("bigint"), F.col("actors_exclude")
    odd = M.criteria(spark, sf_dir).withColumn("actors_exclude", F.when(
        c % 45 == 4, F.array(F.get(ex, F.lit(0)), F.upper(F.get(ex, F.lit(0)))))
        .when(c % 36 == 4, F.array(F.get(ex, F.lit(0)), F.lit("Nobody"))).otherwise(F.transform(ex, F.lower)))
    rows = odd.withColumns({"type": F.lit("query"), "alert_code": F.lit(None).cast("string")})
    done = AC.resolve_actors(rows, AC.vocabulary(M.movies(spark, sf_dir)))
    return done.select("query_id", "type", "alert_code", "actors_exclude")


_SCALES = ["five", "ten", "unspecified", "other"]


@query("H13_rating_threshold", f"""SELECT c_custkey, round(CASE WHEN v NOT BETWEEN 1 AND 10 THEN NULL WHEN scale = 'five' THEN CASE WHEN v <= 5 THEN v END
  WHEN scale = 'ten' THEN v / 2 WHEN scale = 'unspecified' THEN CASE WHEN v <= 5 THEN v ELSE v / 2 END END, 6) AS threshold
  FROM (SELECT c_custkey, CAST(c_custkey % 110 AS DOUBLE) / 10 AS v, {M.sql_pick(_SCALES, 'c_custkey')} AS scale FROM customer)""")
def rating_threshold(spark, sf_dir):
    c = F.col("c_custkey")
    value = (c % 110).cast("decimal(10,0)") / F.lit(10).cast("decimal(10,0)")
    return M.table(spark, sf_dir, "customer").select("c_custkey", TX.rating_threshold(value, M.pick(_SCALES, c)).alias("threshold"))


def answers(spark, sf_dir):
    """Parser answers as JSON, some broken in one of several ways."""
    c = F.col("query_id").cast("bigint")
    none = F.array().cast("array<string>")
    status = lambda on: F.when(on, "present").otherwise("absent")
    listed = lambda f: F.coalesce(F.col(f), none)
    on = lambda *fs: F.coalesce(*[F.col(f).cast("string") if f.endswith(("min", "max", "language")) else F.array_join(f, "") for f in fs]).isNotNull()
    unsupported = c % 20 == 0
    year = F.struct(F.when(unsupported, "unsupported").otherwise(status(on("year_min", "year_max"))).alias("status"),
                    F.when(~unsupported, F.col("year_min")).alias("min"), F.when(~unsupported, F.col("year_max")).alias("max"))
    rated = F.col("rating_min").isNotNull()
    value = F.when(c % 20 == 7, F.lit(11)).otherwise(F.col("rating_min") + 1)
    q = F.struct(
        year.alias("year"),
        F.struct(status(on("runtime_min", "runtime_max")).alias("status"), F.col("runtime_min").alias("min"),
                 F.col("runtime_max").alias("max")).alias("runtime"),
        F.struct(status(on("genres_all", "genres_any")).alias("status"), listed("genres_all").alias("all"),
                 listed("genres_any").alias("any")).alias("genres"),
        F.struct(status(rated).alias("status"), F.when(rated, value.cast("double")).alias("value"),
                 F.col("rating_operator").alias("operator"), F.when(rated, "ten").alias("scale")).alias("rating"),
        F.struct(status(F.col("original_language").isNotNull()).alias("status"),
                 F.col("original_language").alias("value")).alias("originalLanguage"),
        F.col("semantic_query").alias("semanticQuery"),
        F.struct(status(on(*["actors_all", "actors_any", "actors_exclude"])).alias("status"), listed("actors_all").alias("all"),
                 listed("actors_any").alias("any"), listed("actors_exclude").alias("exclude")).alias("actors"))
    keep = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(F.lit("query").alias("type"), F.lit("match").alias("languageCheck"), q.alias("query"),
                              F.lit(None).cast("string").alias("alertCode")), keep)
    alert = F.lit('{"type":"alert","languageCheck":"mismatch","query":null,"alertCode":"LANGUAGE_MISMATCH"}')
    text = (F.when(c % 20 == 1, F.replace(body, F.lit('"year":{'), F.lit('"year":{"extra":1,')))
            .when(c % 20 == 2, F.replace(body, F.lit('{"type":"query"'), F.lit('{"type":"query","type":"query"')))
            .when(c % 20 == 3, alert).when(c % 20 == 5, F.replace(body, F.lit('"genres":{'), F.lit('"genres":{"any":5,')))
            .when(c % 20 == 6, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body))
    return M.criteria(spark, sf_dir).select("query_id", "language", text.alias("answer"))


_EXPECTED = f"""judged AS (SELECT q.*, CASE WHEN c_custkey % 20 IN (1, 2, 5, 6) THEN 'invalid' WHEN c_custkey % 20 = 3 THEN 'alert'
  WHEN (c_custkey % 20 <> 0 AND year_min > year_max) OR runtime_min > runtime_max THEN 'invalid'
  WHEN c_custkey % 20 = 0 OR (c_custkey % 20 = 7 AND rating_min IS NOT NULL) THEN 'alert'
  WHEN semantic_query IS NULL AND NOT {M.ACTIVE} THEN 'invalid' ELSE 'query' END AS type FROM criteria q)"""


@query("H14_structured_criteria", M.with_sql(M.CRITERIA, _EXPECTED) + """SELECT query_id, type,
  CASE WHEN type = 'alert' THEN CASE WHEN c_custkey % 20 = 3 THEN 'LANGUAGE_MISMATCH' ELSE 'UNSUPPORTED_REQUEST' END END AS alert_code,
  CASE WHEN type = 'query' THEN year_min END AS year_min, CASE WHEN type = 'query' THEN round(CAST(rating_min + 1 AS DOUBLE) / 2, 6) END AS rating_min,
  CASE WHEN type = 'query' THEN array_to_string(actors_any, '|') END AS actors_any,
  CASE WHEN type = 'query' THEN array_to_string(genres_any, '|') END AS genres_any,
  CASE WHEN type = 'query' THEN semantic_query END AS semantic_query FROM judged""")
def structured_criteria(spark, sf_dir):
    rows = CR.parse_criteria(answers(spark, sf_dir))
    return rows.select("query_id", "type", "alert_code", "year_min", "rating_min", "actors_any", "genres_any", "semantic_query")


_CHECKS, _TYPES = ["match", "mismatch", "unclear", "odd"], ["alert", "query", "alert"]
_CODES = ["QUERY_UNCLEAR", "LANGUAGE_MISMATCH", "NOT_MOVIE_REQUEST", "UNSUPPORTED_REQUEST", "NO_RESULTS"]


@query("H15_result_recheck", M.with_sql(M.CRITERIA) + f""", r AS (SELECT c_custkey, query_id, CASE WHEN c_custkey % 2 = 1 THEN year_min END AS y,
  {M.sql_pick(_CHECKS, 'c_custkey // 2')} AS "check", {M.sql_pick(_TYPES, 'c_custkey')} AS type,
  CASE WHEN c_custkey % 7 <> 0 THEN {M.sql_pick(_CODES, 'c_custkey')} END AS code FROM criteria)
SELECT query_id, CASE type WHEN 'alert' THEN coalesce(CASE "check" WHEN 'match' THEN code IN ('QUERY_UNCLEAR', 'NOT_MOVIE_REQUEST', 'UNSUPPORTED_REQUEST')
  WHEN 'mismatch' THEN code = 'LANGUAGE_MISMATCH' WHEN 'unclear' THEN code = 'QUERY_UNCLEAR' ELSE false END, false)
  ELSE "check" = 'match' AND code IS NULL END AS ok FROM r""")
def result_recheck(spark, sf_dir):
    """Alert rows carry nothing else; query rows ask for one year."""
    c = F.col("query_id").cast("bigint")
    kind = M.pick(_TYPES, c)
    from filmloom.operators.filters import FIELDS
    rows = M.criteria(spark, sf_dir).withColumns({f: F.lit(None).cast("string") if f in ("rating_operator", "original_language")
                                                 else F.when(F.lit(False), F.col(f)) for f in FIELDS})
    rows = rows.withColumns({"type": kind, "language_check": M.pick(_CHECKS, F.floor(c / 2)), "semantic_query": F.lit(None).cast("string"),
                             "alert_code": F.when(c % 7 != 0, M.pick(_CODES, c)),
                             "year_min": F.when(kind == "query", F.lit(2000))})
    return rows.select("query_id", (F.size(failed_rules(CR.result_rules())) == 0).alias("ok"))


@query("H16_poster_url", r"""SELECT page_id, CASE WHEN p LIKE '/%' AND p NOT LIKE '//%' AND NOT regexp_matches(p, '[\\?#]') AND NOT contains(p, '..')
  THEN 'https://image.tmdb.org/t/p/w500' || p END AS poster_url FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || substr(url, 9)
  WHEN 1 THEN url WHEN 2 THEN '/a/../' || page_id WHEN 3 THEN '/' || page_id || '?x' ELSE '//' || page_id END AS p FROM pages)""")
def poster_url(spark, sf_dir):
    k = F.col("page_id")
    s = k.cast("string")
    path = (F.when(k % 5 == 0, F.concat(F.lit("/"), F.substr("url", F.lit(9)))).when(k % 5 == 1, F.col("url"))
            .when(k % 5 == 2, F.concat(F.lit("/a/../"), s)).when(k % 5 == 3, F.concat(F.lit("/"), s, F.lit("?x")))
            .otherwise(F.concat(F.lit("//"), s)))
    return M.table(spark, sf_dir, "pages").select("page_id", TX.poster_url(path).alias("poster_url"))


@query("H17_title_url", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://www.imdb.com/title/tt' || o_orderkey || '/' END AS url FROM orders""")
def title_url(spark, sf_dir):
    k = F.col("o_orderkey")
    digits = F.when(k % 3 == 0, F.concat(F.lit("tt"), k.cast("string"))).otherwise(k.cast("string"))
    return M.table(spark, sf_dir, "orders").select("o_orderkey", TX.title_url(digits).alias("url"))


_OPENERS = ["Show me movies about ", "Želim film o ", "Filmovi bez ", "Films directed by ", "Movies ", "Želim film kao \"Show me movies\" "]
_EDGE = r"(^|[^\p{L}\p{N}_])"
_SR_WORDS = ("želim|zelim|hoću|hocu|tražim|trazim|prikaži|prikazi|pronađi|pronadji|daj|filmovi|filmove|kojima|kojem|glumi|glume|bez|sa|koji|kao|"
             "najmanje|najviše|najvise|posle|nakon|izvorno")
_EN_WORDS = "show|find|give|recommend|want|would|looking|movies|starring|featuring|directed|without|with|about|after|before"


@query("H18_language_guard", f"""SELECT conv_id, turn, CASE o WHEN 0 THEN NOT sr WHEN 3 THEN NOT sr AND worded WHEN 1 THEN NOT en
  WHEN 2 THEN NOT en AND worded WHEN 5 THEN NOT en ELSE false END AS mismatch FROM (SELECT conv_id, turn, conv_id % 6 AS o,
  regexp_matches(t, '{_EDGE}({_SR_WORDS})([^\\p{{L}}\\p{{N}}_]|$)') AS sr, regexp_matches(t, '{_EDGE}({_EN_WORDS})([^\\p{{L}}\\p{{N}}_]|$)') AS en,
  regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AS worded
  FROM (SELECT conv_id, turn, lower(nfc_normalize(translate(text, '"“”«»''‘’', '        '))) AS t FROM conversations))""")
def language_guard(spark, sf_dir):
    """Whole messages behind openings of known language; English openings are checked against Serbian and back."""
    clean = F.translate(F.col("text"), "\"“”«»'‘’", "        ")
    k = F.col("conv_id")
    rows = M.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(M.pick(_OPENERS, k), clean).alias("message"),
        F.when((k % 6).isin(1, 2, 5), "en").otherwise("sr").alias("selected"))
    return with_language_mismatch(rows, "message", "selected").select("conv_id", "turn", "mismatch")


_CORE = r"regexp_replace(t, '[^\p{L}\p{Nd}]', '', 'g')"
_TRIM = r"regexp_replace(text, '^[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"


@query("H19_message_usability", f"""SELECT conv_id, turn, length(t) BETWEEN 1 AND 500 AND length(c) >= 2
  AND NOT (length(c) >= 8 AND c = repeat(c[1], length(c))) AND NOT (length(c) >= 16 AND c[1] <> c[2]
  AND c = left(repeat(c[1:2], length(c)), length(c))) AS usable FROM (SELECT *, {_CORE} AS c FROM (SELECT conv_id, turn, {_TRIM} AS t
  FROM (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN repeat('a', CAST(turn AS INTEGER) + 5) WHEN 1 THEN repeat('ab', CAST(turn AS INTEGER) + 6)
  ELSE '  ' || text END AS text FROM conversations)))""")
def message_usability(spark, sf_dir):
    t = F.col("turn").cast("int")
    text = (F.when(F.col("conv_id") % 5 == 0, F.repeat(F.lit("a"), t + 5)).when(F.col("conv_id") % 5 == 1, F.repeat(F.lit("ab"), t + 6))
            .otherwise(F.concat(F.lit("  "), "text")))
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", TX.is_usable_message(text).alias("usable"))


@query("H20_semantic_text", rf"""SELECT conv_id, turn, t = regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g') AND t <> '' AND NOT regexp_matches(t, '\p{{Cc}}')
  AND regexp_matches(t, '[\p{{L}}\p{{Nd}}]') AND t NOT IN ('NO_RESULTS') AS ok FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN ' ' || text
  WHEN 2 THEN 'NO_RESULTS' ELSE '---' END AS t FROM conversations)""")
def semantic_text(spark, sf_dir):
    k = F.col("conv_id") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit(" "), "text")).when(k == 2, "NO_RESULTS").otherwise("---")
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", TX.is_semantic_text(text).alias("ok"))


_SHARED = "shared AS (SELECT upper(sr) AS folded FROM dictionary GROUP BY 1 HAVING count(DISTINCT en) > 1)"
_FLAGS = """flagged AS (SELECT d.*, list_filter([CASE WHEN contains(machine, '((') THEN 'malformed_output' END,
  CASE WHEN en <> 'tag ' || substr(sr, 8) THEN 'lost_number_or_negation' END,
  CASE WHEN upper(sr) IN (SELECT folded FROM shared) THEN 'sr_collision' END], lambda x: x IS NOT NULL) AS flags FROM dictionary d)"""


@query("H21_translation_flags", M.with_sql(M.DICTIONARY, _SHARED, _FLAGS) + "SELECT en, array_to_string(flags, '|') AS flags FROM flagged")
def translation_flags(spark, sf_dir):
    rows = D.analyze(M.dictionary(spark, sf_dir))
    return rows.select("en", F.transform("flags", lambda f: f["code"]).alias("flags"))


@query("H21_flags_on_texts", rf"""SELECT doc_id, length(n) > 80 OR length(n) > greatest(20, 4 * length(e)) AS excessive,
  regexp_matches(regexp_replace(n, '[\x{{0}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}\x{{ab30}}-\x{{ab6f}}]', '', 'g'), '\p{{L}}') AS residue,
  len(list_filter(regexp_extract_all(e, '\p{{Nd}}+'), lambda x: NOT list_contains(regexp_extract_all(n, '\p{{Nd}}+'), x))) > 0 AS lost
  FROM (SELECT doc_id, {_COLLAPSED} AS n, lang || ' ' || doc_id % 10 AS e FROM documents)""")
def flags_on_texts(spark, sf_dir):
    """Whole documents as accepted texts of a short key."""
    rows = M.table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit(" "), (F.col("doc_id") % 10).cast("string")).alias("en"),
                                                      F.lit("m").alias("machine"), F.col("text").alias("sr"))
    codes = F.transform("flags", lambda f: f["code"])
    has = lambda code: F.array_contains(codes, code)
    return with_entry_flags(rows).select("doc_id", has("excessive_length").alias("excessive"), has("script_residue").alias("residue"),
                                         has("lost_number_or_negation").alias("lost"))


@query("H22_review_status", M.with_sql(M.DICTIONARY, _SHARED, _FLAGS) + """SELECT en, CASE WHEN status = 'reviewed' THEN status
  WHEN len(flags) > 0 THEN 'review_required' WHEN status = 'review_required' THEN 'auto_pass' ELSE status END AS status FROM flagged""")
def review_status(spark, sf_dir):
    return D.mark_statuses(D.analyze(M.dictionary(spark, sf_dir))).select("en", F.col("reviewStatus").alias("status"))


@query("H23_apply_review", M.with_sql(M.DICTIONARY) + """, d AS (SELECT *, CAST(substr(en, 5) AS BIGINT) AS n FROM dictionary)
SELECT en, CASE WHEN n % 3 = 0 THEN 'nova ' || n WHEN n % 3 = 1 THEN sr ELSE sr END AS sr, CASE WHEN n % 3 < 2 THEN 'reviewed' ELSE status END AS status,
  CASE WHEN n % 3 = 0 THEN true ELSE manual END AS manual FROM d""")
def apply_review(spark, sf_dir):
    """A third of the keys get a new text in Cyrillic, a third keep theirs, a third are not decided."""
    n = F.col("n")
    rows = M.dictionary(spark, sf_dir).withColumn("n", F.substr("en", F.lit(5)).cast("bigint"))
    decisions = rows.where(n % 3 < 2).select("en", F.when(n % 3 == 0, F.concat(F.lit("нова  "), n.cast("string"))).otherwise(F.col("sr")).alias("approvedSr"))
    out = D.apply_review(rows.drop("n"), decisions)
    return out.select("en", "sr", F.col("reviewStatus").alias("status"), F.col("manualOverride").alias("manual"))


@query("H24_approved_text", rf"""SELECT doc_id, t <> '' AND t = {_COLLAPSED.replace('text', 't')} AND NOT regexp_matches(t, '[^\p{{L}}\p{{Nd}}\p{{Zs}}\p{{P}}]')
  AND NOT regexp_matches(regexp_replace(t, '[A-Za-z\x{{c0}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}\x{{ab30}}-\x{{ab6f}}]', '', 'g'), '\p{{L}}') AS ok
  FROM (SELECT doc_id, text AS t FROM documents)""")
def approved_text(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select("doc_id", "text")
    staged = with_serbian_latin(docs, "text", "normal")
    return staged.select("doc_id", is_approved_serbian(F.col("text"), F.col("normal")).alias("ok"))


@query("H25_text_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return M.table(spark, sf_dir, "documents").select("doc_id", V.text_hash(F.col("text")).alias("hash"))


@query("H26_document_fingerprint", M.with_sql(M.MOVIES) + """SELECT movie_id, sha256('{"fingerprintVersion":"multilingual-document-fingerprint-v1","language":"en","textFormatVersion":"v1","profileFingerprint":"profile","formattedInput":"passage: '
  || title || '"}') AS fingerprint FROM movies""")
def document_fingerprint(spark, sf_dir):
    lit = F.lit
    return M.movies(spark, sf_dir).select("movie_id", V.document_fingerprint(F.col("title"), lit("en"), lit("v1"), lit("profile")).alias("fingerprint"))


@query("H27_encoder_inputs", rf"""SELECT doc_id, md5('passage: ' || text) AS document, md5('query: ' || regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS query,
  md5('title: ' || lang || ' | text: ' || text) AS titled FROM documents""")
def encoder_inputs(spark, sf_dir):
    t = F.col("text")
    return M.table(spark, sf_dir, "documents").select("doc_id", F.md5(TX.document_input(t)).alias("document"), F.md5(TX.query_input(t)).alias("query"),
                                                      F.md5(TX.titled_input(F.col("lang"), t)).alias("titled"))


_V = "CAST(embedding AS DOUBLE[])"


@query("H28_cosine_distance", f"""SELECT vec_id, round(1 - list_dot_product({_V}, list_reverse({_V})) / list_dot_product({_V}, {_V}), 6) + 0.0 AS distance FROM embeddings""")
def cosine_distance(spark, sf_dir):
    e = F.col("embedding")
    return M.table(spark, sf_dir, "embeddings").select("vec_id", V.cosine_distance(e, F.reverse(e)).alias("distance"))


@query("H29_vector_validity", f"""SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, vec_id % 4 <> 0 AND abs(sqrt(list_dot_product(v, v)) - 1) <= 0.0001 AS ok
  FROM (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_transform({_V}, lambda x: 2 * x) ELSE {_V} END AS v FROM embeddings)""")
def vector_validity(spark, sf_dir):
    v = F.when(F.col("vec_id") % 4 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    rows = M.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", V.l2_norm(F.col("v")).alias("norm"), V.is_valid_vector(F.col("v"), 64, 1e-4).alias("ok"))


@query("H30_mean_pool", f"""WITH t AS (SELECT label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings WHERE vec_id % 3 <> 0),
  m AS (SELECT label, i, avg(x) AS x FROM t GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS doc_id, CAST(i - 1 AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) + 0.0 AS value FROM m""")
def mean_pool(spark, sf_dir):
    """The vectors of a label are the token vectors of one document; every third is masked out."""
    tokens = M.table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("embedding").alias("vector"),
                                                         (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    return EM.mean_pool(tokens).select("doc_id", F.posexplode("vector").alias("dim", "v")).select("doc_id", "dim", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("H31_pseudo_vector", """SELECT doc_id, CAST(i AS BIGINT) AS dim, round(CAST(('0x' || substr(h, CAST((i % 32) * 2 + 1 AS BIGINT), 2)) AS BIGINT) / 127.5 - 1, 6) AS value
  FROM (SELECT doc_id, sha256(text) AS h, unnest(range(40)) AS i FROM documents)""")
def pseudo_vector(spark, sf_dir):
    rows = M.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.pseudo_vector(F.col("text"), 40)).alias("dim", "value"))
    return rows


@query("H32_canary", f"""SELECT vec_id AS movie_id, vec_id % 2 = 1 AS ok FROM embeddings""")
def canary(spark, sf_dir):
    """Every second vector has drifted by a thousandth."""
    rows = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie_id"), F.col("embedding").alias("vector"))
    moved = rows.withColumn("vector", F.when(F.col("movie_id") % 2 == 0, F.transform("vector", lambda x: x + F.lit(0.001).cast("float"))).otherwise(F.col("vector")))
    return EM.canary_drift(rows, moved).select("movie_id", "ok")


@query("H33_token_estimate", "SELECT doc_id, greatest(1, (strlen(text) + 3) // 4) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return M.table(spark, sf_dir, "documents").select("doc_id", TX.token_estimate(F.col("text")).alias("tokens"))


@query("H34_same_number", "SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_orderkey % 9 <> 5 AS same FROM orders")
def same_number(spark, sf_dir):
    """The same order number written in other ways, another number, and texts that are no numbers."""
    k = F.col("o_orderkey")
    whole = F.when(k % 9 == 5, F.lit("abc")).otherwise(k.cast("string"))
    other = (F.when(k % 9 == 5, F.when(k % 2 == 0, F.lit("abc")).otherwise(F.lit("0"))).when(k % 4 == 0, F.concat(whole, F.lit(".000"))).when(k % 4 == 1, F.concat(whole, F.lit("00e-2")))
             .when(k % 4 == 2, F.concat(F.lit("0"), whole)).otherwise(F.concat(whole, F.lit("1"))))
    return M.table(spark, sf_dir, "orders").select("o_orderkey", TX.same_number(whole, other).alias("same"))


@query("H35_same_json", "SELECT event_id, event_id % 3 <> 2 AS same FROM events")
def same_json(spark, sf_dir):
    """The event as an object, with its keys in another order and, for every third, another value."""
    e = M.table(spark, sf_dir, "events")
    left = F.to_json(F.struct("event_type", "user_id", "props"))
    right = F.to_json(F.struct("props", F.when(F.col("event_id") % 3 == 2, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "event_type"))
    return e.select("event_id", CR.same_json(left, right).alias("same"))


@query("H36_parser_comparison", M.with_sql(M.CRITERIA, _EXPECTED) + """SELECT query_id AS case_id, type <> 'invalid' AND NOT (c_custkey % 11 = 0 AND type = 'query') AS filters_match,
  type = 'query' AND c_custkey % 13 <> 0 AS semantic_match FROM judged""")
def parser_comparison(spark, sf_dir):
    """Answers compared with themselves after some years and some texts were changed."""
    parsed = materialize(CR.parse_criteria(answers(spark, sf_dir)), "parsed")
    actual = parsed.withColumnRenamed("query_id", "case_id")
    c = F.col("case_id").cast("bigint")
    expected = actual.withColumn("year_min", F.when((c % 11 == 0) & (F.col("type") == "query"), F.coalesce("year_min", F.lit(0)) + 1).otherwise(F.col("year_min"))).withColumn(
        "semantic_query", F.when(c % 13 == 0, F.lit("other text")).otherwise(F.col("semantic_query")))
    return CR.compare_parser(expected, actual).select("case_id", "filters_match", "semantic_match")


@query("H37_local_day", "SELECT event_id, CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day FROM events")
def local_day(spark, sf_dir):
    """January lies outside daylight saving time."""
    return M.table(spark, sf_dir, "events").select("event_id", TX.local_day(F.col("ts")).alias("day"))


@query("H38_stratum_key", M.with_sql(M.MOVIES) + """SELECT movie_id, CASE WHEN year < 1960 THEN '0-pre1960' WHEN year <= 1979 THEN '1-1960-1979'
  WHEN year <= 1999 THEN '2-1980-1999' WHEN year <= 2009 THEN '3-2000-2009' ELSE '4-2010plus' END || '|' || coalesce(list_sort(genres)[1], '') AS stratum FROM movies""")
def stratum_key(spark, sf_dir):
    return M.movies(spark, sf_dir).select("movie_id", TX.stratum_key(F.col("year"), F.col("genres")).alias("stratum"))


@query("H39_array_validity", """SELECT o_orderkey, o_orderkey % 4 = 0 AS ok FROM orders""")
def array_validity(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    names = (F.when(k % 4 == 0, F.array(a, b)).when(k % 4 == 1, F.array(a, b, a)).when(k % 4 == 2, F.array(a, F.lit("  ")))
             .otherwise(F.array().cast("array<string>")))
    return M.table(spark, sf_dir, "orders").select("o_orderkey", distinct_nonblank(names).alias("ok"))
