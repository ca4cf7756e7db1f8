"""Plans that matter at scale: what is pushed down, and what is cut before a shuffle."""

from __future__ import annotations

from collections import Counter

from filmloom.bindings import model as M
from filmloom.operators import catalog as C, filters as FL, release as R, sampling as SA, search as S
from filmloom.streaming import limits

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_run_before_the_shuffle(spark):
    scores = M.tag_scores(spark, SF).withColumnRenamed("item_id", "movie_id")
    for df in (C.top_tags(scores, "movie_id"), SA.stratified_sample(M.movies(spark, SF), 150, "s"),
               limits.admitted_requests(M.request_log(spark, SF)),
               S.batch_hard_only(M.movies(spark, SF), M.criteria(spark, SF))):
        text = plan(df)
        assert "WindowGroupLimit" in text and "Partial" in text, text


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed("o_custkey", "year")
    text = plan(FL.filter_movies(orders, {"year_min": 10}).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_custkey,10)" in text and "o_totalprice" not in text.split("ReadSchema")[1]


def test_single_searches_keep_no_full_sort(spark):
    vector = [1.0] * 64
    hybrid = plan(S.search_hybrid(M.movies(spark, SF), M.vectors(spark, SF), {"year_min": 1990}, vector, "en"))
    assert "TakeOrderedAndProject" in hybrid
    assert "TakeOrderedAndProject" in plan(S.search_hard_only(M.movies(spark, SF), {"year_min": 1990}))


def test_digest_moves_no_rows(spark):
    text = plan(R.bag_digest(spark.read.parquet(f"{SF}/orders.parquet"), ["o_orderkey", "o_custkey"]))
    assert text.count("Exchange") == 1 and "partial_sum" in text and "Sort" not in text


def test_nothing_is_crossed(spark):
    movies = M.movies(spark, SF)
    serving = S.serving_table(movies, M.vectors(spark, SF))
    for df in (S.batch_hybrid(serving, M.asking(spark, SF)), S.batch_hybrid(serving, M.asking(spark, SF), max_block=8)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_catalog_merge_moves_each_source_once(spark):
    """Base and links are read once for the enriched record; the summed ratings and genres join on the same key."""
    from filmloom.bindings import joins as J
    text = plan(J._enriched(spark, SF))
    assert text.count("FileScan") <= 5 and text.count("Exchange") <= 8, text


def test_query_blocks_leave_movies_in_place(spark):
    """More queries than a block holds: movies are scanned once, never exchanged with their vectors."""
    serving = spark.read.parquet(f"{SF}/embeddings.parquet")
    from pyspark.sql import functions as F
    serving = serving.select(F.col("vec_id").alias("movie_id"), F.lit("en").alias("language"), F.col("embedding").alias("vector"), F.lit(1.0).alias("norm"),
                             *[F.lit(None).cast(t).alias(n) for n, t in (("year", "int"), ("runtime_minutes", "int"), ("genres", "array<string>"), ("cast", "array<string>"),
                                                                          ("original_language", "string"), ("average_rating", "decimal(16,12)"), ("rating_count", "long"))])
    asked = M.asking(spark, SF).where("language = 'en'")
    text = plan(S.batch_hybrid(serving, asked, max_block=8))
    assert text.count("FileScan") == 1 and "embedding" not in "".join(x for x in text.splitlines() if "Exchange" in x)


def test_many_queries_never_pass_the_driver(spark, monkeypatch):
    """20,000 queries in some dozens of blocks: one scan of the movies, and nothing is collected but counts."""
    from pyspark.sql import DataFrame, functions as F
    serving = S.serving_table(M.movies(spark, SF), M.vectors(spark, SF))
    asked = M.asking(spark, SF).withColumn("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20_000 // 150)), lambda k: F.concat("query_id", F.lit("-"), k.cast("string")))))
    assert asked.count() >= 20_000
    few = S.batch_hybrid(serving, asked.where("query_id LIKE '%-7'")).withColumn("query_id", F.split("query_id", "-")[0])
    want = Counter((r.query_id, r["rank"], r.movie_id) for r in few.collect())

    def refused(self):
        raise AssertionError("queries pass the driver")

    monkeypatch.setattr(type(asked), "toArrow", refused)
    found = S.batch_hybrid(serving, asked, max_block=512)
    assert plan(found).count("FileScan") <= 2 * plan(serving).count("FileScan")  # once for each language
    rows = Counter((r.query_id.split("-")[0], r["rank"], r.movie_id) for r in found.collect())
    copies = asked.count() // M.asking(spark, SF).count()
    assert rows == Counter({k: n * copies for k, n in want.items()})
