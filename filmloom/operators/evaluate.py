"""Retrieval evaluation: compliance, mean relevance, precision and nDCG per case and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmloom import vocab
from filmloom.operators.filters import FIELDS, applicable_mode, columns_of, complies, criteria_rules
from filmloom.operators.rules import Rule, failed_rules

TOP = vocab.RESULT_LIMIT
RUN = ["query_id", "mode"]


def judgments_from_json(files: DataFrame, text: str = "value") -> DataFrame:
    """(query_id, movie_id, score, ok) of `{query: {movie: score}}`. Keys may repeat in no object.

    A query whose value is no object, and a document that is none, give one failing row. Scores are JSON numbers, and a
    movie's key is its number as it is written, without leading zeros.
    """
    raw = files.select(text).withColumn("_v", F.try_parse_json(F.col(text)))
    outer = F.coalesce(F.from_json(F.col(text), "map<string,string>"), F.create_map().cast("map<string,string>"))
    queries = raw.select("_v", F.explode_outer(outer).alias("query_id", "_scores"))
    inner = F.when(F.col("_scores").rlike(r"^\s*\{"), F.from_json("_scores", "map<string,string>"))
    rows = queries.withColumn("_w", F.try_parse_json("_scores")).select(
        "query_id", F.col("_v").isNotNull().alias("_unique"), "_w", F.explode_outer(inner).alias("_m", "_s"))
    plain = F.coalesce(F.col("_m").rlike("^(0|[1-9][0-9]*)$"), F.lit(False))
    movie = F.when(plain, F.expr("try_cast(_m AS BIGINT)"))
    kind = F.schema_of_variant(F.try_parse_json("_s"))
    # Texts lose their quotes in a map of texts, so the kind is taken from the document of the query itself.
    quoted = F.regexp_like(F.to_json("_w"), F.concat(F.lit('"'), F.coalesce("_m", F.lit("-")), F.lit('":"')))
    score = F.when((kind == "BIGINT") & ~F.coalesce(quoted, F.lit(False)), F.expr("try_cast(_s AS INT)"))
    ok = F.col("_unique") & movie.isNotNull() & F.coalesce(score.between(0, 3), F.lit(False))
    return rows.select("query_id", movie.alias("movie_id"), score.alias("score"), ok.alias("ok"))


def case_rules() -> list[Rule]:
    """Rules of one evaluation case row (flat: filters and semantic_query beside the flags)."""
    c = F.col
    modes = c("applicableModes")
    known = F.size(F.array_except(modes, F.array(*map(F.lit, vocab.EVALUATION_MODES)))) == 0
    q = columns_of()
    applicable = F.lit(True)
    for mode in vocab.EVALUATION_MODES:
        applicable = applicable & (~F.array_contains(modes, mode) | applicable_mode(F.lit(mode), c("semantic_query"), q))
    return [
        Rule("id", F.length(F.trim(c("id"))) > 0),
        Rule("language", c("language").isin("sr", "en")),
        Rule("query", F.length(F.trim(c("query"))) > 0),
        Rule("parser_flag", c("parserEval") == c("parserExpected").isNotNull()),
        Rule("retrieval_flag", c("retrievalEval") == c("has_retrieval")),
        Rule("modes_without_evaluation", c("parserEval") | c("retrievalEval") | (F.size(modes) == 0)),
        Rule("modes", known & (F.size(F.array_distinct(modes)) == F.size(modes))),
        Rule("filters", ~c("retrievalEval") | (F.size(failed_rules(criteria_rules(q))) == 0)),
        Rule("applicable", ~c("retrievalEval") | (applicable & (F.size(modes) > 0))),
    ]


def schema_rule() -> Rule:
    """The document that a case stands in names the known schema."""
    return Rule("schema", F.col("schemaVersion") == vocab.EVALUATION_SCHEMA)


def repeated_cases(cases: DataFrame) -> DataFrame:
    """(id, cases) of ids that stand for more than one case."""
    return cases.groupBy("id").agg(F.count(F.lit(1)).alias("cases")).where("cases > 1")


def flatten_cases(cases: DataFrame) -> DataFrame:
    """Nested retrievalQuery to filter columns."""
    h = "retrievalQuery.hardFilters"
    paths = {"year_min": "yearMin", "year_max": "yearMax", "runtime_min": "runtimeMin", "runtime_max": "runtimeMax",
             "genres_all": "genres.all", "genres_any": "genres.any", "rating_min": "ratingMin",
             "rating_operator": "ratingOperator", "original_language": "originalLanguage", "actors_all": "actors.all",
             "actors_any": "actors.any", "actors_exclude": "actors.exclude"}
    plain = [c for c in cases.columns if c != "retrievalQuery"]
    return cases.select(*plain, F.col("retrievalQuery").isNotNull().alias("has_retrieval"),
                        *[F.col(f"{h}.{paths[f]}").alias(f) for f in FIELDS],
                        F.col("retrievalQuery.semanticQuery").alias("semantic_query"))


def runs(cases: DataFrame) -> DataFrame:
    """One row per case and mode. Mode `semantic` applies no filter, `structured` no semantic text."""
    exploded = cases.select("*", F.explode("applicableModes").alias("mode"))
    return exploded.withColumns({f"applied_{f}": F.when(F.col("mode") != "semantic", F.col(f)) for f in FIELDS}).withColumn(
        "applied_semantic", F.when(F.col("mode") != "structured", F.col("semantic_query")))


def ranked(results: DataFrame, order: list[Column]) -> DataFrame:
    """Position inside the list of a run. Lists hold ten rows at most."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*RUN).orderBy(*order)))


def with_scores(results: DataFrame, judgments: DataFrame) -> DataFrame:
    return results.join(judgments.select("query_id", "movie_id", "score"), ["query_id", "movie_id"], "left")


def with_metadata(results: DataFrame, movies: DataFrame, columns: list[str]) -> DataFrame:
    """Results with metadata; `known` tells whether the movie was found."""
    side = movies.select("movie_id", *columns, F.lit(True).alias("_hit"))
    return results.join(side, "movie_id", "left").withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _discounted(score: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), score) - 1) / F.log2(rank + 1)


def ideal_gain(judgments: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, ideal): gain of the best judged scores in falling order, at most `top` per query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("movie_id"))
    best = judgments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return best.groupBy("query_id").agg(F.sum(_discounted(F.col("score"), F.col("_r"))).alias("ideal"))


def relevance(scored: DataFrame, judgments: DataFrame | None, top: int = TOP) -> DataFrame:
    """(query_id, mode, mean_relevance, precision_at_10, ndcg_at_10), null unless every result is judged.

    The ideal comes from the pooled judgments of the query, or from the returned scores when there are none.
    """
    w = Window.partitionBy(*RUN).orderBy(F.desc("score"), F.asc("movie_id"))
    own = scored.withColumn("_i", F.row_number().over(w))
    per_run = own.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("judged"), F.avg("score").alias("mean"),
        F.count_if(F.col("score") >= 2).alias("hits"),
        F.sum(_discounted(F.col("score"), F.col("rank"))).alias("dcg"),
        F.sum(F.when(F.col("_i") <= top, _discounted(F.col("score"), F.col("_i")))).alias("own_ideal"))
    if judgments is None:
        joined = per_run.withColumn("ideal", F.lit(None).cast("double"))
    else:
        joined = per_run.join(ideal_gain(judgments, top), "query_id", "left")
    ideal = F.coalesce("ideal", "own_ideal")
    full = F.col("n") == F.col("judged")
    return joined.select(
        *RUN, F.when(full, F.col("mean")).alias("mean_relevance"),
        F.when(full, F.col("hits") / F.least(F.lit(top), F.col("n"))).alias("precision_at_10"),
        F.when(full, F.when(ideal == 0, F.lit(0.0)).otherwise(F.try_divide("dcg", ideal))).alias("ndcg_at_10"))


def compliance(run_rows: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, mode, results, partial, violations, percent, expected_ok).

    `results` carries the movies' metadata. The case's own filters are checked, also for mode `semantic`;
    actors are not. Runs without results keep a null percent.
    """
    q = columns_of("q")
    joined = results.alias("r").join(run_rows.alias("q"), RUN)
    ok = complies(q, {"year": "r.year", "runtime": "r.runtime_minutes", "genres": "r.genres",
                      "rating": "r.average_rating", "language": "r.original_language"})
    counted = joined.groupBy(*RUN).agg(F.count(F.lit(1)).alias("results"), F.count_if(~ok).alias("violations"))
    out = run_rows.join(counted, RUN, "left")
    n, bad = F.coalesce("results", F.lit(0)), F.coalesce("violations", F.lit(0))
    return out.select(*RUN, n.alias("results"), ((n > 0) & (n < TOP)).alias("partial"), bad.alias("violations"),
                      F.when(n > 0, (n - bad) * 100.0 / n).alias("percent"),
                      F.when(F.col("expectedNoResults").isNotNull(), F.col("expectedNoResults") == (n == 0))
                      .alias("expected_ok"))


def report(compliance_rows: DataFrame, relevance_rows: DataFrame) -> DataFrame:
    return compliance_rows.join(relevance_rows, RUN, "left")


def markdown(rows: DataFrame) -> DataFrame:
    """(value): the lines of the report as a table, all runs in order; `sinks.write_markdown` writes them from the executors."""
    columns = ["query_id", "mode", "results", "partial", "violations", "percent", "mean_relevance",
               "precision_at_10", "ndcg_at_10"]
    kinds = dict(rows.dtypes)
    cell = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))) if kinds[c] == "double" else
                                F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    first = rows.sparkSession.createDataFrame([(i, "", "", line) for i, line in enumerate(head)], "part int, query_id string, mode string, value string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = rows.select(F.lit(2).alias("part"), F.col("query_id").cast("string").alias("query_id"), "mode", line.alias("value"))
    return first.unionByName(body).orderBy("part", "query_id", "mode").select("value")


def latency_percentiles(log: DataFrame, probabilities: list[float], group: str = "stage", value: str = "millis",
                        ranges: int = 100) -> DataFrame:
    """(group, p, value) by nearest rank, exact.

    Values are counted first and dealt to ranges of about equal numbers of different values, whose bounds come from a
    sketch of each group. Totals of the ranges tell which one holds each rank; only that range is then walked, so no
    task orders a whole group, however its values lie.
    """
    counts = log.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = counts.groupBy(group).agg(F.percentile_approx(F.col(value).cast("double"), steps, F.lit(100 * ranges)).alias("_bounds"))
    below = F.size(F.filter("_bounds", lambda b: b < F.col(value).cast("double"))).cast("long")
    counts = counts.join(bounds, group).select(group, value, "n", below.alias("bucket"))
    buckets = counts.groupBy(group, "bucket").agg(F.sum("n").alias("bn"))
    w = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy(group)
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    placed = buckets.withColumn("upto", F.sum("bn").over(w)).withColumn("total", F.sum("bn").over(all_rows)).select(
        "*", ps.alias("p")).withColumn("target", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("total"), 9))))
    holding = placed.where((F.col("target") <= F.col("upto")) & (F.col("target") > F.col("upto") - F.col("bn"))).select(
        group, "bucket", "p", (F.col("target") - (F.col("upto") - F.col("bn"))).alias("inside"))
    inner = Window.partitionBy(group, "bucket", "p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = counts.join(holding, [group, "bucket"]).withColumn("seen", F.sum("n").over(inner))
    return walked.where((F.col("inside") <= F.col("seen")) & (F.col("inside") > F.col("seen") - F.col("n"))).select(
        group, "p", F.col(value).alias("value"))
