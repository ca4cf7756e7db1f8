"""Data-quality rules: boolean columns, counted in one pass, with a quarantine split and a gate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from filmloom import vocab


class Rule(NamedTuple):
    """A row passes when `ok` is true; null counts as a violation."""

    name: str
    ok: Column


class GateError(ValueError):
    """A release gate found violations."""


def failed_rules(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]))


def with_failures(df: DataFrame, rules: Sequence[Rule], column: str = "failed_rules") -> DataFrame:
    return df.withColumn(column, failed_rules(rules))


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, violations) for every rule, from one aggregate over the table."""
    counts = df.agg(*[F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(f"v{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations"))
                      for i, r in enumerate(rules)])
    return counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.violations")


def split_quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    marked = with_failures(df, rules)
    clean = marked.where(F.size("failed_rules") == 0).drop("failed_rules")
    return clean, marked.where(F.size("failed_rules") > 0)


def gate(report: DataFrame, what: str = "input") -> None:
    """Fail the run when a (rule, violations) report holds any violation."""
    bad = report.where(F.col("violations") > 0).limit(50).collect()
    if bad:
        raise GateError(f"{what}: " + ", ".join(f"{r['rule']}={r['violations']}" for r in bad))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row, with their row count. Null keys are not compared."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def duplicate_report(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """(rule, violations): how many distinct key values are repeated, per named key."""
    parts = [duplicates(df, *cols).agg(F.count(F.lit(1)).alias("violations"))
             .select(F.lit(name).alias("rule"), "violations") for name, cols in keys.items()]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionAll(part)
    return report


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row tables side by side."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for f in frames for c in f.columns])


def expected_counts(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Compare a one-row table of counts with expectations given as parameters."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).cast("bigint").alias("actual"),
                               F.lit(value).cast("bigint").alias("expected"))
                      for name, value in expected.items()])
    return (actual.select(F.explode(pairs).alias("p")).select("p.*")
            .withColumn("ok", F.col("actual").eqNullSafe(F.col("expected"))))


def positive_safe_id(column: Column) -> Column:
    return column.between(1, vocab.MAX_SAFE_INTEGER)


def no_line_break(column: Column) -> Column:
    return column.isNull() | ~column.rlike(r"[\r\n]")


def distinct_nonblank(column: Column) -> Column:
    """Array check: not empty, no null or blank element, all different."""
    return ((F.size(column) > 0)
            & ~F.exists(column, lambda x: x.isNull() | x.rlike(r"^\s*$"))
            & (F.size(F.array_distinct(column)) == F.size(column)))


def base_rules() -> list[Rule]:
    """Rules of the base metadata record."""
    c = F.col
    return [
        Rule("id", positive_safe_id(c("movieLensId"))),
        Rule("raw_title", c("rawTitle").isNotNull()),
        Rule("title", F.length(F.trim(c("title"))) > 0),
        Rule("year", c("year").between(1000, 9999)),
        Rule("imdb", c("imdbId").rlike("^[0-9]+$")),
        Rule("rating", c("movieLensAvgRating").between(0, 5)),
        Rule("line_breaks", no_line_break(c("title")) & no_line_break(c("directedByRaw"))
             & no_line_break(c("starringRaw"))),
    ]


def catalog_rules() -> list[Rule]:
    """Rules of the release catalog record."""
    c = F.col
    optional = lambda name, ok: c(name).isNull() | ok
    return [
        Rule("id", positive_safe_id(c("movieLensId"))),
        Rule("title", F.length(F.trim(c("title"))) > 0),
        Rule("year", c("year").between(1000, 9999)),
        Rule("imdb", c("imdbId").rlike("^[0-9]{7,9}$")),
        Rule("tmdb", optional("tmdbId", c("tmdbId") > 0)),
        Rule("runtime", optional("runtimeMinutes", c("runtimeMinutes") > 0)),
        Rule("language", optional("originalLanguage", c("originalLanguage").rlike("^[a-z]{2,3}$"))),
        Rule("poster", optional("posterPath", c("posterPath").rlike(r"^/(?!/)"))),
        Rule("genres", optional("genres", distinct_nonblank(c("genres"))
                                & (F.size(F.array_except(c("genres"), F.array(*map(F.lit, vocab.GENRES)))) == 0))),
        Rule("rating_pair", c("averageRating").isNull() == c("ratingCount").isNull()),
        Rule("rating", optional("averageRating", c("averageRating").between(0, 5))),
        Rule("rating_count", optional("ratingCount", c("ratingCount") >= 0)),
        Rule("details_need_tmdb", c("tmdbId").isNotNull()
             | (c("runtimeMinutes").isNull() & c("originalLanguage").isNull() & c("posterPath").isNull())),
    ]


def tag_rules() -> Rule:
    """The nested tags are named, distinct and finitely scored."""
    tags = F.col("relevantTags")
    names = F.transform(tags, lambda t: t["name"])
    return Rule("tags", tags.isNotNull()
                & ~F.exists(tags, lambda t: t["name"].isNull() | (t["name"] == "") | ~is_finite(t["score"]))
                & (F.size(F.array_distinct(names)) == F.size(names)))


def is_finite(column: Column) -> Column:
    """False for null, NaN and the infinities."""
    value = column.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def movie_table_rules() -> list[Rule]:
    """CHECK constraints of the serving tables, as rules."""
    c = F.col
    optional = lambda name, ok: c(name).isNull() | ok
    return [
        Rule("id_not_null", c("movie_id").isNotNull()),
        Rule("imdb_not_null", c("imdb_id").isNotNull()),
        Rule("title", F.length(F.trim(c("title"))) > 0),
        Rule("year", c("year").between(1000, 9999)),
        Rule("runtime", optional("runtime_minutes", c("runtime_minutes") > 0)),
        Rule("language", optional("original_language", c("original_language").rlike("^[a-z]{2,3}$"))),
        Rule("genres", optional("genres", ~F.exists(c("genres"), lambda g: g.isNull() | (g == "")))),
        Rule("average_rating", optional("average_rating", c("average_rating").between(0, 5))),
        Rule("rating_count", optional("rating_count", c("rating_count") >= 0)),
        Rule("rating_pair", c("average_rating").isNull() == c("rating_count").isNull()),
        Rule("poster", optional("poster_path", F.length(F.trim(c("poster_path"))) > 0)),
        Rule("cast", optional("cast", distinct_nonblank(c("cast")))),
    ]


def vector_pair_rules() -> list[Rule]:
    """Both languages or only English: the Serbian vector and fingerprint come together."""
    c = F.col
    hex64 = "^[0-9a-f]{64}$"
    return [
        Rule("embedding_not_null", c("embedding").isNotNull()),
        Rule("fingerprint", c("document_fingerprint").rlike(hex64)),
        Rule("serbian_pair", c("embedding_sr").isNull() == c("document_fingerprint_sr").isNull()),
        Rule("fingerprint_sr", c("document_fingerprint_sr").isNull() | c("document_fingerprint_sr").rlike(hex64)),
    ]
