"""Hard filters: one predicate builder for literal and for column operands."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from filmloom import vocab
from filmloom.functions.normalize import nfc, trim_space
from filmloom.functions.text import is_blank
from filmloom.operators.rules import Rule

FIELDS = ["year_min", "year_max", "runtime_min", "runtime_max", "genres_all", "genres_any", "rating_min",
          "rating_operator", "original_language", "actors_all", "actors_any", "actors_exclude"]
ACTOR_FIELDS = ["actors_all", "actors_any", "actors_exclude"]
ARRAY_FIELDS = ["genres_all", "genres_any"] + ACTOR_FIELDS

MOVIE_COLUMNS = {"year": "year", "runtime": "runtime_minutes", "genres": "genres", "rating": "average_rating",
                 "language": "original_language", "cast": "cast"}


def _contains_all(values: Column, wanted: Any) -> Column:
    if isinstance(wanted, Column):
        return values.isNotNull() & (F.size(F.array_except(wanted, values)) == 0)
    return reduce(lambda a, b: a & b, [F.array_contains(values, w) for w in wanted])


def _overlaps(values: Column, wanted: Any) -> Column:
    other = wanted if isinstance(wanted, Column) else F.array(*map(F.lit, wanted))
    return F.arrays_overlap(values, other)


def predicates(criteria: Mapping[str, Any], movie: Mapping[str, str] | None = None,
               with_actors: bool = True) -> list[Column]:
    """One column per filter. A literal None adds nothing; a null in a column operand passes every row."""
    names = {**MOVIE_COLUMNS, **(movie or {})}
    m = {key: F.col(name) for key, name in names.items()}
    operator = criteria.get("rating_operator")

    def above(threshold):
        if isinstance(operator, Column):
            return F.when(operator == "gt", m["rating"] > threshold).otherwise(m["rating"] >= threshold)
        return m["rating"] > threshold if operator == "gt" else m["rating"] >= threshold

    tests = {
        "year_min": lambda v: m["year"] >= v,
        "year_max": lambda v: m["year"] <= v,
        "runtime_min": lambda v: m["runtime"] >= v,
        "runtime_max": lambda v: m["runtime"] <= v,
        "genres_all": lambda v: _contains_all(m["genres"], v),
        "genres_any": lambda v: _overlaps(m["genres"], v),
        "rating_min": above,
        "original_language": lambda v: m["language"] == v,
    }
    if with_actors:
        known = lambda: F.coalesce(F.size(m["cast"]) > 0, F.lit(False))
        tests |= {
            "actors_all": lambda v: known() & _contains_all(m["cast"], v),
            "actors_any": lambda v: known() & _overlaps(m["cast"], v),
            "actors_exclude": lambda v: known() & ~_overlaps(m["cast"], v),
        }
    active = []
    for field, test in tests.items():
        operand = criteria.get(field)
        if operand is None:
            continue
        passes = F.coalesce(test(operand), F.lit(False)) if isinstance(operand, Column) else test(operand)
        active.append(operand.isNull() | passes if isinstance(operand, Column) else passes)
    return active


def matches(criteria: Mapping[str, Any], movie: Mapping[str, str] | None = None, with_actors: bool = True) -> Column:
    """Conjunction of all active filters; true when there is none."""
    return reduce(lambda a, b: a & b, predicates(criteria, movie, with_actors), F.lit(True))


def complies(criteria: Mapping[str, Any], movie: Mapping[str, str] | None = None) -> Column:
    """The evaluation's predicate: unknown metadata fails, actors are not looked at, never null."""
    return F.coalesce(matches(criteria, movie, with_actors=False), F.lit(False))


def filter_movies(movies: DataFrame, criteria: Mapping[str, Any], movie: Mapping[str, str] | None = None) -> DataFrame:
    """Unranked read. Literal operands reach the scan as pushed filters."""
    return movies.where(matches(criteria, movie))


def by_ids(movies: DataFrame, ids: DataFrame, key: str = "movie_id") -> DataFrame:
    return movies.join(ids.select(key).distinct(), key, "left_semi")


def columns_of(alias: str = "") -> dict[str, Column]:
    """The criteria columns of a queries table as operands."""
    prefix = f"{alias}." if alias else ""
    return {field: F.col(f"{prefix}{field}") for field in FIELDS}


def has_active_filter(q: Mapping[str, Column] | None = None) -> Column:
    q = q or columns_of()
    return reduce(lambda a, b: a | b, [q[f].isNotNull() for f in FIELDS if f != "rating_operator"])


def applicable_mode(mode: Column, semantic: Column, q: Mapping[str, Column] | None = None) -> Column:
    active, worded = has_active_filter(q), ~is_blank(semantic)
    return F.coalesce(F.when(mode == "structured", active).when(mode == "semantic", worded)
                      .when(mode == "hybrid", active & worded), F.lit(False))


def _if_given(column: Column, ok: Column) -> Column:
    return column.isNull() | F.coalesce(ok, F.lit(False))


def criteria_rules(q: Mapping[str, Column] | None = None) -> list[Rule]:
    """Validity of a filter row. Actor names must be composed, trimmed and free of controls."""
    q = q or columns_of()

    def label_list(field: str) -> Column:
        v = q[field]
        known = F.size(F.array_except(v, F.array(*map(F.lit, vocab.GENRES)))) == 0
        return _if_given(v, (F.size(v) > 0) & known & (F.size(F.array_distinct(v)) == F.size(v)))

    def name_list(field: str) -> Column:
        v = q[field]
        joined = F.array_join(v, "\n")
        composed = nfc(joined) == joined
        clean = F.forall(v, lambda n: n.isNotNull() & ~is_blank(n) & (n == trim_space(n)) & ~n.rlike(r"\p{Cc}"))
        return _if_given(v, (F.size(v) > 0) & clean & composed & (F.size(F.array_distinct(v)) == F.size(v)))

    return [
        Rule("year_min", _if_given(q["year_min"], q["year_min"].between(1000, 9999))),
        Rule("year_max", _if_given(q["year_max"], q["year_max"].between(1000, 9999))),
        Rule("year_order", _if_given(q["year_min"], q["year_max"].isNull() | (q["year_min"] <= q["year_max"]))),
        Rule("runtime_min", _if_given(q["runtime_min"], q["runtime_min"] >= 1)),
        Rule("runtime_max", _if_given(q["runtime_max"], q["runtime_max"] >= 1)),
        Rule("runtime_order",
             _if_given(q["runtime_min"], q["runtime_max"].isNull() | (q["runtime_min"] <= q["runtime_max"]))),
        Rule("rating_min", _if_given(q["rating_min"], q["rating_min"].between(0, 5))),
        Rule("rating_operator", _if_given(q["rating_operator"], q["rating_operator"].isin("gte", "gt")
                                          & q["rating_min"].isNotNull())),
        Rule("original_language", _if_given(q["original_language"], q["original_language"].isin(vocab.LANGUAGES))),
        Rule("genres_all", label_list("genres_all")),
        Rule("genres_any", label_list("genres_any")),
        Rule("actors_all", name_list("actors_all")),
        Rule("actors_any", name_list("actors_any")),
        Rule("actors_exclude", name_list("actors_exclude")),
        Rule("actors_contradiction", ~contradicts(q["actors_all"], q["actors_any"], q["actors_exclude"])),
    ]


def contradicts(wanted_all: Column, wanted_any: Column, excluded: Column) -> Column:
    """A name both required and excluded, or every alternative excluded."""
    return (F.coalesce(F.size(F.array_intersect(wanted_all, excluded)) > 0, F.lit(False))
            | F.coalesce(F.size(F.array_except(wanted_any, excluded)) == 0, F.lit(False)))


def unknown_actors(queries: DataFrame, vocabulary: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, name) for requested names that the actor vocabulary does not hold exactly."""
    none = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(F.col(f), none) for f in ACTOR_FIELDS])
    asked = queries.select(query_id, F.explode(names).alias("name")).distinct()
    return asked.join(vocabulary.select("name"), "name", "left_anti").select(query_id, "name")


def result_card(results: DataFrame) -> DataFrame:
    from filmloom.functions.text import poster_url, title_url
    extra = [c for c in ("query_id", "rank") if c in results.columns]
    return results.select(*extra, "movie_id", "title", "year", title_url(F.col("imdb_id")).alias("imdb_url"),
                          poster_url(F.col("poster_path")).alias("poster_url"))
