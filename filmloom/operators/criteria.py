"""Structured criteria: JSON answers of a parser turned into validated filter rows.

Answers are read as VARIANT, which refuses repeated keys at any depth and keeps the JSON types apart, so
one pattern on the value's schema checks a whole closed object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmloom import vocab
from filmloom.functions.normalize import trim_space
from filmloom.functions.text import is_blank, is_semantic_text, rating_threshold
from filmloom.operators.filters import FIELDS, criteria_rules, has_active_filter
from filmloom.operators.rules import Rule, failed_rules
from filmloom.session import spread

_TEXT = "(?:VOID|STRING)"
_LIST = "ARRAY<(?:VOID|STRING)>"
_WHOLE = "(?:VOID|BIGINT)"
_NUMBER = r"(?:VOID|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"


def _object(**fields: str) -> str:
    """Pattern of an object's schema; fields are listed in byte order, as VARIANT lists them."""
    return "OBJECT<" + ", ".join(f"{name}: {kind}" for name, kind in sorted(fields.items())) + ">"


_BOUNDS = _object(status="STRING", min=_WHOLE, max=_WHOLE)
_GENRES = _object(status="STRING", all=_LIST, any=_LIST)
_RATING = _object(status="STRING", value=_NUMBER, operator=_TEXT, scale=_TEXT)
_SCALAR = _object(status="STRING", value=_TEXT)
_ACTORS = _object(status="STRING", all=_LIST, any=_LIST, exclude=_LIST)


def _query_shape(with_actors: bool) -> str:
    extra = {"actors": _ACTORS} if with_actors else {}
    return _object(year=_BOUNDS, runtime=_BOUNDS, genres=_GENRES, rating=_RATING, originalLanguage=_SCALAR,
                   semanticQuery=_TEXT, **extra)


def _answer_shape(with_actors: bool, with_language: bool) -> str:
    extra = {"languageCheck": "STRING"} if with_language else {}
    query = f"(?:VOID|{_query_shape(with_actors)})"
    return "^" + _object(type="STRING", alertCode=_TEXT, query=query, **extra) + "$"


_TEXTS = {"year_status": "year.status", "runtime_status": "runtime.status", "genres_status": "genres.status",
          "rating_status": "rating.status", "rating_operator": "rating.operator", "rating_scale": "rating.scale",
          "language_status": "originalLanguage.status", "language": "originalLanguage.value",
          "semantic": "semanticQuery"}
_WHOLES = {"year_min": "year.min", "year_max": "year.max", "runtime_min": "runtime.min", "runtime_max": "runtime.max"}
_LISTS = {"genres_all": "genres.all", "genres_any": "genres.any"}
_ACTOR_LISTS = {"actors_all": "actors.all", "actors_any": "actors.any", "actors_exclude": "actors.exclude"}
_GROUPS = ["year", "runtime", "genres", "rating", "language", "actors"]


def _fields(answer: Column, with_actors: bool, with_language: bool) -> Column:
    """Values of an answer whose shape is right; those of the query are null in an alert."""
    at = lambda path, kind: F.variant_get(answer, f"$.{path}", kind)
    is_query = F.schema_of_variant(at("query", "variant")) != "VOID"
    inside = lambda path, kind: F.when(is_query, F.try_variant_get(answer, f"$.query.{path}", kind))
    none = F.array().cast("array<string>")
    values = {"type": at("type", "string"), "alert": at("alertCode", "string"),
              "check": at("languageCheck", "string") if with_language else F.lit("match"), "is_query": is_query}
    values |= {name: inside(path, "string") for name, path in _TEXTS.items()}
    values |= {name: inside(path, "bigint") for name, path in _WHOLES.items()}
    values |= {name: inside(path, "array<string>") for name, path in _LISTS.items()}
    values |= {name: inside(path, "array<string>") if with_actors else none for name, path in _ACTOR_LISTS.items()}
    values["actors_status"] = inside("actors.status", "string") if with_actors else F.lit("absent")
    values["rating_value"] = inside("rating.value", "decimal(28,10)")
    return F.struct(*[c.alias(n) for n, c in values.items()])


def _clean_list(values: Column) -> Column:
    return ~F.exists(values, lambda x: x.isNull()) & (F.size(F.array_distinct(values)) == F.size(values))


def _rules(q: Column) -> list[Rule]:
    """All rules of an answer with the right shape; rules of the query pass in an alert."""
    when_query = lambda ok: ~q["is_query"] | ok
    bounded = lambda v, low, high: v.isNull() | v.between(low, high)
    not_blank = lambda v: v.isNull() | ~is_blank(v)
    rating = ["rating_value", "rating_operator", "rating_scale"]
    given, touched = [q[r].isNotNull() for r in rating], F.lit(False)
    for g in given:
        touched = touched | g
    has = {
        "year": q["year_min"].isNotNull() | q["year_max"].isNotNull(),
        "runtime": q["runtime_min"].isNotNull() | q["runtime_max"].isNotNull(),
        "genres": F.size(q["genres_all"]) + F.size(q["genres_any"]) > 0,
        "rating": given[0] & given[1] & given[2], "language": q["language"].isNotNull(),
        "actors": F.size(q["actors_all"]) + F.size(q["actors_any"]) + F.size(q["actors_exclude"]) > 0,
    }
    rules = [Rule(f"{name}_status", when_query(q[f"{name}_status"].isin("present", "absent", "unsupported")
                                               & ((q[f"{name}_status"] == "present") == value)))
             for name, value in has.items()]
    rules += [
        Rule("year_range", when_query(bounded(q["year_min"], 1000, 9999) & bounded(q["year_max"], 1000, 9999))),
        Rule("year_order", when_query(F.coalesce(q["year_min"] <= q["year_max"], F.lit(True)))),
        Rule("runtime_range", when_query(bounded(q["runtime_min"], 1, 2147483647)
                                         & bounded(q["runtime_max"], 1, 2147483647))),
        Rule("runtime_order", when_query(F.coalesce(q["runtime_min"] <= q["runtime_max"], F.lit(True)))),
        Rule("rating_parts", when_query((q["rating_status"] == "present") | ~touched)),
        Rule("rating_words", when_query((q["rating_status"] != "present") | (
            q["rating_operator"].isin("gte", "gt") & q["rating_scale"].isin("five", "ten", "unspecified")))),
        Rule("rating_blank", when_query(not_blank(q["rating_operator"]) & not_blank(q["rating_scale"]))),
        Rule("language_code", when_query(q["language"].isNull() | q["language"].isin(vocab.LANGUAGES))),
        Rule("semantic_text", when_query(q["semantic"].isNull() | is_semantic_text(trim_space(q["semantic"])))),
    ]
    known = F.array(*map(F.lit, vocab.GENRES))
    rules += [Rule(n, when_query(_clean_list(q[n]) & (F.size(F.array_except(q[n], known)) == 0))) for n in _LISTS]
    rules += [Rule(n, when_query(_clean_list(q[n]) & ~F.exists(q[n], lambda x: is_blank(x) | x.rlike(r"\p{Cc}"))))
              for n in _ACTOR_LISTS]
    kind, code, check = q["type"], q["alert"], q["check"]
    return rules + [
        Rule("type", kind.isin("query", "alert")),
        Rule("language_check", check.isin("match", "mismatch", "unclear")),
        Rule("branch", F.when(kind == "query", q["is_query"] & code.isNull() & (check == "match"))
             .when(kind == "alert", ~q["is_query"] & code.isNotNull())),
        Rule("alert_code", (kind != "alert")
             | F.when(check == "mismatch", code == "LANGUAGE_MISMATCH")
             .when(check == "unclear", code == "QUERY_UNCLEAR").otherwise(code.isin(vocab.ALERT_CODES))),
    ]


def _outcome(q: Column) -> dict[str, Column]:
    """Filter columns and flags of an answer whose rules hold."""
    given = lambda v: F.when(F.size(v) > 0, v)
    present = q["rating_status"] == "present"
    unsupported = F.lit(False)
    for name in _GROUPS:
        unsupported = unsupported | F.coalesce(q[f"{name}_status"] == "unsupported", F.lit(False))
    out = {n: q[n].cast("int") for n in _WHOLES}
    out |= {n: given(q[n]) for n in [*_LISTS, *_ACTOR_LISTS]}
    out |= {"rating_min": F.when(present, rating_threshold(q["rating_value"], q["rating_scale"])),
            "rating_operator": F.when(present, q["rating_operator"]), "original_language": q["language"],
            "semantic_query": trim_space(q["semantic"]), "unsupported": unsupported,
            "unscaled": F.coalesce(present & rating_threshold(q["rating_value"], q["rating_scale"]).isNull(), F.lit(False))}
    return out


def _checklist(q: Column, with_actors: bool) -> Column:
    """The accepted fields as JSON; semantic text only as present or absent."""
    group = lambda name, **parts: F.struct(q[f"{name}_status"].alias("status"),
                                           *[q[v].alias(k) for k, v in parts.items()])
    parts = [q["type"].alias("type"), group("year", min="year_min", max="year_max").alias("year"),
             group("runtime", min="runtime_min", max="runtime_max").alias("runtime"),
             group("genres", all="genres_all", any="genres_any").alias("genres"),
             group("rating", value="rating_value", operator="rating_operator", scale="rating_scale").alias("rating"),
             group("language", value="language").alias("originalLanguage"),
             F.when(q["semantic"].isNull(), "absent").otherwise("present").alias("semanticQuery")]
    if with_actors:
        parts.append(group("actors", all="actors_all", any="actors_any", exclude="actors_exclude").alias("actors"))
    alert = F.to_json(F.struct(q["type"].alias("type"), q["alert"].alias("alertCode")))
    return F.when(q["is_query"], F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})).otherwise(alert)


def parse_criteria(answers: DataFrame, json: str = "answer", with_actors: bool = True,
                   with_language: bool = True) -> DataFrame:
    """Adds type ('query', 'alert' or 'invalid'), alert_code, language_check, the filter columns,
    semantic_query, checklist (the accepted fields as JSON) and failed (names of broken rules).

    Proposed actor names stay as they are; `resolve_actors` looks them up in the catalog. Several steps read
    the result, so write it once (`session.materialize`) rather than filter the unparsed answers again.
    """
    shape = _answer_shape(with_actors, with_language)
    # One step reads the answer, one takes its fields, one judges them: each value is computed once, in generated code.
    read = spread(answers).select("*", F.try_parse_json(F.col(json)).alias("_answer"))
    typed = read.select(*answers.columns, F.when(F.coalesce(F.schema_of_variant("_answer").rlike(shape), F.lit(False)),
                                                 _fields(F.col("_answer"), with_actors, with_language)).alias("_q"))
    q, f = F.col("_q"), F.col("_out")
    outcome = F.struct(*[c.alias(n) for n, c in _outcome(q).items()])
    judged = typed.select("*", F.when(q.isNotNull(), failed_rules(_rules(q))).alias("_failed"), F.when(q.isNotNull(), outcome).alias("_out"))
    ok = q.isNotNull() & (F.size("_failed") == 0)
    alerting = q["is_query"] & (f["unsupported"] | f["unscaled"])
    nothing = q["is_query"] & ~alerting & f["semantic_query"].isNull() & ~has_active_filter({n: f[n] for n in FIELDS})
    flagged = judged.select("*", alerting.alias("_alerting"), F.coalesce(ok & ~nothing, F.lit(False)).alias("_good"),
                            F.when(q.isNull(), F.array(F.lit("shape"))).when(ok & nothing, F.array(F.lit("nothing_asked")))
                            .otherwise(F.col("_failed")).alias("_broken"))
    alerting, good = F.col("_alerting"), F.col("_good")
    is_row = good & q["is_query"] & ~alerting
    return flagged.select(
        *answers.columns, F.when(~good, "invalid").when(alerting, "alert").otherwise(q["type"]).alias("type"),
        F.when(good, F.when(alerting, "UNSUPPORTED_REQUEST").otherwise(q["alert"])).alias("alert_code"),
        F.when(good, q["check"]).alias("language_check"), *[F.when(is_row, f[n]).alias(n) for n in FIELDS],
        F.when(is_row, f["semantic_query"]).alias("semantic_query"),
        F.when(good, _checklist(q, with_actors)).alias("checklist"), F.col("_broken").alias("failed"))


# The language checks and alert codes that may stand together.
_ALERTS_BY_CHECK = {"match": vocab.ALERT_CODES, "mismatch": ["LANGUAGE_MISMATCH"], "unclear": ["QUERY_UNCLEAR"]}


def result_rules(with_actors: bool = True) -> list[Rule]:
    """Second look at a typed result: language check, type and alert code must agree and the filters be valid."""
    kind, code, check = F.col("type"), F.col("alert_code"), F.col("language_check")
    has_row = has_active_filter() | F.col("semantic_query").isNotNull()
    allowed = F.lit(False)
    for word, codes in _ALERTS_BY_CHECK.items():
        allowed = allowed | ((check == word) & code.isin(codes))
    alert_ok = allowed & ~has_row
    filters_ok = F.size(failed_rules(criteria_rules())) == 0
    semantic = F.col("semantic_query")
    query_ok = ((check == "match") & code.isNull() & filters_ok
                & F.when(semantic.isNull(), has_active_filter()).otherwise(is_semantic_text(semantic)))
    if not with_actors:
        query_ok = query_ok & F.col("actors_all").isNull() & F.col("actors_any").isNull() & F.col("actors_exclude").isNull()
    return [Rule("result", F.when(kind == "alert", alert_ok).when(kind == "query", query_ok).otherwise(F.lit(False)))]


def compare_parser(expected: DataFrame, actual: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Expected against actual parser answers: checklist, filters, semantic text and alert, per case.

    `expected` holds the checklist JSON, type, alert_code, the filter columns and semantic_query. JSON is
    compared without regard to key order; in filters a missing value equals a null one.
    """
    e, a = expected.alias("e"), actual.alias("a")
    joined = e.join(a, F.col(f"e.{case_id}") == F.col(f"a.{case_id}"))
    same_filters = F.lit(True)
    for f in FIELDS:
        same_filters = same_filters & F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))
    expected_alert = F.col("e.alert_code")
    is_query = F.col("a.type") == "query"
    return joined.select(
        F.col(f"e.{case_id}"),
        F.coalesce(same_json(_without_semantic("e.checklist"), _without_semantic("a.checklist")),
                   F.lit(False)).alias("checklist_match"),
        F.coalesce(F.when(expected_alert.isNotNull(), (F.col("a.type") == "alert")
                          & (F.col("a.alert_code") == expected_alert))
                   .otherwise(is_query & same_filters), F.lit(False)).alias("filters_match"),
        F.coalesce(is_query & (F.col("e.type") == "query")
                   & F.col("e.semantic_query").eqNullSafe(F.col("a.semantic_query")),
                   F.lit(False)).alias("semantic_match"),
        F.col("a.alert_code").alias("alert_code"))


def _without_semantic(column: str) -> Column:
    """The checklist without its semantic text: the map of the remaining raw values."""
    fields = F.from_json(F.col(column), "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: k != "semanticQuery"))


def same_json(left: Column, right: Column) -> Column:
    """Equality of two JSON texts up to key order and spacing."""
    return canonical_json(left) == canonical_json(right)


def canonical_json(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))
