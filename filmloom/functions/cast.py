"""Comma-separated cast lists: names, what was repaired, and why a list is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmloom.functions.binding import let
from filmloom.functions.normalize import trim_space, with_nfc

RULES_VERSION = "cast-source-parser-v1"

_EVENT = "struct<kind:string,raw:string,accepted:string,reason:string>"
_STATE = f"struct<names:array<string>,events:array<{_EVENT}>,error:string>"

# The text of each repair note.
REASONS = {
    "trailing-empty-separator": "Reviewed single final empty comma token; no actor inferred.",
    "suffix-attachment": "Exact standalone Jr. attaches to preceding source name.",
    "reviewed-entity-override": "Reviewed source numeric entity decoding; not a person alias.",
    "exact-duplicate-suppression": "Retained first ordinal exact occurrence.",
    "reviewed-empty-separator-override": "Reviewed single empty boundary between exact source neighbors; no actor inferred.",
}
REFUSED_WORDS = ["Sr.", "II", "III", "IV"]

OVERRIDE_FIELDS = ["gap_before", "gap_after", "entity_raw", "entity_accepted"]


def _event(kind: str, raw: Column, accepted: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), accepted.alias("accepted"),
                    F.lit(REASONS[kind]).alias("reason"))


def _step(raw: Column, gap_before: Column, gap_after: Column, entity_raw: Column, entity_accepted: Column):
    """One token of the left-to-right fold."""
    def step(state: Column, token: Column) -> Column:
        names, events, name = state["names"], state["events"], token["name"]
        last = F.element_at(names, -1)
        known = F.size(names) > 0

        def keep(new_names=names, new_event=None):
            new_events = events if new_event is None else F.array_append(events, new_event)
            return F.struct(new_names.alias("names"), new_events.alias("events"),
                            F.lit(None).cast("string").alias("error")).cast(_STATE)

        def refuse(reason: str):
            return F.struct(names.alias("names"), events.alias("events"), F.lit(reason).alias("error")).cast(_STATE)

        last_name = F.when(known, last)
        trailing = token["is_last"] & (token["position"] > 0) & known & (token["before"] != "")
        gap = ((token["position"] > 0) & ~token["is_last"] & known & (last_name == gap_before)
               & (token["before"] == gap_before) & (token["after"] == gap_after)
               & ~F.exists(events, lambda e: e["kind"] == "reviewed-empty-separator-override"))
        fixed = F.when(name == entity_raw, entity_accepted).otherwise(name)
        with_suffix = F.concat(last_name, F.lit(", Jr."))
        return (
            F.when(state["error"].isNotNull(), state)
            .when(name == "",
                  F.when(trailing, keep(new_event=_event("trailing-empty-separator", raw, F.array_join(names, ", "))))
                  .when(F.coalesce(gap, F.lit(False)), keep(new_event=_event(
                      "reviewed-empty-separator-override",
                      F.concat_ws(",", token["raw_before"], token["raw"], token["raw_after"]),
                      F.concat_ws(", ", gap_before, gap_after))))
                  .otherwise(refuse("empty token")))
            .when(name.rlike(r"\p{Cc}"), refuse("control character"))
            .when(name == "Jr.",
                  F.when(~known | last_name.endswith(", Jr."), refuse("ambiguous suffix"))
                  .otherwise(keep(F.array_append(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), with_suffix),
                                  _event("suffix-attachment", with_suffix, with_suffix))))
            .when(fixed.contains("&") | fixed.contains(";") | fixed.isin(REFUSED_WORDS), refuse("unreviewed grammar"))
            .when(name == entity_raw, keep(F.array_append(names, fixed),
                                           _event("reviewed-entity-override", name, fixed)))
            .otherwise(keep(F.array_append(names, name)))
        )
    return step


def parse_cast(raw: Column, composed: Column, overrides: dict[str, Column] | None = None) -> Column:
    """struct(names, events, error) of a composed list; `raw` is kept in the notes. Null stays null."""
    none = F.lit(None).cast("string")
    given = {field: (overrides or {}).get(field, none) for field in OVERRIDE_FIELDS}
    empty = F.struct(F.array().cast("array<string>").alias("names"),
                     F.array().cast(f"array<{_EVENT}>").alias("events"), none.alias("error")).cast(_STATE)

    def folded(parts: Column, cleaned: Column) -> Column:
        tokens = F.transform(parts, lambda part, i: F.struct(
            F.get(cleaned, i).alias("name"), part.alias("raw"), i.alias("position"),
            (i == F.size(parts) - 1).alias("is_last"),
            F.get(cleaned, i - 1).alias("before"), F.get(cleaned, i + 1).alias("after"),
            F.get(parts, i - 1).alias("raw_before"), F.get(parts, i + 1).alias("raw_after")))
        return F.aggregate(tokens, empty, _step(raw, **given))

    # Both lists are made once for a row, not once more for each token.
    return let(F.split(composed, ",", -1), lambda parts: let(F.transform(parts, trim_space), lambda cleaned: folded(parts, cleaned)))


def first_occurrences(names: Column) -> Column:
    """A list without repeats, each entry where it occurred first."""
    return F.array_distinct(names)


def with_cast(df: DataFrame, raw: str = "starringRaw", key: str = "movieLensId",
              overrides: DataFrame | None = None) -> DataFrame:
    """Adds `cast`, `cast_events` and `cast_error`.

    `overrides` is the reviewed table (key, gap_before, gap_after, entity_raw, entity_accepted), one
    row per key.
    """
    given = None
    if overrides is not None:
        renamed = overrides.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in OVERRIDE_FIELDS])
        df = df.join(renamed, key, "left")
        given = {f: F.col(f"_{f}") for f in OVERRIDE_FIELDS}
    composed = with_nfc(df, raw, "_composed")
    parsed = composed.withColumn("_parsed", parse_cast(F.col(raw), F.col("_composed"), given))
    names, bad = F.col("_parsed.names"), F.col("_parsed.error").isNotNull()
    repeats = F.filter(F.transform(names, lambda n, i: F.when(F.array_position(names, n) <= i, n)),
                       lambda n: n.isNotNull())
    repeat_events = F.transform(repeats, lambda n: _event("exact-duplicate-suppression", n, n).cast(_EVENT))
    out = parsed.select(
        *[c for c in df.columns if not (overrides is not None and c[1:] in OVERRIDE_FIELDS)],
        F.when(~bad, first_occurrences(names)).alias("cast"),
        F.when(~bad, F.concat(F.col("_parsed.events"), repeat_events)).alias("cast_events"),
        F.col("_parsed.error").alias("cast_error"))
    return out


def cast_events(parsed: DataFrame, key: str = "movieLensId") -> DataFrame:
    """One row per repair: key, kind, raw, accepted, reason.

    For an inner explode Spark infers a filter on the list's size and pushes it below the parser, where it repeats the
    whole parser several times in each row. Lists are therefore exploded with their empty ones, which go afterwards.
    """
    each = parsed.select(key, F.explode_outer("cast_events").alias("e"))
    return each.where(F.col("e").isNotNull()).select(key, "e.*")


def event_inventory(parsed: DataFrame, key: str = "movieLensId") -> DataFrame:
    return cast_events(parsed, key).groupBy("kind").agg(F.count(F.lit(1)).alias("events"))
