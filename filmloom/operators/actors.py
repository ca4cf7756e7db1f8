"""Actor vocabulary, spelling collisions and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmloom.functions.normalize import nfc, trim_space, with_nfc
from filmloom.functions.text import is_blank
from filmloom.operators.filters import ACTOR_FIELDS, contradicts
from filmloom.operators.rules import Rule


def vocabulary(movies: DataFrame, cast: str = "cast") -> DataFrame:
    return movies.select(F.explode(cast).alias("name")).distinct()


def case_collisions(movies: DataFrame, key: str = "movie_id", cast: str = "cast") -> DataFrame:
    """(folded, name, movie) rows of names that differ from another name by case only.

    Kept as rows: a popular name may stand in a third of all movies, which no single list should hold.
    """
    uses = movies.select(key, F.explode(cast).alias("name")).withColumn("folded", F.upper("name"))
    names = uses.select("folded", "name").distinct()
    colliding = names.groupBy("folded").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return uses.join(colliding.select("folded"), "folded", "left_semi").select("folded", "name", key)


def registry_rules() -> list[Rule]:
    """Names are composed, trimmed, not blank and free of control characters."""
    name = F.col("name")
    return [Rule("name", ~is_blank(name) & (name == trim_space(name)) & ~name.rlike(r"\p{Cc}") & (nfc(name) == name))]


def _key(df: DataFrame, name: str) -> DataFrame:
    return with_nfc(df, trim_space(F.col(name)), "key").withColumn("key", F.upper("key"))


def resolution_table(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, target): the one name a folded spelling stands for, null when it is ambiguous, plus aliases.

    An alias never takes over a key that the registry holds, even an ambiguous one.
    """
    keyed = _key(names.select("name").distinct(), "name")
    table = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("only")).select(
        "key", F.when(F.col("n") == 1, F.col("only")).alias("target"))
    if aliases is None:
        return table
    extra = _key(aliases, "alias").join(table, "key", "left_anti").select("key", "target")
    return table.unionByName(extra)


def alias_problems(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, problem): unknown targets, collisions with registry keys, and repeated aliases."""
    keyed = _key(aliases, "alias")
    bad = keyed.where(is_blank(F.col("alias")) | F.col("alias").rlike(r"\p{Cc}")).select("alias", F.lit("invalid").alias("problem"))
    unknown = keyed.join(names.select(F.col("name").alias("target")), "target", "left_anti").select(
        "alias", F.lit("unknown target").alias("problem"))
    taken = keyed.join(_key(names, "name").select("key").distinct(), "key", "left_semi").select(
        "alias", F.lit("registry key").alias("problem"))
    repeated_keys = keyed.groupBy("key").count().where("count > 1")
    repeated = keyed.join(repeated_keys, "key", "left_semi").select("alias", F.lit("repeated").alias("problem"))
    return bad.unionAll(unknown).unionAll(taken).unionAll(repeated)


def resolve_names(proposed: DataFrame, names: DataFrame, aliases: DataFrame | None = None,
                  column: str = "proposed") -> DataFrame:
    """Adds `resolved`: the exact name, else the single folded match, else an alias, else null."""
    wanted = _key(proposed.select(column).distinct(), column)
    exact = names.select(F.col("name").alias("_exact")).distinct()
    table = resolution_table(names, aliases)
    valid = ~is_blank(F.col(column)) & ~F.col(column).rlike(r"\p{Cc}")
    answers = (wanted.join(exact, wanted[column] == exact["_exact"], "left")
               .join(table, "key", "left")
               .select(column, F.when(valid, F.coalesce("_exact", "target")).alias("resolved")))
    return proposed.join(answers, column, "left")


def resolve_actors(criteria: DataFrame, names: DataFrame, aliases: DataFrame | None = None,
                   query_id: str = "query_id") -> DataFrame:
    """Replace the proposed names of query rows with catalog names.

    Unresolved or contradictory names turn the row into a QUERY_UNCLEAR alert; two proposals in one group
    that mean the same person make it invalid.
    """
    groups = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("names")) for f in ACTOR_FIELDS]))
    asked = (criteria.where(F.col("type") == "query").select(query_id, groups.alias("g"))
             .select(query_id, "g.field", F.posexplode("g.names").alias("pos", "proposed")))
    resolved = resolve_names(asked, names, aliases)
    # A group is one filter list of one query, so it is as small as the list it came from.
    lists = resolved.groupBy(query_id).pivot("field", ACTOR_FIELDS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "resolved"))), lambda s: s["resolved"]).alias("names"),
        F.count_if(F.col("resolved").isNull()).alias("missing"),
        (F.count("resolved") - F.count_distinct("resolved")).alias("repeats"))
    total = lambda what: sum((F.coalesce(F.col(f"{f}_{what}"), F.lit(0)) for f in ACTOR_FIELDS), F.lit(0))
    flagged = lists.select(query_id, *[F.col(f"{f}_names").alias(f"_{f}") for f in ACTOR_FIELDS],
                           (total("repeats") > 0).alias("_repeated"), (total("missing") > 0).alias("_unresolved"))
    joined = criteria.join(flagged, query_id, "left")
    invalid = F.coalesce(F.col("_repeated"), F.lit(False))
    given = {f: F.when(F.size(f"_{f}") > 0, F.col(f"_{f}")) for f in ACTOR_FIELDS}
    unclear = ~invalid & (F.coalesce(F.col("_unresolved"), F.lit(False))
                          | contradicts(*[given[f] for f in ACTOR_FIELDS]))
    keep = ~invalid & ~unclear
    plain = [c for c in criteria.columns if c not in ACTOR_FIELDS + ["type", "alert_code"]]
    filters = [c for c in plain if c in ("year_min", "year_max", "runtime_min", "runtime_max", "genres_all", "genres_any",
                                         "rating_min", "rating_operator", "original_language", "semantic_query")]
    return joined.select(
        *[F.when(keep, F.col(c)).alias(c) if c in filters else F.col(c) for c in plain],
        F.when(invalid, "invalid").when(unclear, "alert").otherwise(F.col("type")).alias("type"),
        F.when(invalid, F.lit(None)).when(unclear, "QUERY_UNCLEAR").otherwise(F.col("alert_code")).alias("alert_code"),
        *[F.when(keep, given[f]).alias(f) for f in ACTOR_FIELDS])
