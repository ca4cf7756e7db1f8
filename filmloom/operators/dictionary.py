"""Translation dictionary: QA over the whole, reviews, corrections, coverage and key-set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmloom.functions.normalize import with_serbian_latin
from filmloom.functions.text import is_blank
from filmloom.functions.translation import (flag, is_approved_serbian, same_ignoring_case_and_space,
                                            with_entry_flags)
from filmloom.operators.rules import Rule

# Fixed values of a full review.
DISPOSITIONS = ["corrected", "accepted_unchanged", "ambiguous_general", "retained_baseline"]
CONFIDENCES = ["high", "medium", "low"]


def collisions(entries: DataFrame, normal: str = "sr_normal") -> DataFrame:
    """Folded texts shared by more than one English key."""
    keys = entries.select(F.upper(normal).alias("folded"), "en").distinct()
    return keys.groupBy("folded").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") > 1)


def analyze(dictionary: DataFrame) -> DataFrame:
    """Entries with `flags`, the row-local ones and sr_collision."""
    checked = with_entry_flags(dictionary).withColumn("_folded", F.upper("sr_normal"))
    shared = collisions(checked).select(F.col("folded").alias("_folded"), F.lit(True).alias("_collides"))
    joined = checked.join(shared, "_folded", "left")
    flags = F.when(F.col("_collides"), F.array_append("flags", flag("sr_collision"))).otherwise(F.col("flags"))
    return joined.select(*dictionary.columns, "sr_normal", flags.alias("flags"))


def flagged_status(status: Column, flagged: Column) -> Column:
    """Reviewed entries stay; flagged ones need review; a stale need for review is lifted."""
    return (F.when(status == "reviewed", status).when(flagged, "review_required")
            .when(status == "review_required", "auto_pass").otherwise(status))


def mark_statuses(analyzed: DataFrame) -> DataFrame:
    return analyzed.withColumn("reviewStatus", flagged_status(F.col("reviewStatus"), F.size("flags") > 0))


def summary(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("reviewStatus").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("manualOverride").alias("overridden"))


def apply_review(dictionary: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved texts are normalized; a changed text sets manualOverride for good."""
    approved = with_serbian_latin(decisions.select("en", "approvedSr"), "approvedSr", "_new")
    joined = dictionary.join(approved.select("en", "_new"), "en", "left")
    hit = F.col("_new").isNotNull()
    return joined.select(
        "en", "machine", F.when(hit, F.col("_new")).otherwise(F.col("sr")).alias("sr"),
        F.when(hit, "reviewed").otherwise(F.col("reviewStatus")).alias("reviewStatus"),
        F.when(hit, F.col("manualOverride") | (F.col("_new") != F.col("sr"))).otherwise(F.col("manualOverride"))
        .alias("manualOverride"))


def review_problems(dictionary: DataFrame, decisions: DataFrame) -> DataFrame:
    """(en, problem) of a simple review: unknown key, repeated key, blank text."""
    unknown = decisions.join(dictionary.select("en"), "en", "left_anti").select("en", F.lit("unknown").alias("problem"))
    repeated = decisions.groupBy("en").count().where("count > 1").select("en", F.lit("repeated").alias("problem"))
    blank = decisions.where(is_blank(F.col("approvedSr"))).select("en", F.lit("blank").alias("problem"))
    return unknown.unionAll(repeated).unionAll(blank)


def decision_problems(decisions: DataFrame, baseline: DataFrame, proposals: DataFrame) -> DataFrame:
    """(en, problems) of a full review against the pinned baseline and the proposals."""
    staged = with_serbian_latin(decisions, "approvedSr", "_normal")
    joined = (staged.join(baseline.select("en", F.col("sr").alias("_old")), "en", "left")
              .join(proposals.select("en", F.col("sr").alias("_new")), "en", "left"))
    c = F.col
    pinned, proposed = c("_old").isNotNull(), c("_new").isNotNull()
    kept = (c("disposition") == "retained_baseline") & (c("approvedSr") == c("_old"))
    fresh = ((c("disposition") != "retained_baseline")
             & ((c("disposition") != "accepted_unchanged") | (c("approvedSr") == c("_new"))))
    rules = [
        Rule("known_key", pinned | proposed),
        Rule("disposition", c("disposition").isin(DISPOSITIONS)),
        Rule("confidence", c("confidence").isin(CONFIDENCES)),
        Rule("rationale", ~is_blank(c("rationale"))),
        Rule("approved_text", is_approved_serbian(c("approvedSr"), c("_normal"))),
        Rule("branch", F.when(pinned, kept).when(proposed, fresh).otherwise(F.lit(True))),
    ]
    from filmloom.operators.rules import failed_rules
    return joined.select("en", failed_rules(rules).alias("problems")).where(F.size("problems") > 0)


def undecided(decisions: DataFrame, baseline: DataFrame, flagged: DataFrame) -> DataFrame:
    """Keys that need a decision and have none."""
    needed = baseline.select("en").unionByName(flagged.select("en")).distinct()
    return needed.join(decisions.select("en"), "en", "left_anti")


def apply_decisions(candidate: DataFrame, baseline: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Baseline entries stay, decided ones are reviewed, the rest pass automatically."""
    joined = (candidate.join(baseline.select("en", F.lit(True).alias("_pinned")), "en", "left")
              .join(decisions.select("en", F.col("approvedSr").alias("_ok")), "en", "left")
              .join(proposals.select("en", F.col("sr").alias("_new")), "en", "left"))
    pinned, decided = F.col("_pinned").isNotNull(), F.col("_ok").isNotNull()
    changed = F.coalesce(F.col("_ok") != F.col("_new"), F.lit(False))
    return joined.select(
        "en", "machine", F.when(~pinned & decided, F.col("_ok")).otherwise(F.col("sr")).alias("sr"),
        F.when(pinned, F.col("reviewStatus")).when(decided, "reviewed").otherwise("auto_pass").alias("reviewStatus"),
        F.when(pinned, F.col("manualOverride")).when(decided, F.col("manualOverride") | changed)
        .otherwise(F.lit(False)).alias("manualOverride"))


def lock_problems(analyzed: DataFrame, source_tags: DataFrame) -> DataFrame:
    """(en, problem): what keeps a dictionary from being locked."""
    c = F.col
    blank = analyzed.where(is_blank(c("sr")) | (c("reviewStatus") == "review_required")).select(
        "en", F.lit("blank or unresolved").alias("problem"))
    flagged = analyzed.where((F.size("flags") > 0) & (c("reviewStatus") != "reviewed")).select(
        "en", F.lit("flagged but not reviewed").alias("problem"))
    repeated = analyzed.groupBy("en").count().where("count > 1").select("en", F.lit("repeated").alias("problem"))
    keys = key_differences(analyzed.select("en"), source_tags.select(c("tag").alias("en")), "en").select(
        "en", F.concat(F.lit("only in "), c("side")).alias("problem"))
    return blank.unionAll(flagged).unionAll(repeated).unionAll(keys)


def proper_name_risks(entries: DataFrame, movies: DataFrame) -> DataFrame:
    """Keys that equal a title, raw title, director or cast name but whose texts differ from it."""
    names = F.array_union(
        F.array("title", "rawTitle", "directedByRaw"),
        F.transform(F.coalesce(F.split("starringRaw", ","), F.array().cast("array<string>")), lambda n: F.trim(n)))
    folded = (movies.select(F.explode(names).alias("name")).where(~is_blank(F.col("name")))
              .select(F.upper("name").alias("_folded")).distinct())
    differs = (~same_ignoring_case_and_space(F.col("en"), F.col("machine"))
               | ~same_ignoring_case_and_space(F.col("en"), F.col("sr")))
    return (entries.where(differs).withColumn("_folded", F.upper("en"))
            .join(folded, "_folded", "left_semi").drop("_folded"))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) for keys that stand on one side only; empty when the key sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right"))))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def key_union(*sides: DataFrame) -> DataFrame:
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side)
    return out.distinct()


def exact_coverage(source: DataFrame, baseline: DataFrame, proposals: DataFrame, candidate: DataFrame,
                   key: str = "en") -> DataFrame:
    """(key, problem): baseline and proposals must split the source, and the candidate must equal it."""
    marks = [df.select(key).distinct().withColumn(name, F.lit(True)) for name, df in
             (("_s", source), ("_b", baseline), ("_p", proposals), ("_c", candidate))]
    joined = marks[0]
    for mark in marks[1:]:
        joined = joined.join(mark, key, "full_outer")
    s, b, p, c = (F.coalesce(F.col(n), F.lit(False)) for n in ("_s", "_b", "_p", "_c"))
    problem = (F.when(b & p, "baseline and proposals overlap").when((b | p) & ~s, "not in source")
               .when(s & ~(b | p), "not covered").when(s != c, "candidate differs from source"))
    return joined.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def changed_rows(protected: DataFrame, candidate: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, differing) for protected rows that the candidate lost or changed."""
    other = candidate.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = protected.join(other, key, "left")
    differing = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_c_{f}")), F.lit(f)) for f in fields]))
    found = F.when(F.col("_hit").isNull(), F.array(F.lit("missing"))).otherwise(differing)
    return joined.select(key, found.alias("differing")).where(F.size("differing") > 0)


def apply_corrections(dictionary: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrected, problems). A correction names the accepted and the machine text it was made for."""
    side = corrections.select("en", F.col("oldAccepted").alias("_old"), F.col("machine").alias("_machine"),
                              F.col("proposedSr").alias("_new"))
    joined = dictionary.join(side, "en", "left")
    hit = F.col("_new").isNotNull()
    stale = hit & ~((F.col("sr") == F.col("_old")) & (F.col("machine") == F.col("_machine")))
    corrected = joined.select(
        "en", "machine", F.when(hit, F.col("_new")).otherwise(F.col("sr")).alias("sr"),
        F.when(hit, "reviewed").otherwise(F.col("reviewStatus")).alias("reviewStatus"),
        F.when(hit, F.lit(True)).otherwise(F.col("manualOverride")).alias("manualOverride"),
        F.when(hit, F.col("sr")).alias("previousAccepted"))
    unknown = side.join(dictionary.select("en"), "en", "left_anti").select("en", F.lit("unknown").alias("problem"))
    problems = joined.where(stale).select("en", F.lit("stale").alias("problem")).unionAll(unknown)
    return corrected, problems


def pending_tags(tags: DataFrame, done: DataFrame) -> DataFrame:
    """Tags without a completed proposal; failed ones stay retryable."""
    finished = done.where("completed").select(F.col("en").alias("tag"))
    return tags.select("tag").distinct().join(finished, "tag", "left_anti")


def last_valid(proposals: DataFrame, sequence: str = "seq") -> DataFrame:
    """The last well-formed completed row of each key. A max, so partial results merge before the shuffle."""
    c = F.col
    good = proposals.where(c("completed") & ~is_blank(c("en")) & ~is_blank(c("machine")) & ~is_blank(c("sr"))
                           & c("error").isNull())
    return good.groupBy("en").agg(F.max_by(F.struct("machine", "sr"), sequence).alias("_v")).select(
        "en", "_v.machine", "_v.sr")
