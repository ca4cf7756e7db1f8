"""Checks on one translation entry: English key, machine text, accepted Serbian text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from filmloom import vocab
from filmloom.functions.normalize import with_serbian_latin
from filmloom.functions.text import is_blank

# The message that goes with each code.
MESSAGES = {
    "empty_or_incomplete": "translation is empty or decoder marked it incomplete",
    "unchanged_english": "translation is unchanged English outside the frozen whitelist",
    "excessive_length": "normalized Serbian output is unusually long",
    "script_residue": "non-Latin script remains after Serbian normalization",
    "malformed_output": ("raw machine output contains controls, special tokens, malformed punctuation, "
                         "or suspicious encoding residue"),
    "lost_number_or_negation": "output may have lost a numeric token or explicit English negation",
    "ambiguity_seed": "English key contains a frozen ambiguity seed",
    "sr_collision": "another English key has the same normalized Serbian text",
}

_FOREIGN_LETTER = r"[\p{L}&&[^\x{0}-\x{24f}\x{1e00}-\x{1eff}\x{ab30}-\x{ab6f}]]"
_NEGATION_EN = r"(?iu)(?<!\p{L})(?:no|not|without|non-)(?=\p{L}|(?U:\b))"
_NEGATION_SR = r"(?iu)(?<!\p{L})(?:ne|bez|ni|anti-)(?=\p{L}|(?U:\b))"
# Single characters and classes only: repeated groups would recurse on long texts.
_REPEATED = r"(?U)[!?.,;:]\s*[!?.,;:]"
_NOT_APPROVED = (r"[\p{L}&&[^A-Za-z\x{c0}-\x{24f}\x{1e00}-\x{1eff}\x{ab30}-\x{ab6f}]]|[^\p{L}\p{Nd}\p{Zs}\p{P}]")
_SPECIAL = r"(?i)<unk>|</s>|<pad>|<s>|<<[^<>]+>>"
_RESIDUE = "[æÆèÈ]"
_ODD_CHARACTERS = r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}]"
_OPENING = {")": "(", "]": "[", "}": "{"}


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def unbalanced_brackets(text: Column) -> Column:
    """Fold over the brackets with the open ones kept as a string."""
    brackets = F.split(F.regexp_replace(text, r"[^()\[\]{}]", ""), "")

    def step(open_ones: Column, b: Column) -> Column:
        expected = F.when(b == ")", "(").when(b == "]", "[").when(b == "}", "{")
        return (F.when((open_ones == "!") | (b == ""), open_ones)
                .when(b.isin("(", "[", "{"), F.concat(open_ones, b))
                .when(F.right(open_ones, F.lit(1)) == expected,
                      F.substr(open_ones, F.lit(1), F.length(open_ones) - 1))
                .otherwise(F.lit("!")))
    return F.aggregate(brackets, F.lit(""), step) != ""


def _malformed(raw: Column) -> Column:
    paired = [("“", "”"), ("«", "»"), ("‘", "’")]
    checks = (raw.rlike(_ODD_CHARACTERS) | raw.rlike(_SPECIAL) | raw.rlike(_RESIDUE) | raw.rlike(_REPEATED)
              | (_count(raw, '"') % 2 != 0))
    for left, right in paired:
        checks = checks | (_count(raw, left) != _count(raw, right))
    return checks | (raw.rlike(r"[()\[\]{}]") & unbalanced_brackets(raw))


def _lost_numbers(en: Column, sr: Column) -> Column:
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"(\p{Nd}+)"), F.lit(1))
    return en.rlike(r"\p{Nd}") & (F.size(F.array_except(numbers(en), numbers(sr))) > 0)


def entry_flags(en: Column, machine: Column, text: Column, en_normal: Column) -> Column:
    """array<struct<code,message>> of the row-local checks. Collisions need the whole dictionary.

    `text` and `en_normal` are the normalized accepted text and the normalized key.
    """
    raw = F.coalesce(machine, F.lit(""))
    lowered = F.lower(en)
    seeds = "|".join(re.escape(s) for s in vocab.AMBIGUOUS_SEEDS)
    checks = {
        "empty_or_incomplete": is_blank(raw) | is_blank(text),
        "unchanged_english": ~lowered.isin(vocab.UNCHANGED_ALLOWED)
        & (F.upper(en_normal) == F.upper(text)),
        "excessive_length": (F.char_length(text) > 80)
        | (F.char_length(text) > F.greatest(F.lit(20), 4 * F.char_length(en))),
        "script_residue": text.rlike(_FOREIGN_LETTER),
        "malformed_output": _malformed(raw),
        "lost_number_or_negation": _lost_numbers(en, text)
        | (en.rlike(_NEGATION_EN) & ~text.rlike(_NEGATION_SR)),
        "ambiguity_seed": lowered.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{seeds})(?![\p{{L}}\p{{N}}])"),
    }
    return F.array_compact(F.array(*[F.when(cond, flag(code)) for code, cond in checks.items()]))


def flag(code: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"))


def with_entry_flags(df: DataFrame, en: str = "en", machine: str = "machine", sr: str = "sr") -> DataFrame:
    """Adds `sr_normal` and `flags`."""
    staged = with_serbian_latin(df, F.coalesce(F.col(sr), F.lit("")), "sr_normal")
    staged = with_serbian_latin(staged, en, "_en_normal")
    flags = entry_flags(F.col(en), F.col(machine), F.col("sr_normal"), F.col("_en_normal"))
    return staged.withColumn("flags", flags).drop("_en_normal")


def is_approved_serbian(text: Column, normal: Column) -> Column:
    """Equal to its normal form; Latin letters, digits, spaces and punctuation only."""
    return F.coalesce(~is_blank(text) & (text == normal) & ~text.rlike(_NOT_APPROVED), F.lit(False))


def same_ignoring_case_and_space(left: Column, right: Column) -> Column:
    squeeze = lambda t: F.upper(F.regexp_replace(t, r"(?U)\s+", ""))
    return squeeze(left) == squeeze(right)
