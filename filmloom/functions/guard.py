"""High-confidence check that a message is written in the language the user did not select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmloom.functions.normalize import with_serbian_latin

# Request verbs, relationship phrases and cue words of the two languages.
_SR_REQUEST_WORDS = "želim|zelim|hoću|hocu|tražim|trazim|prikaži|prikazi|pronađi|pronadji|daj"
_EN_REQUEST = (r"^(?:please\s+)?(?:(?:show|find)(?:\s+me)?|give\s+me|recommend(?:\s+me)?|i\s+(?:want|would\s+like|"
               r"am\s+looking\s+for))\b.*\b(?:movies?|films?)\b")
_EN_RELATION = (r"^(?:movies|films)\s+(?:starring|featuring|with|without|about|directed\s+by|released|from|after|"
                r"before)\b\s+.*[\p{L}\p{N}]")
_SR_REQUEST = (rf"^(?:molim(?:\s+(?:te|vas))?\s+)?(?:{_SR_REQUEST_WORDS})\b.*\b(?:film|filmovi|filmove|filma|priča|"
               r"priču)\b")
_SR_RELATION = r"^(?:film|filmovi|filmove)\s+(?:u\s+(?:kojima|kojem)|sa|s|bez|o|gde|koji|koje)\b\s+.*[\p{L}\p{N}]"
_EN_CUES = (r"\b(?:show|find|give|recommend|want|would|looking|movies|starring|featuring|directed|without|with|about|"
            r"after|before)\b")
_SR_CUES = (rf"\b(?:{_SR_REQUEST_WORDS}|filmovi|filmove|kojima|kojem|glumi|glume|bez|sa|koji|kao|najmanje|najviše|"
            r"najvise|posle|nakon|izvorno)\b")

_WORD = r"[\p{L}\p{Nd}]"
_QUOTED = "|".join([
    '"[^"]*"', "“[^”]*”", "«[^»]*»",
    rf"(?<!{_WORD})'.*?'(?!{_WORD})", rf"(?<!{_WORD})‘.*?’(?!{_WORD})",
])


def mask_quotes(message: Column) -> Column:
    """Balanced quotations are blanked; an apostrophe inside a word opens nothing."""
    return F.regexp_replace(message, f"(?s){_QUOTED}", " ")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?sU){pattern}")


def is_language_mismatch(text: Column, selected: Column) -> Column:
    """True only for strong opposite grammar without any cue of the selected language.

    `text` is the masked, normalized, lower-case message.
    """
    english = ~_has(text, _SR_CUES) & (_has(text, _EN_REQUEST) | _has(text, _EN_RELATION))
    serbian = ~_has(text, _EN_CUES) & (_has(text, _SR_REQUEST) | _has(text, _SR_RELATION))
    return F.coalesce(F.when(selected == "sr", english).when(selected == "en", serbian), F.lit(False))


def with_language_mismatch(df: DataFrame, message: str, selected: str, out: str = "mismatch") -> DataFrame:
    inspected = with_serbian_latin(df, mask_quotes(F.col(message)), "_inspected")
    lowered = inspected.withColumn("_inspected", F.lower("_inspected"))
    return lowered.withColumn(out, is_language_mismatch(F.col("_inspected"), F.col(selected))).drop("_inspected")
