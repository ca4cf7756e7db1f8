"""Titles, document texts, urls, message checks and encoder inputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmloom import vocab
from filmloom.functions.normalize import SPACE, trim_space

_YEAR_SUFFIX = r" \((\d{4})\)$"


def title_parts(raw_title: Column) -> Column:
    """struct(title, year) of `Name (YYYY)`; both null when the suffix or the name is missing."""
    trimmed = trim_space(raw_title)
    title = trim_space(F.regexp_replace(trimmed, _YEAR_SUFFIX, ""))
    valid = trimmed.rlike(_YEAR_SUFFIX) & (title != "")
    return F.struct(F.when(valid, title).alias("title"),
                    F.when(valid, F.regexp_extract(trimmed, _YEAR_SUFFIX, 1).cast("int")).alias("year"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim_space(text), F.lit(""))


def canonical_digits(digits: Column) -> Column:
    """Leading zeros dropped, all zeros become one zero."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def tag_names(tags: Column) -> Column:
    return F.transform(tags, lambda t: t["name"])


def _join_or(values: Column, missing: str) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, ", ")).otherwise(F.lit(missing))


def _name_or(name: Column, missing: str, empty_is_missing: bool) -> Column:
    value = F.nullif(name, F.lit("")) if empty_is_missing else name
    return F.coalesce(value, F.lit(missing))


def document_text(language: str, title: Column, year: Column, director: Column, tags: Column,
                  cast: Column | None = None, empty_is_missing: bool | None = None) -> Column:
    """The sentence list that gets embedded. Without `cast` it is the newer form without that sentence.

    English v1 keeps an empty name as it is; Serbian and the newer form treat it as missing.
    """
    words = {"en": ("Title", "Year", "Director", "Cast", "Tags", "unknown", "none"),
             "sr": ("Naslov", "Godina", "Režija", "Glumci", "Tagovi", "nepoznato", "nema")}[language]
    if empty_is_missing is None:
        empty_is_missing = language == "sr" or cast is None
    lit = F.lit
    parts = [lit(f"{words[0]}: "), title, lit(f". {words[1]}: "), year.cast("string"),
             lit(f". {words[2]}: "), _name_or(director, words[5], empty_is_missing)]
    if cast is not None:
        parts += [lit(f". {words[3]}: "), _name_or(cast, words[5], empty_is_missing)]
    parts += [lit(f". {words[4]}: "), _join_or(tags, words[6]), lit(".")]
    return F.concat(*parts)


def poster_url(path: Column) -> Column:
    safe = path.rlike(r"^/(?!/)") & ~path.rlike(r"[\\?#]|\.\.") & (trim_space(path) != "")
    return F.when(safe, F.concat(F.lit(vocab.POSTER_BASE), path))


def title_url(imdb_id: Column) -> Column:
    return F.when(imdb_id.rlike("^[0-9]{1,12}$"), F.concat(F.lit(vocab.TITLE_URL_BASE), imdb_id, F.lit("/")))


def document_input(text: Column) -> Column:
    return F.when(~is_blank(text), F.concat(F.lit("passage: "), text))


def query_input(text: Column) -> Column:
    return F.when(~is_blank(text), F.concat(F.lit("query: "), trim_space(text)))


def titled_input(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), title, F.lit(" | text: "), text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("bigint")


_MESSAGE_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_message(message: Column) -> Column:
    """Trimmed message of 1 to 500 code points, else null."""
    trimmed = F.regexp_replace(message, f"^{_MESSAGE_SPACE}+|{_MESSAGE_SPACE}+$", "")
    return F.when(F.char_length(trimmed).between(1, 500), trimmed)


def is_usable_message(message: Column) -> Column:
    """At least two letters or digits, and not one character or a two-character pattern repeated."""
    core = F.regexp_replace(trim_message(message), r"[^\p{L}\p{Nd}]", "")
    return F.coalesce(
        (F.char_length(core) >= 2)
        & ~core.rlike(r"^(.)\1{7,}$")
        & ~core.rlike(r"^(.)(?!\1)(.)(?:\1\2){7,}\1?$"), F.lit(False))


def is_semantic_text(text: Column) -> Column:
    """Trimmed, not empty, no controls, holds a letter or digit, and is no internal code word."""
    return F.coalesce((text == trim_space(text)) & (text != "") & ~text.rlike(r"\p{Cc}")
                      & text.rlike(r"[\p{L}\p{Nd}]") & ~text.isin(vocab.CONTROL_CODES), F.lit(False))


def year_band(year: Column) -> Column:
    return (F.when(year < 1960, "0-pre1960").when(year <= 1979, "1-1960-1979")
            .when(year <= 1999, "2-1980-1999").when(year <= 2009, "3-2000-2009").otherwise("4-2010plus"))


def stratum_key(year: Column, genres: Column) -> Column:
    """Year band and the first genre in byte order."""
    first = F.coalesce(F.get(F.array_sort(genres), F.lit(0)), F.lit(""))
    return F.concat(year_band(year), F.lit("|"), first)


def rating_threshold(value: Column, scale: Column) -> Column:
    """Threshold on the five-point scale; null when the value cannot be one."""
    v = value.cast("decimal(28,18)")
    half = (v / F.lit(2)).cast("decimal(28,18)")
    return F.when(v.between(1, 10),
                  F.when((scale == "five") & (v <= 5), v)
                  .when(scale == "ten", half)
                  .when(scale == "unspecified", F.when(v <= 5, v).otherwise(half)))


def same_number(left: Column, right: Column) -> Column:
    """Equality of two decimal texts, whatever their scale or exponent. Two nulls are equal; a text that is no number
    equals nothing, not even itself."""
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    fine = lambda c: c.isNull() | c.rlike(number)
    return fine(left) & fine(right) & _number_key(left).eqNullSafe(_number_key(right))


def _number_key(text: Column) -> Column:
    """sign, digits without outer zeros and power of ten: exact for any length."""
    body = F.regexp_extract(text, r"^[+-]?([0-9]*)", 1)
    fraction = F.regexp_extract(text, r"\.([0-9]*)", 1)
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")).cast("bigint"), F.lit(0))
    digits = F.concat(body, fraction)
    tail = F.length(F.regexp_extract(digits, "(0*)$", 1))
    core = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "^0+", "")
    power = exponent - F.length(fraction) + tail
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(text.isNotNull(), F.when(core == "", F.lit("0")).otherwise(
        F.concat(sign, core, F.lit("e"), power.cast("string"))))


def local_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{SPACE[1:-1]}]")
