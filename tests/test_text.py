from __future__ import annotations

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filmloom.functions import normalize, text as TX
from filmloom.functions.cast import event_inventory, with_cast
from filmloom.functions.guard import with_language_mismatch
from filmloom.functions.normalize import with_serbian_latin
from filmloom.functions.translation import with_entry_flags
from filmloom.operators import dictionary as D, embedding as EM


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CYRILLIC = "абвгдђежзијклљмнњопрстћуфхцчџш"
LATIN = "a b v g d đ e ž z i j k l lj m n nj o p r s t ć u f h c č dž š".split(" ")
NORMAL = {
    **dict(zip(CYRILLIC, LATIN)), **dict(zip(CYRILLIC.upper(), [x.upper() for x in LATIN])),
    "Ђурђевдан у Нишу": "Đurđevdan u Nišu", "ЋУПРИЈА": "ĆUPRIJA", "коЊи и кЉун": "koNJi i kLJun".replace("NJ", "Nj").replace("LJ", "Lj"),
    "\n Шума \t  и\r\nрека ": "Šuma i reka", "\t\n": "", "": "", "Џ7": "DŽ7", "naïve šal": "naïve šal", "т́": "t́", "p\x1fq": "p\x1fq",
    "Čačak, 12. maj; Žabalj?": "Čačak, 12. maj; Žabalj?",
}


def test_normalizer_cases_and_idempotence(spark):
    df = spark.createDataFrame([(t,) for t in NORMAL], "t string")
    once = with_serbian_latin(df, "t", "n")
    rows = with_serbian_latin(once, "n", "again").collect()
    assert {r.t: r.n for r in rows} == NORMAL
    assert all(r.n == r.again for r in rows)


def test_texts_go_to_python_in_bounded_batches(spark):
    texts = pa.array([None if i % 7 == 0 else f"e\u0301 {i}" for i in range(200)])
    assert normalize._each(texts, str.upper).to_pylist() == [None if t is None else t.upper() for t in texts.to_pylist()]
    assert normalize._each(texts.slice(0, 0), str.upper).to_pylist() == []
    mine = spark.newSession()
    normalize.with_nfc(mine.range(1).select(F.lit("x").alias("t")), "t", "n")
    assert mine.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    mine.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "3m")
    with_serbian_latin(mine.range(1).select(F.lit("x").alias("t")), "t", "n")
    assert mine.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "3m"  # the session's own bound stays


def test_counter_gets_few_texts_at_once(spark):
    rows = spark.range(0, 300, 1, 1).select(F.when(F.col("id") != 5, F.col("id").cast("string")).alias("t"))
    sizes = rows.select(EM.Model("p", 2, counter=lambda batch: [len(batch)] * len(batch)).tokens(F.col("t")).alias("n")).collect()
    found = [r.n for r in sizes]
    assert found[5] is None and None not in found[:5] + found[6:] and max(n for n in found if n) <= EM.MAX_BATCH


def overrides(spark):
    return spark.createDataFrame(
        [(71, "Mira Lukić", "Otto Brandt", None, None), (72, None, None, "Ren Kat&#333;", "Ren Katō")],
        "movieLensId long, gap_before string, gap_after string, entity_raw string, entity_accepted string")


def parse(spark, rows):
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "n int, movieLensId long, starringRaw string")
    return [r for r in with_cast(df, overrides=overrides(spark)).orderBy("n").collect()]


def test_cast_accepts_reviewed_grammar(spark):
    rows = parse(spark, [
        (5, None), (5, "\tZoë Martín, D'Arc-Weller, Núria, Núria, Liv McOrr, Liv Mcorr "), (6, "Tove Falk, Ada Quist,"),
        (5, "Egon Vance, Jr., Lena Roth"), (72, "Ren Kat&#333;"), (71, "Pia Holm, Mira Lukić,,Otto Brandt, Sven Dahl")])
    assert [r["cast"] for r in rows] == [
        None, ["Zoë Martín", "D'Arc-Weller", "Núria", "Liv McOrr", "Liv Mcorr"], ["Tove Falk", "Ada Quist"],
        ["Egon Vance, Jr.", "Lena Roth"], ["Ren Katō"], ["Pia Holm", "Mira Lukić", "Otto Brandt", "Sven Dahl"]]
    assert [[e.kind for e in r.cast_events or []] for r in rows] == [
        [], ["exact-duplicate-suppression"], ["trailing-empty-separator"], ["suffix-attachment"], ["reviewed-entity-override"],
        ["reviewed-empty-separator-override"]]
    assert rows[5].cast_events[0].raw == " Mira Lukić,,Otto Brandt"


def test_cast_refuses_everything_else(spark):
    bad = [(9, t) for t in ["", "\t", ",Uma Berg", "Uma Berg,,", "Uma Berg, , ,", "Uma Berg,,Kai Lund", "Jr., Uma Berg", "Uma Berg, Jr., Jr.",
                            "Uma Berg; Kai Lund", "Uma Berg, Sr.", "Uma Berg\rKai Lund", "Ren Kat&#333;", "Mira Lukić,,Otto Brandt"]]
    bad += [(71, t) for t in [",Mira Lukić,Otto Brandt", "Mira Lukić,,,Otto Brandt", "Kai Lund,,Otto Brandt", "Mira Lukić,,Kai Lund",
                              "Mira Lukić,,Otto Brandt,Mira Lukić,,Otto Brandt"]]
    bad += [(72, "Kai &lt; Lund")]
    assert all(r["cast"] is None and r.cast_error for r in parse(spark, bad))


def test_inventory_parses_each_list_once(spark):
    df = spark.createDataFrame([(1, "Ada Quist, Ada Quist,"), (2, "Ada Quist"), (3, None), (4, ",Kai Lund,"), (5, "Kai Lund, Jr., Ada Quist,")],
                               "movieLensId long, starringRaw string")
    found = event_inventory(with_cast(df))
    assert {r.kind: r.events for r in found.collect()} == {
        "exact-duplicate-suppression": 1, "trailing-empty-separator": 2, "suffix-attachment": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\baggregate\(", plan)) == 1 and len(re.findall(r"\bsplit\(", plan)) == 1


PEOPLE = {"en": ["Uma Berg", "Kai Lund", "Zoë d'Arc"], "sr": ["Umom Berg", "Kajom Lundom", "Zoom d'Arc"]}


def foreign(language):
    """Sentences made from the grammar of one language: a request verb with a film, or a film with a relation."""
    out = []
    for i, name in enumerate(PEOPLE[language]):
        if language == "en":
            out += [f"{v} movies set near the sea" for v in ("Show me", "Please find", "Recommend")]
            out += [f"Movies {r} {name}" for r in ("with", "starring", "directed by")] + [f"I am looking for films, number {i}"]
        else:
            out += [f"{v} filmove na moru" for v in ("Prikaži", "Molim te pronađi", "Tražim")]
            out += [f"Filmovi {r} {name}" for r in ("sa", "bez")] + [f"Филмови о мору, број {i}"]
    return out


NEUTRAL = ["Uma Berg", "Zimska noć", "A Lighthouse Keeper", "Кај Лунд", "film", "movies", "Movies with", "Filmovi bez",
           "Movies with Uma Berg bez pucanja", "Prikaži film directed by Kai Lund", "Filmovi after dark"]


def test_language_guard_tables(spark):
    other = {"en": "sr", "sr": "en"}
    cases = [(m, other[spoken], True) for spoken in other for m in foreign(spoken)]
    cases += [(m, spoken, False) for spoken in other for m in foreign(spoken)] + [(m, s, False) for m in NEUTRAL for s in other]
    for opening, closing in ('""', "“”", "«»", "''"):  # what is quoted does not count, whatever its language
        quoted = {spoken: f"{opening}{foreign(spoken)[0]}{closing}" for spoken in other}
        cases += [(q, s, False) for q in quoted.values() for s in other]
        cases += [(f"Tražim film kao {quoted['en']}", "sr", False), (f"Show me movies like {quoted['sr']}", "en", False)]
    rows = with_language_mismatch(spark.createDataFrame(cases, "m string, s string, expected boolean"), "m", "s").collect()
    assert [r for r in rows if r.mismatch != r.expected] == []


@pytest.mark.parametrize("en,machine,sr,code,expected", [
    ("harbor", "", "\t", "empty_or_incomplete", True), ("harbor", "Harbor", "harbor", "unchanged_english", True),
    ("harbor", "luka", "l" * 90, "excessive_length", True), ("harbor", "luka", "l" * 12, "excessive_length", False),
    ("harbor", "luka", "лука λ", "script_residue", True), ("harbor", "lu\u0002ka", "luka", "malformed_output", True),
    ("harbor", "luka [1)", "luka", "malformed_output", True), ("harbor", "luka ([1])", "luka", "malformed_output", False),
    ("harbor", "?" * 20000, "luka", "malformed_output", True), ("pier 3", "mol 31", "mol 31", "lost_number_or_negation", True),
    ("pier 3", "mol 3", "mol 3", "lost_number_or_negation", False), ("not far", "daleko", "daleko", "lost_number_or_negation", True)])
def test_translation_flags(spark, en, machine, sr, code, expected):
    row = with_entry_flags(spark.createDataFrame([(en, machine, sr)], "en string, machine string, sr string")).first()
    assert (code in [f.code for f in row.flags]) == expected


def test_collisions_mark_every_member(spark):
    rows = [("harbor", "лука", "пристан", "auto_pass", False), ("wharf", "кеј", "ПРИСТАН", "auto_pass", False), ("pier", "мол", "mol", "auto_pass", False)]
    df = spark.createDataFrame(rows, "en string, machine string, sr string, reviewStatus string, manualOverride boolean")
    codes = {r.en: [f.code for f in r.flags] for r in D.analyze(df).collect()}
    assert codes["harbor"] == codes["wharf"] == ["sr_collision"] and codes["pier"] == []


def test_scalar_edges(spark):
    lit = F.lit
    assert one(spark, TX.title_parts(lit("\tNorth Pier (1987) "))).title == "North Pier"
    assert one(spark, TX.title_parts(lit("(1987)"))).title is None
    assert one(spark, TX.canonical_digits(lit("000"))) == "0"
    assert one(spark, TX.poster_url(lit("/a.jpg"))) == "https://image.tmdb.org/t/p/w500/a.jpg"
    assert one(spark, TX.poster_url(lit("//a.jpg"))) is None
    usable = {"q" * 8: False, "q" * 7: True, "no" * 8: False, "no" * 7: True, "\tsea ": True, "?": False, "": False, "x y" * 180: False}
    for message, expected in usable.items():
        assert one(spark, TX.is_usable_message(lit(message))) is expected, message
    numbers = [("2.40", "24e-1", True), ("-0", "0.00", True), ("7E3", "7000", True), ("2.4", "2.41", False), (None, None, True), (None, "3", False),
               ("abc", "0", False), ("abc", "abc", False), ("", "0", False), ("1e", "1", False), (".5", "0.5", True)]
    for a, b, same in numbers:
        assert one(spark, TX.same_number(lit(a).cast("string"), lit(b).cast("string"))) is same, (a, b)


def test_serbian_letters_one_by_one():
    """Against a reading letter by letter, with capital digraphs in words of capitals and in others."""
    rng = random.Random(7)
    pairs = {"љ": "lj", "њ": "nj", "џ": "dž"}
    single = dict(zip(normalize.CYRILLIC, normalize.LATIN))

    def word(w):
        capitals = all(unicodedata.category(c) == "Lu" for c in w)
        both = lambda c: pairs[c.lower()].upper() if capitals else pairs[c.lower()].capitalize()
        return "".join(pairs.get(c) or (both(c) if c.lower() in pairs else single.get(c) or (single[c.lower()].upper() if c.lower() in single else c)) for c in w)

    for _ in range(3000):
        words = ["".join(rng.choices("абљЉњЊџЏЂШžÉ漢", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 4))]
        signs = [rng.choice([" ", "-", "1", "²", "_"]) for _ in words]
        text = "".join(w + s for w, s in zip(words, signs))
        want = "".join(word(w) + s for w, s in zip(words, signs)).strip(" ")
        assert normalize._to_normal_form(text) == " ".join(want.split(" ")), text
