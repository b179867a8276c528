from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, text

L = F.lit


@pytest.mark.parametrize(
    "parts, expected",
    [
        (("2023", "Mar", None), date(2023, 3, 1)),
        (("2023", None, None), date(2023, 1, 1)),
        (("2022", "7", "9"), date(2022, 7, 9)),
        (("2024", "02", "31"), None),
        (("2021", "Spring", "9"), date(2021, 1, 1)),
        (("2021", "Mar", "x"), date(2021, 1, 1)),
        ((None, "Mar", "1"), None),
        (("", "Mar", "1"), None),
    ],
)
def test_publication_date(value, parts, expected):
    columns = [L(p).cast("string") for p in parts]
    assert value(dates.publication_date(*columns)) == expected


def test_kst_day_starts_at_15_utc(value):
    assert value(dates.kst_date("2024-01-30 14:59:59")) == date(2024, 1, 30)
    assert value(dates.kst_date("2024-01-30 15:00:00")) == date(2024, 1, 31)


def test_ages(value):
    day = L("2024-01-01").cast("date")
    assert value(dates.age_in_days("2024-01-03 12:00:00", day)) == 2
    assert value(dates.fractional_age_in_days("2024-01-03 12:00:00", day)) == 2.5


@pytest.mark.parametrize(
    "haystack, needle, n",
    [("a psa b psa c psa", "psa", 3), ("ththth", "thth", 1), ("psa", "x", 0), ("élé élé", "élé", 2)],
)
def test_occurrences(value, haystack, needle, n):
    assert value(text.occurrences(L(haystack), L(needle))) == n
    assert value(text.occurs_at_least(L(haystack), L(needle), 1)) == (n >= 1)
    assert value(text.occurs_at_least(L(haystack), L(needle), 2)) == (n >= 2)


@pytest.mark.parametrize(
    "word, haystack, hit",
    [
        ("rct", "an rct of", True),
        ("rct", "infarct", False),
        ("c++", "use c++ now", False),  # no boundary between two non-word characters
        ("c++", "use c++x", True),
        ("psa", "épsa", True),  # é is no ASCII word character
        (r"a\Eb", r"x a\Eb y", True),
        ("a.c", "abc", False),
    ],
)
def test_whole_word(value, word, haystack, hit):
    assert value(F.rlike(L(haystack), text.whole_word_pattern(L(word)))) is hit


def test_highlight(value):
    terms = F.array(L("psa"), L("a.b"))
    assert value(text.highlighted(L("PSA and a.b or axb"), terms)) == (
        "<mark>PSA</mark> and <mark>a.b</mark> or axb"
    )
    none = F.array().cast("array<string>")
    assert value(text.highlighted(L("PSA"), none)) == "PSA"


@pytest.mark.parametrize("words, minutes", [(0, 1), (200, 1), (201, 2), (400, 2), (401, 3)])
def test_reading_minutes(value, words, minutes):
    assert value(text.reading_minutes(L(" ".join(["w"] * words)))) == minutes


def test_author_list_and_citation(value):
    authors = F.array(*[L(a) for a in ("A B", "C D", "E F", "G H")])
    assert value(text.author_list(authors, 3)) == "A B, C D, E F et al."
    assert value(text.author_list(F.slice(authors, 1, 2), 3)) == "A B, C D"
    day = L("2024-01-02").cast("date")
    assert value(text.citation(authors, L("T."), L("J"), day, L("7"))) == (
        "A B, C D, E F et al.. T. J. 2024-01-02. PMID: 7"
    )


def test_labels(value):
    assert value(text.titled_code(L("meta_analysis"))) == "Meta Analysis"
    assert value(text.label_of(L("zzz"), {"a": "A"})) == "zzz"
    assert value(text.label_of(L("a"), {"a": "A"})) == "A"
    assert value(text.relevance_label(L(5))) == "Practice-Changing"
    assert value(text.relevance_label(L(4))) == "High Relevance"
    assert value(text.relevance_label(L(3))) is None


@pytest.mark.parametrize(
    "given, expected",
    [('["a","b"]', ["a", "b"]), ('"a"', []), ("bad", []), (None, []), ("[]", [])],
)
def test_text_or_array(value, given, expected):
    assert value(text.text_or_array(L(given).cast("string"))) == expected


def test_normalised_keeps_arrays(spark):
    from lectern.sources.tables import normalised

    df = spark.createDataFrame([(["x"], '["y"]')], "a array<string>, b string")
    assert normalised(df, "a", "b").first().asDict() == {"a": ["x"], "b": ["y"]}


@pytest.mark.parametrize(
    "given, literal, expected",
    [("zzzz", "zz", False), ("zz zz", "zz", True), ("a psa.", "psa", True), ("apsa psab", "psa", False),
     ("x\u0001psa", "psa", True), ("a-a-a", "a-a", True), ("é psa", "psa", True), ("psapsa psa", "psa", True)],
)
def test_whole_word(value, given, literal, expected):
    assert value(text.has_whole_word(L(given), L(literal))) is expected
