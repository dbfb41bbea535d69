"""Vectors for every string, language and date function."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from dossier.functions import dates, language, text
from dossier.functions.fixed import WHITESPACE


def run(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def check(spark, fn, vectors):
    assert run(spark, fn, [v for v, _ in vectors]) == [e for _, e in vectors]


def test_whitespace_set_is_complete():
    assert {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()} == set(WHITESPACE)


def test_strip(spark):
    values = ["\xa0 a\t", "　x\x85", "\x1cq r\x1f\n", "", "  ", "é\n\n"]
    assert run(spark, text.strip, values) == [v.strip() for v in values]


@pytest.mark.parametrize(
    "fn, vectors",
    [
        (
            dates.format_date,
            [
                ("", ""), (None, ""), ("2020-01-15", "Jan 2020"), ("Jan 2020", "Jan 2020"),
                ("2020", "2020"), ("2020-13", "2020"), ("2020-00-10", " 2020"),
                ("2020-01-15 10:00", "2020-01-15 10:00"), ("2020-ab", "2020"), ("-5", "May "),
                ("2020-", "2020"), ("2020--1", "2020"), ("2020-01 ", "Jan 2020"),
                ("a b c-1", "Jan a b c"), ("2020-+2", "Feb 2020"), ("2020-12", "Dec 2020"),
                ("2020-999999999999999999999999999999999999999999", "2020"),
                (" 2020", " 2020"), ("2020-1_2-1", "Dec 2020"), ("2020-_1", "2020"),
            ],
        ),
        (
            dates.parse_us_datetime,
            [
                ("08/19/24, 11:04 PM", "Aug 2024"), ("1/1/99", "Jan 1999"),
                ("08/19/2024, 1", "Aug 192024"), ("13/1/24, x", "13/1/24"),
                ("2023-05-15", "2023-05-15"), ("", None), (None, None), ("1/2", "1/2"),
                ("1/2/x, y", "1/2/x"), ("-1/2/20, y", "-1/2/20"), (",x", ""), ("1/2/50", "Jan 1950"),
                ("1/2/49", "Jan 2049"), ("0/2/49", " 2049"),
            ],
        ),
        (
            dates.parse_utc_date,
            [
                ("2022/01/16 02:51:39 UTC", "Jan 2022"), ("2022/13/01 x", None),
                ("2022-01-16", None), ("", None), (None, None), ("2022/1/1", "Jan 2022"),
                ("x/12/1 y", "Dec x"),
            ],
        ),
        (dates.year_of, [("2020-01", "2020"), ("", ""), (None, ""), ("-1", "")]),
        (dates.end_year_of, [("2020-01", "2020"), ("", None), (None, None), ("-1", "")]),
        (
            language.detect_language,
            [
                ("", "en"), (None, "en"), ("I am a software engineer", "en"),
                ("Soy un desarrollador de software", "es"), ("  ", "en"),
                ("a b c d e f g h i el", "en"), ("a b c d e f g h el", "es"), ("DE facto", "es"),
                ("delante", "en"), ("también", "es"), ("_el_ is", "en"),
            ],
        ),
        (
            text.split_bullets,
            [
                ("• Led team of 5 engineers\n• Raised speed a lot",
                 ["Led team of 5 engineers", "Raised speed a lot"]),
                ("Built full-stack web apps", ["Built full", "stack web apps"]),
                ("short", []), ("", []), (None, []),
                ("1. first thing done 2. second thing done", ["first thing done", "second thing done"]),
            ],
        ),
        (
            text.sanitize_url,
            [
                ("javascript:alert(1)", ""), ("data:x", ""), ("file:///x", ""), ("vbscript:x", ""),
                ("https://e.com/p(1)", "https://e.com/p(1%29"),
                (" http://e.com/[1] ", "http://e.com/%5B1%5D"), ("HTTP://e.com", ""),
                ("mailto:a@b.c", "mailto:a@b.c"), ("", ""), (None, ""),
            ],
        ),
        (text.strip_brackets, [("[me]", "me"), ("[[a]b]", "a]b"), ("[]", None), ("", None), (None, None)]),
        (text.escape_pipe, [("a|b|", "a\\|b\\|"), ("", "")]),
        (text.split_pipe_list, [("a | b||c ", ["a", "b", "c"]), ("", []), (None, [])]),
        (text.split_websites, [("x.com, y.com;z ;", ["x.com", "y.com", "z"]), ("", [])]),
        (text.paren_extract, [("A (b c ) (d)", "b c"), ("A", ""), ("A ()", ""), ("A (\n)", "")]),
        (text.before_paren, [("English (UK)", "English"), ("(x)", ""), ("a", "a")]),
        (text.blank_to_null, [("", None), (" ", " "), ("x", "x")]),
        (text.completion_status, [("2020", "Completed"), ("", "In Progress"), (None, "In Progress")]),
        (text.link_cell, [("u", "[View](u)"), ("", ""), (None, "")]),
        (text.skip_na, [("N/A", None), ("", None), ("n/a", "n/a")]),
        (text.normalise_key, [("Job Titles", "job_titles")]),
        (text.table_key, [
            ("x/Job Applications_1.csv", "job_applications_1"), ("A.B.csv", "a.b"),
            (".csv", ".csv"), ("d/e f/G.csv", "g"),
        ]),
        (text.is_safe_file_name, [
            ("my.profile", True), ("../x", False), ("/x", False), ("\\x", False), ("a..b", False),
        ]),
        (text.markdown_file_name, [("a", "a.md"), ("a.md", "a.md")]),
        (text.skip_header_notes, [
            ("Notes:\n\"a, b\"\n\nFirst,Last\n1,2", "First,Last\n1,2"),
            ("Notes:\nnothing", "Notes:\nnothing"), ("a,b\nNotes", "a,b\nNotes"),
            (" Notes, x\na,b", " Notes, x\na,b"), ("", ""),
        ]),
    ],
)
def test_vectors(spark, fn, vectors):
    check(spark, fn, vectors)


def test_title_case_key_matches_python(spark):
    keys = ["job_title", "seniority2x", "years_of_experience", "o'neil", "ÉCOLE_x", "a1b2", "", "__a"]
    assert run(spark, text.title_case_key, keys) == [k.replace("_", " ").title() for k in keys]


def test_truncate_counts_code_points(spark):
    values = ["x" * 500, "x" * 501, "🚀" * 501, "", None]
    assert run(spark, text.truncate, values) == [
        "x" * 500, "x" * 500 + "...", "🚀" * 500 + "...", "", None,
    ]


def test_names_and_flags(spark):
    df = spark.createDataFrame(
        [("José", "García"), ("", "B"), (None, None), ("\xa0A", "")], "a string, b string"
    )
    out = df.select(
        text.full_name(F.col("a"), F.col("b")).alias("n"),
        text.join_nonblank(F.col("a"), F.col("b")).alias("j"),
        text.first_nonblank(F.col("a"), F.col("b")).alias("f"),
        text.is_present(F.col("a")).alias("p"),
    ).collect()
    assert [r.n for r in out] == ["José García", "B", "", "A"]
    assert [r.j for r in out] == ["José García", "B", "", "\xa0A"]
    assert [r.f for r in out] == ["José", "B", "", "\xa0A"]
    assert [r.p for r in out] == [True, False, False, True]
    assert run(spark, lambda c: text.flag_equals(c, "yes"), ["YES", "yes ", "", None]) == [
        True, False, False, False,
    ]


def test_ranges(spark):
    df = spark.createDataFrame(
        [("a", "b"), ("a", None), ("", "b"), ("", None)], "s string, e string"
    )
    s, e = F.col("s"), F.col("e")
    out = df.select(
        dates.open_range(s, e).alias("o"),
        dates.started_range(s, e).alias("t"),
        dates.closed_range(s, e).alias("c"),
    ).collect()
    assert [r.o for r in out] == ["a - b", "a - Present", "b", "Present"]
    assert [r.t for r in out] == ["a - b", "a", None, None]
    assert [r.c for r in out] == ["a - b", "a", "b", None]


def test_multilingual_text(spark):
    df = spark.createDataFrame([("Hello", "Hola"), ("Hello", ""), ("", "")], "en string, es string")
    en, es = F.col("en"), F.col("es")
    t = language.merge_texts(
        language.create_text(en, F.lit("en")),
        language.create_text(es, F.lit("es")),
        language.create_text(F.lit("late"), F.lit("en")),
    )
    out = df.select(
        language.get_text(t, "es").alias("es"),
        language.get_text(t, "fr").alias("fr"),
        language.get_text(language.create_text(en, F.lit("de")), "en").alias("de"),
        F.array_sort(language.languages_of(t)).alias("codes"),
        language.get_text(F.lit(None).cast(language.TEXT_TYPE), "en").alias("null"),
    ).collect()
    assert [r.es for r in out] == ["Hola", "Hello", "late"]
    assert [r.fr for r in out] == ["Hello", "Hello", "late"]
    assert [r.de for r in out] == ["", "", ""]
    assert [r.codes for r in out] == [["en", "es"], ["en"], ["en"]]
    assert [r.null for r in out] == ["", "", ""]


def test_detector_agrees_with_a_plain_model(spark):
    """Our own word-set model of the rule, on mixed-script text."""
    samples = [
        "El equipo está en casa", "Está", "résumé of an engineer", "Más allá", "ESTÁN aquí ¿no?",
        "la　casa", "las_vegas las", "x1 2el el2 el", "straße de", "日本語 de 日本語", "ño",
    ]
    from dossier.functions.fixed import SPANISH_CHARACTERS, SPANISH_WORDS

    def model(value):
        plain = [w for w in SPANISH_WORDS if not set(w) & set(SPANISH_CHARACTERS)]
        low = value.lower()
        marks = sum(t in plain for t in re.findall(r"\w+", low))
        marks += sum(ch in SPANISH_CHARACTERS for ch in low)
        return "es" if marks / len(value.split()) > 0.1 else "en"

    assert run(spark, language.detect_language, samples) == [model(s) for s in samples]


@pytest.mark.parametrize("codes", [["en", "es"], ["de", "en", "es"]])
def test_texts_of_one_language(spark, codes):
    df = spark.createDataFrame([(["a", "b"], "es"), ([], "en")], "t array<string>, l string")
    out = df.select(language.create_texts(F.col("t"), F.col("l"), codes).alias("o")).collect()
    assert [[x.text for x in r.o] for r in out] == [[{"es": "a"}, {"es": "b"}], []]
