"""Sections and documents on small in-memory tables, full text asserted."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossier import DOCUMENTS, SECTIONS, Detector, Document, Section, Style, document, documents, extract
from dossier.functions.text import title_case_key
from dossier.plans.layouts import table
from dossier.plans.section import optional, plain
from dossier.sources.raw import RAW_SCHEMA


def raw(spark, **tables):
    rows = []
    for key, entries in tables.items():
        for i, cells in enumerate(entries):
            cells = dict(cells)
            export = cells.pop("export", "e")
            rows.append((key, export, 0, i, list(cells), cells, None, None))
    return spark.createDataFrame(rows, RAW_SCHEMA).repartition(3)


def section(key):
    return next(s for s in SECTIONS if s.key == key)


def content(spark, name, lang="en", options=None, **tables):
    rows = document(raw(spark, **tables), name, [lang], **(options or {})).collect()
    assert len(rows) <= 1
    return rows[0].content if rows else None


def test_catalog_is_complete():
    assert len(SECTIONS) == 51 and len({s.key for s in SECTIONS}) == 51
    assert len(DOCUMENTS) == 45 and len({d.section for d in DOCUMENTS}) == 45
    assert [d.section for d in DOCUMENTS][:2] == ["profile", "search_queries"]
    assert DOCUMENTS[-1].section == "service_opportunities"


def test_profile(spark):
    person = {"First Name": "Ana", "Last Name": "Ruiz", "Headline": "Head of R&D", "Geo Location": "",
              "Location": "Lima", "Summary": "Línea *uno* de la vida"}
    tables = {
        "profile": [person, {"First Name": "Other"}],
        "email_addresses": [{"Email Address": "a@x", "Primary": "No"}, {"Email Address": "b@x", "Primary": "YES"}],
        "phonenumbers": [{"Number": "+1"}],
    }
    assert content(spark, "profile", **tables) == (
        "# Ana Ruiz\n\n**Head of R&D**\n\nLima | b@x | +1\n\n## Summary\n\nLínea *uno* de la vida\n"
    )
    assert content(spark, "profile", phonenumbers=[{"Number": ""}]) is None
    assert content(spark, "profile", phonenumbers=[{"Number": "5"}]) == "5\n"


def test_language_is_detected_once_per_text(spark):
    """The filter on null texts does not repeat the expressions of the profile."""
    from dossier.plans.documents import all_lines

    catalog = [d for d in DOCUMENTS if d.section == "profile"]
    lines = all_lines(raw(spark, profile=[{"Headline": "x"}]), catalog=catalog)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_fields_are_built_of_first_rows_only(spark):
    from dossier.plans.documents import all_lines

    catalog = [d for d in DOCUMENTS if d.section == "job_preferences"]
    lines = all_lines(raw(spark, job_seeker_preferences=[{"Locations": "x|y"}]), catalog=catalog)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("Aggregate")


def test_profile_meta_counts_raw_rows_and_covers_every_export(spark):
    data = raw(
        spark,
        connections=[{"First Name": ""}, {"First Name": ""}],
        profile=[{"Websites": "a.b, c;", "Twitter Handles": "[]", "Industry": ""}],
        skills=[{"Name": "x", "export": "other"}],
    )
    rows = {r.export_id: r for r in extract(section("profile_meta"), data).collect()}
    assert rows["e"].connections_count == 2 and rows["e"].websites == ["a.b", "c"]
    assert rows["e"].twitter is None and rows["other"].connections_count == 0
    assert rows["other"].websites == []
    assert document(data, "connections").count() == 0


def test_experience_merges_languages_by_position(spark):
    description_en = "• Led a team of five people\n• Raised the speed a lot"
    description_es = "• Dirigí un equipo de cinco personas"
    tables = {
        "positions": [
            {"Company Name": "Acme", "Title": "Engineer", "Description": description_en, "Location": "", "Started On": "2020-01"},
            {"Company Name": "Acme", "Title": "Ingeniera de la planta", "Description": description_es, "Location": "", "Started On": "2020-01"},
            {"Company Name": "", "Title": "", "Description": "", "Location": "Lima", "Started On": "", "Finished On": "2021"},
        ]
    }
    assert content(spark, "experience", "es", **tables) == (
        "# Experience\n\n## Acme\n**Ingeniera de la planta** | Jan 2020 - Present\n\n"
        "- Dirigí un equipo de cinco personas\n- Raised the speed a lot\n\n---\n"
        "\n## \n | 2021 | Lima\n\n\n---\n"
    )
    assert "- Led a team of five people\n" in content(spark, "experience", "en", **tables)


def test_education_and_projects(spark):
    assert content(
        spark, "education",
        education=[{"School Name": "U", "Degree Name": "BSc", "Notes": "good", "Activities": "chess",
                    "Start Date": "2010-09", "End Date": "2014-06"}, {"School Name": "V"}],
    ) == (
        "# Education\n\n## U\n**BSc** | 2010 - 2014\n\n> good\n\nActivities: chess\n\n---\n"
        "\n## V\n\n---\n"
    )
    assert content(
        spark, "projects",
        projects=[{"Title": "P", "Description": "text", "Url": "u", "Started On": "2022-01", "Finished On": ""}, {"Title": ""}],
    ) == "# Projects\n\n## P\nJan 2022\n\ntext\n\n[View Project](u)\n\n---\n"


def test_missing_values_print_none_unless_clean(spark):
    rows = [{"Reviewee": "R", "Rating": "", "Creation Date": ""}]
    assert content(spark, "learning_reviews", reviews=rows).endswith("| R | None | None |\n")
    assert content(spark, "learning_reviews", options={"style": Style(clean=True)}, reviews=rows).endswith("| R |  |  |\n")
    assert content(spark, "saved_job_alerts", savedjobalerts=[{"QUERY_CONTEXT": ""}]) == (
        "# Saved Job Alerts\n\n**Alert ID:** None\n"
    )


def test_safe_style_escapes_cells_and_links(spark):
    rows = [{"Date": "a|b", "Type": "x", "Link": "javascript:1"}, {"Date": "c", "Type": "", "Link": "https://x/(y)"}]
    assert content(spark, "reactions", options={"style": Style(safe=True)}, reactions=rows).splitlines()[4:] == [
        "| a\\|b | x |  |", "| c |  | [View](https://x/(y%29) |",
    ]
    assert "[View](javascript:1)" in content(spark, "reactions", reactions=rows)


def test_records(spark):
    assert content(spark, "job_preferences", job_seeker_preferences=[{"Locations": ""}]) == "# Job Seeker Preferences\n"
    assert content(
        spark, "job_preferences",
        job_seeker_preferences=[{"Locations": "A | B|", "Open To Recruiters": "YES", "Dream Companies": "C"}],
    ) == (
        "# Job Seeker Preferences\n\n**Locations:** A, B\n\n**Open to Recruiters:** Yes\n\n**Dream Companies:** C\n"
    )
    assert content(spark, "ad_targeting", ad_targeting=[{"Job Seniority": "Top", "Empty": ""}, {"x": "y"}]) == (
        "# Ad Targeting Criteria\n\n**Job Seniority:** Top\n"
    )
    assert content(spark, "ad_targeting", ad_targeting=[{"Empty": ""}, {"x": "y"}]) is None


def test_split_files_keep_list_order(spark):
    key = "job_applicant_saved_screening_question_responses"
    assert content(
        spark, "screening_responses",
        **{f"{key}_1": [{"Q": "second"}], key: [{"Q": "first", "Other": ""}, {"Q": ""}]},
    ) == "# Screening Question Responses\n\n## Response 1\n- **q:** first\n\n## Response 2\n- **q:** second\n"


def test_messages_and_skills(spark):
    assert content(
        spark, "messages",
        messages=[{"DATE": "d", "FROM": "a", "TO": "b", "SUBJECT": "s", "CONTENT": "x" * 501}, {"DATE": ""}],
    ) == "# Messages\n\n## d\n**From:** a → **To:** b\n**Subject:** s\n\n> " + "x" * 500 + "...\n\n---\n"
    assert content(spark, "skills", skills=[{"Name": "B"}, {"Name": "A (b)"}, {"Name": "C"}]) == "# Skills\n\nB, C\n"


def test_neutral_sections_repeat_per_language(spark):
    docs = documents(
        raw(spark, skills=[{"Name": "A"}]), ["en", "es"], catalog=[d for d in DOCUMENTS if d.section == "skills"]
    ).collect()
    assert sorted((r.lang, r.content, r.file_name) for r in docs) == [
        ("en", "# Skills\n\nA\n", "skills.md"), ("es", "# Skills\n\nA\n", "skills.md"),
    ]


def test_own_section_and_detector(spark):
    badges = Section("badges", ["badges"], {"name": plain("Name"), "level": optional("Level")})
    layout = table("badges", "Badges", {"Name": "name", "Level": "level"})
    docs = documents(
        raw(spark, badges=[{"Name": "n"}, {"Name": "m", "Level": "2"}]), sections=[*SECTIONS, badges], catalog=[layout]
    )
    assert docs.first().content == "# Badges\n\n| Name | Level |\n|------|-------|\n| n |  |\n| m | 2 |\n"

    @F.pandas_udf("string")
    def french(texts: pd.Series) -> pd.Series:
        return texts.str.contains("le ").map({True: "fr", False: "en"})

    rows = extract(section("comments"), raw(spark, comments=[{"Date": "d", "Message": "le chat"}]), Detector(french, ("fr", "en")))
    assert rows.first().message == {"fr": "le chat"}


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_order_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        text = content(spark, "companies_followed", company_follows=[{"Organization": f"o{i}"} for i in range(300)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert text.splitlines()[2:] == [f"- o{i}" for i in range(300)]


def test_unicode_titles(spark):
    df = spark.createDataFrame([("日本a_b",)], "k string")
    assert df.select(title_case_key(F.col("k"))).first()[0] == "日本A B"


def test_documents_of_stored_lines_are_the_same(spark, tmp_path):
    texts = ["Uno de la vida", "one", "", "two | three", "x" * 300]
    data = raw(
        spark,
        skills=[{"Name": t, "export": e} for e in "ab" for t in texts],
        positions=[{"Title": t, "Company Name": "C", "Description": t} for t in texts],
    )
    some = [d for d in DOCUMENTS if d.section in ("skills", "experience")]
    options = {"languages": ["en", "es"], "catalog": some, "part_bytes": 200}
    folder = str(tmp_path / "lines")
    lazy, stored = documents(data, **options), documents(data, lines_path=folder, **options)
    assert sorted(map(str, stored.collect())) == sorted(map(str, lazy.collect())) != []
    assert {f.split("/lines/")[0] + "/lines" for f in stored.inputFiles()} == {f"file://{folder}"}
