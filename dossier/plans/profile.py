"""Profile sections. They share three small tables, so each plan reads those once and makes one
combined aggregate per export instead of joining per-section results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.functions.language import Detector, create_text
from dossier.operators.select_first import first_row, preferred_else_first
from dossier.plans.layouts import localised, value, when_present
from dossier.plans.section import Section, Style, cell
from dossier.sources.raw import RawRows, export_ids, get_table

PROFILE = "profile"
EMAILS = "email_addresses"
PHONES = "phonenumbers"
REGISTRATION = "registration"
CONNECTIONS = "connections"


def _name() -> Column:
    return tx.full_name(cell("First Name"), cell("Last Name"))


def _location() -> Column:
    return tx.first_nonblank(cell("Geo Location"), cell("Location"))


def _is_primary() -> Column:
    return tx.flag_equals(cell("Primary"), "yes")


def _first_profile_value(key: str, column) -> Section:
    """A one-row-per-export section from the first profile row."""

    def build(raw: RawRows, detector: Detector) -> DataFrame:
        rows = get_table(raw, [PROFILE])
        picked = first_row(
            rows.select("export_id", "ord", column().alias(key)), ["export_id"], "ord"
        )
        return picked

    return Section(key, [PROFILE], {}, build=build)


def _first_profile_text(key: str, column: str) -> Section:
    def build(raw: RawRows, detector: Detector) -> DataFrame:
        rows = get_table(raw, [PROFILE]).select("export_id", "ord", cell(column).alias("_text"))
        picked = first_row(rows, ["export_id"], "ord")
        text = F.col("_text")
        return picked.select(
            "export_id", "ord", create_text(text, detector.detect(text)).alias(key)
        )

    return Section(key, [PROFILE], {}, build=build)


def _email(raw: RawRows, _: Detector) -> DataFrame:
    rows = get_table(raw, [EMAILS])
    return preferred_else_first(
        rows, ["export_id"], "ord", _is_primary(), cell("Email Address"), "email"
    ).withColumn("ord", F.lit(0).cast("long"))


def _phone(raw: RawRows, _: Detector) -> DataFrame:
    rows = get_table(raw, [PHONES]).select("export_id", "ord", cell("Number").alias("phone"))
    return first_row(rows, ["export_id"], "ord")


def profile_meta(raw: RawRows, _: Detector) -> DataFrame:
    """Industry, handles, sites, dates and the raw connection count; one row for every export."""
    profile = get_table(raw, [PROFILE]).select(
        "export_id",
        "ord",
        F.struct(
            tx.blank_to_null(cell("Industry")).alias("industry"),
            tx.strip_brackets(cell("Twitter Handles")).alias("twitter"),
            tx.split_websites(cell("Websites")).alias("websites"),
            tx.blank_to_null(cell("Birth Date")).alias("birth_date"),
        ).alias("_profile"),
    )
    registration = get_table(raw, [REGISTRATION]).select(
        "export_id",
        F.col("ord").alias("_registered_ord"),
        tx.blank_to_null(cell("Registered At")).alias("_registered_at"),
    )
    # One row per export of each: only these meet the texts, which have to be sorted to be compared.
    connections = get_table(raw, [CONNECTIONS]).groupBy("export_id").agg(
        F.count(F.lit(1)).alias("_connections")
    )
    rows = (
        export_ids(raw)
        .distinct()
        .unionByName(profile, allowMissingColumns=True)
        .unionByName(registration, allowMissingColumns=True)
        .unionByName(connections, allowMissingColumns=True)
    )
    return (
        rows.groupBy("export_id")
        .agg(
            F.min_by("_profile", "ord").alias("_profile"),
            F.min_by("_registered_at", "_registered_ord").alias("registered_at"),
            F.coalesce(F.sum("_connections"), F.lit(0)).alias("connections_count"),
        )
        .select(
            "export_id",
            F.lit(0).cast("long").alias("ord"),
            F.col("_profile.industry").alias("industry"),
            F.col("_profile.twitter").alias("twitter"),
            F.coalesce("_profile.websites", F.array().cast("array<string>")).alias("websites"),
            F.col("_profile.birth_date").alias("birth_date"),
            "registered_at",
            "connections_count",
        )
    )


def profile_parts(raw: RawRows, detector: Detector) -> DataFrame:
    """Everything the profile document shows, one row per export that has any of its tables."""
    # Each table brings only what is shown, so that whole cells are not sorted; names are put
    # together once the first rows are found.
    person = F.struct(
        cell("First Name").alias("first"),
        cell("Last Name").alias("last"),
        cell("Headline").alias("headline"),
        _location().alias("location"),
        cell("Summary").alias("summary"),
    )
    rank = F.struct(F.when(_is_primary(), 0).otherwise(1), F.col("ord"))
    profile = get_table(raw, [PROFILE]).select(
        "export_id", F.col("ord").alias("_person_ord"), person.alias("_person")
    )
    emails = get_table(raw, [EMAILS]).select(
        "export_id", rank.alias("_email_rank"), cell("Email Address").alias("_email")
    )
    phones = get_table(raw, [PHONES]).select(
        "export_id", F.col("ord").alias("_phone_ord"), cell("Number").alias("_phone")
    )
    rows = profile.unionByName(emails, allowMissingColumns=True).unionByName(
        phones, allowMissingColumns=True
    )
    parts = rows.groupBy("export_id").agg(
        F.min_by("_person", "_person_ord").alias("_person"),
        F.min_by("_email", "_email_rank").alias("email"),
        F.min_by("_phone", "_phone_ord").alias("phone"),
    )
    headline, summary = F.col("_person.headline"), F.col("_person.summary")
    return parts.select(
        "export_id",
        F.lit(0).cast("long").alias("ord"),
        # An export without a profile row has no name.
        F.when(
            F.col("_person").isNotNull(), tx.full_name(F.col("_person.first"), F.col("_person.last"))
        ).alias("name"),
        create_text(headline, detector.detect(headline)).alias("title"),
        F.col("_person.location").alias("location"),
        "email",
        "phone",
        create_text(summary, detector.detect(summary)).alias("summary"),
    )


def profile_text(_: Style, language: str) -> Column:
    """The profile document; null when every part is missing."""
    title, summary = localised("title", language), localised("summary", language)
    contact = tx.join_nonblank(
        value("location"), value("email"), value("phone"), separator=" | "
    )
    name = value("name")
    return tx.blank_to_null(
        F.concat_ws(
            "\n",
            when_present(name, "# ", name, "\n"),
            when_present(title, "**", title, "**\n"),
            when_present(contact, contact, "\n"),
            when_present(summary, "## Summary\n\n", summary, "\n"),
        )
    )


PROFILE_SECTIONS = [
    _first_profile_value("name", _name),
    _first_profile_text("title", "Headline"),
    Section("email", [EMAILS], {}, build=_email),
    Section("phone", [PHONES], {}, build=_phone),
    _first_profile_value("location", _location),
    _first_profile_text("summary", "Summary"),
    Section(
        "profile_meta", [PROFILE, REGISTRATION, CONNECTIONS], {}, build=profile_meta
    ),
]
