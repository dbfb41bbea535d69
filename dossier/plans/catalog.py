"""The section catalog: 51 sections and 45 documents as data.

Source column names, section names and headings are fixed values: exports carry the former and
readers of the documents expect the latter. Documents stand in the order they are produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import dates
from dossier.functions import text as tx
from dossier.functions.fixed import LANGUAGE_NAMES
from dossier.functions.language import Detector, create_texts, get_text
from dossier.operators.numbering import number_rows
from dossier.operators.records import has_record, open_record
from dossier.operators.select_first import first_per_key, first_row
from dossier.operators.translations import dedup_translations
from dossier.plans.layouts import (
    BLANK,
    RULE,
    blocks,
    bullet_list,
    escaped,
    lines,
    link,
    localised,
    shown,
    table,
    value,
    when_present,
)
from dossier.plans.profile import PROFILE_SECTIONS, profile_parts, profile_text
from dossier.plans.section import (
    Document,
    Merge,
    Section,
    Style,
    cell,
    derived,
    multilingual,
    optional,
    plain,
    quoted,
)
from dossier.sources.raw import RawRows, get_table


def _has(*columns: str):
    """Keep a row when any of the columns is filled."""

    return lambda: F.expr(" OR ".join(f"cells[{quoted(c)}] <> ''" for c in columns))


def _is(column: str, expected: str):
    return lambda: cell(column) == expected


def _both(first, second):
    return lambda: first() & second()


def _name(first: str, last: str):
    return derived(lambda: tx.full_name(cell(first), cell(last)))


def _contact_name() -> Column:
    return tx.join_nonblank(cell("FirstName"), cell("MiddleName"), cell("LastName"))


def _date(column: str):
    return derived(lambda: dates.format_date(cell(column)))


def _optional_date(column: str):
    return derived(lambda: tx.blank_to_null(dates.format_date(cell(column))))


def _pipe_list(column: str):
    return derived(lambda: tx.split_pipe_list(cell(column)))


def _flag(column: str, word: str):
    return derived(lambda: tx.flag_equals(cell(column), word))


def _bullets(column: str):
    def build(detector: Detector) -> Column:
        description = cell(column)
        return create_texts(
            tx.split_bullets(description), detector.detect(description), detector.languages
        )

    return build


def _skills(raw: RawRows, _: Detector) -> DataFrame:
    return dedup_translations(get_table(raw, ["skills"]), ["export_id"], "ord", cell("Name"))


def _languages(raw: RawRows, _: Detector) -> DataFrame:
    base = tx.before_paren(cell("Name"))
    rows = (
        get_table(raw, ["languages"])
        .filter(cell("Name") != "")
        .select(
            "export_id",
            "ord",
            tx.lookup(F.lower(base), LANGUAGE_NAMES, base).alias("name"),
            tx.blank_to_null(cell("Proficiency")).alias("proficiency"),
        )
    )
    return first_per_key(rows, ["export_id"], F.lower("name"), "ord")


def _record() -> Column:
    return open_record(F.col("header"), F.col("cells"))


def _ad_targeting(raw: RawRows, _: Detector) -> DataFrame:
    rows = get_table(raw, ["ad_targeting"]).select("export_id", "ord", "header", "cells")
    first = first_row(rows, ["export_id"], "ord").filter(has_record(F.col("header"), F.col("cells")))
    return first.select("export_id", "ord", _record().alias("criteria"))


JOB_APPLICATION_TABLES = ["job_applications", "job_applications_1", "job_applications_2"]
SCREENING_TABLES = [
    "job_applicant_saved_screening_question_responses",
    "job_applicant_saved_screening_question_responses_1",
    "job_applicant_saved_screening_question_responses_2",
]

SECTIONS: list[Section] = [
    *PROFILE_SECTIONS,
    # Professional
    Section("skills", ["skills"], {}, build=_skills),
    Section(
        "experience",
        ["positions"],
        {
            "company": plain("Company Name"),
            "role": multilingual("Title"),
            "location": optional("Location"),
            "start": _date("Started On"),
            "end": _optional_date("Finished On"),
            "achievements": _bullets("Description"),
        },
        merge=Merge(["company", "start", "end", "location"], ["role"], "achievements"),
    ),
    Section(
        "education",
        ["education"],
        {
            "institution": plain("School Name"),
            "degree": multilingual("Degree Name"),
            "field": derived(lambda: F.lit(None).cast("string")),
            "start": derived(lambda: dates.year_of(cell("Start Date"))),
            "end": derived(lambda: dates.end_year_of(cell("End Date"))),
            "location": derived(lambda: F.lit(None).cast("string")),
            "notes": multilingual("Notes"),
            "activities": optional("Activities"),
        },
        merge=Merge(["institution", "start", "end"], ["degree", "notes"]),
    ),
    Section(
        "certifications",
        ["certifications"],
        {
            "name": plain("Name"),
            "issuer": plain("Authority"),
            "date": _date("Started On"),
            "expires": _optional_date("Finished On"),
            "url": optional("Url"),
            "credential_id": optional("License Number"),
        },
        keep=_has("Name"),
    ),
    Section("languages", ["languages"], {}, build=_languages),
    Section(
        "projects",
        ["projects"],
        {
            "title": plain("Title"),
            "description": multilingual("Description"),
            "url": optional("Url"),
            "start": _date("Started On"),
            "end": _optional_date("Finished On"),
        },
        keep=_has("Title"),
        merge=Merge(["title", "start", "end", "url"], ["description"]),
    ),
    # Recommendations and endorsements
    Section(
        "recommendations",
        ["recommendations_received"],
        {
            "author": _name("First Name", "Last Name"),
            "title": optional("Job Title"),
            "company": optional("Company"),
            "text": multilingual("Text"),
            "date": derived(lambda: dates.parse_us_datetime(cell("Creation Date"))),
        },
        keep=_both(_has("Text"), _is("Status", "VISIBLE")),
    ),
    Section(
        "recommendations_given",
        ["recommendations_given"],
        {
            "recipient": _name("First Name", "Last Name"),
            "title": optional("Job Title"),
            "company": optional("Company"),
            "text": multilingual("Text"),
            "date": derived(lambda: dates.parse_us_datetime(cell("Creation Date"))),
        },
        keep=_has("Text"),
    ),
    Section(
        "endorsements",
        ["endorsement_received_info"],
        {
            "skill": plain("Skill Name"),
            "endorser": _name("Endorser First Name", "Endorser Last Name"),
            "endorser_url": optional("Endorser Public Url"),
            "date": derived(lambda: dates.parse_utc_date(cell("Endorsement Date"))),
        },
        keep=_is("Endorsement Status", "ACCEPTED"),
    ),
    Section(
        "endorsements_given",
        ["endorsement_given_info"],
        {
            "skill": plain("Skill Name"),
            "endorsee": _name("Endorsee First Name", "Endorsee Last Name"),
            "endorsee_url": optional("Endorsee Public Url"),
            "date": derived(lambda: dates.parse_utc_date(cell("Endorsement Date"))),
        },
        keep=_is("Endorsement Status", "ACCEPTED"),
    ),
    # Learning
    Section(
        "learning",
        ["learning"],
        {
            "title": plain("Content Title"),
            "description": optional("Content Description"),
            "content_type": optional("Content Type"),
            "last_watched": optional("Content Last Watched Date (if viewed)"),
            "completed_at": optional("Content Completed At (if completed)"),
            "saved": _flag("Content Saved", "true"),
        },
        keep=_has("Content Title"),
    ),
    Section(
        "learning_reviews",
        ["reviews"],
        {
            "content": plain("Reviewee"),
            "review_type": optional("Review Type"),
            "section": optional("Review Section"),
            "date": optional("Creation Date"),
            "rating": optional("Rating"),
            "text": optional("Review Text"),
            "reviewer": optional("Reviewer"),
            "tags": optional("Review Tags"),
        },
        keep=_has("Reviewee"),
    ),
    # Network
    Section(
        "connections",
        ["connections"],
        {
            "name": _name("First Name", "Last Name"),
            "url": optional("URL"),
            "email": optional("Email Address"),
            "company": optional("Company"),
            "position": optional("Position"),
            "connected_on": optional("Connected On"),
        },
        keep=_has("First Name", "Last Name"),
    ),
    Section(
        "companies_followed",
        ["company_follows"],
        {"name": plain("Organization"), "followed_on": optional("Followed On")},
        keep=_has("Organization"),
    ),
    Section(
        "members_followed",
        ["member_follows"],
        {"name": plain("FullName"), "date": optional("Date"), "status": optional("Status")},
        keep=_has("FullName"),
    ),
    Section(
        "invitations",
        ["invitations"],
        {
            "from": plain("From"),
            "to": plain("To"),
            "sent_at": optional("Sent At"),
            "message": optional("Message"),
            "direction": optional("Direction"),
            "inviter_url": optional("inviterProfileUrl"),
            "invitee_url": optional("inviteeProfileUrl"),
        },
        keep=_has("From", "To"),
    ),
    Section(
        "imported_contacts",
        ["importedcontacts"],
        {
            "name": derived(lambda: tx.blank_to_null(_contact_name())),
            "emails": optional("Emails"),
            "phones": optional("PhoneNumbers"),
            "title": optional("Title"),
            "location": optional("Location"),
            "created_at": optional("CreatedAt"),
            "updated_at": optional("UpdatedAt"),
        },
        keep=_has("FirstName", "MiddleName", "LastName", "Emails"),
    ),
    # Content
    Section(
        "posts",
        ["shares"],
        {
            "date": plain("Date"),
            "url": optional("ShareLink"),
            "content": multilingual("ShareCommentary"),
            "shared_url": optional("SharedUrl"),
            "media_url": optional("MediaUrl"),
            "visibility": optional("Visibility"),
        },
        keep=_has("Date"),
    ),
    Section(
        "comments",
        ["comments"],
        {"date": plain("Date"), "url": optional("Link"), "message": multilingual("Message")},
        keep=_has("Date"),
    ),
    Section(
        "reactions",
        ["reactions"],
        {"date": plain("Date"), "type": optional("Type"), "url": optional("Link")},
        keep=_has("Date"),
    ),
    Section(
        "reposts",
        ["instantreposts"],
        {"date": plain("Date"), "url": optional("Link")},
        keep=_has("Date"),
    ),
    Section(
        "votes",
        ["votes"],
        {"date": plain("Date"), "url": optional("Link"), "option": optional("OptionText")},
        keep=_has("Date"),
    ),
    Section(
        "saved_items",
        ["saved_items"],
        {"url": plain("savedItem"), "saved_at": optional("CreatedTime")},
        keep=_has("savedItem"),
    ),
    Section(
        "events",
        ["events"],
        {
            "name": plain("Event Name"),
            "time": optional("Event Time"),
            "status": optional("Status"),
            "url": optional("External Url"),
        },
        keep=_has("Event Name"),
    ),
    Section(
        "media",
        ["rich_media"],
        {
            "date": optional("Date/Time"),
            "description": optional("Media Description"),
            "url": plain("Media Link"),
        },
        keep=_has("Media Link"),
    ),
    Section(
        "messages",
        ["messages"],
        {
            "conversation_id": plain("CONVERSATION ID"),
            "conversation_title": optional("CONVERSATION TITLE"),
            "from_name": plain("FROM"),
            "from_url": optional("SENDER PROFILE URL"),
            "to_name": plain("TO"),
            "to_url": optional("RECIPIENT PROFILE URLS"),
            "date": plain("DATE"),
            "subject": optional("SUBJECT"),
            "content": optional("CONTENT"),
            "folder": optional("FOLDER"),
        },
        keep=_has("DATE"),
    ),
    # Jobs
    Section(
        "job_applications",
        JOB_APPLICATION_TABLES,
        {
            "date": plain("Application Date"),
            "company": plain("Company Name"),
            "title": plain("Job Title"),
            "url": optional("Job Url"),
            "resume_used": optional("Resume Name"),
            "contact_email": optional("Contact Email"),
            "contact_phone": optional("Contact Phone Number"),
            "questions_answers": optional("Question And Answers"),
        },
        keep=_has("Company Name", "Job Title"),
    ),
    Section(
        "saved_jobs",
        ["saved_jobs"],
        {
            "date": plain("Saved Date"),
            "company": plain("Company Name"),
            "title": plain("Job Title"),
            "url": optional("Job Url"),
        },
        keep=_has("Company Name", "Job Title"),
    ),
    Section(
        "job_preferences",
        ["job_seeker_preferences"],
        {
            "locations": _pipe_list("Locations"),
            "industries": _pipe_list("Industries"),
            "job_types": _pipe_list("Preferred Job Types"),
            "job_titles": _pipe_list("Job Titles"),
            "open_to_recruiters": _flag("Open To Recruiters", "yes"),
            "dream_companies": _pipe_list("Dream Companies"),
            "profile_shared": _flag("Profile Shared With Job Poster", "yes"),
            "intro_statement": optional("Introduction Statement"),
            "phone": optional("Phone Number"),
        },
        first_only=True,
    ),
    Section(
        "saved_job_answers",
        ["job_applicant_saved_answers"],
        {"question": plain("Question"), "answer": optional("Answer")},
        keep=_has("Question"),
    ),
    Section(
        "screening_responses",
        SCREENING_TABLES,
        {"responses": derived(_record)},
        keep=lambda: has_record(F.col("header"), F.col("cells")),
    ),
    Section(
        "saved_job_alerts",
        ["savedjobalerts"],
        {
            "search_id": optional("SAVED_SEARCH_ID"),
            "parameters": optional("ALERT_PARAMETERS"),
            "query_context": optional("QUERY_CONTEXT"),
        },
    ),
    # Activity
    Section(
        "search_queries",
        ["searchqueries"],
        {"time": plain("Time"), "query": plain("Search Query")},
        keep=_has("Search Query"),
    ),
    Section(
        "logins",
        ["logins"],
        {
            "date": plain("Login Date"),
            "ip_address": optional("IP Address"),
            "user_agent": optional("User Agent"),
            "login_type": optional("Login Type"),
        },
        keep=_has("Login Date"),
    ),
    Section(
        "security_challenges",
        ["security_challenges"],
        {
            "date": plain("Challenge Date"),
            "ip_address": optional("IP Address"),
            "user_agent": optional("User Agent"),
            "country": optional("Country"),
            "challenge_type": optional("Challenge Type"),
        },
        keep=_has("Challenge Date"),
    ),
    # Advertising
    Section(
        "ads_clicked",
        ["ads_clicked"],
        {"date": plain("Ad clicked Date"), "ad_id": optional("Ad Title/Id")},
        keep=_has("Ad clicked Date"),
    ),
    Section("ad_targeting", ["ad_targeting"], {}, build=_ad_targeting),
    Section(
        "lan_ads",
        ["lan_ads_engagement"],
        {
            "date": plain("Date"),
            "action": optional("Action"),
            "ad_id": optional("Ad Title/Id"),
            "page_app": optional("Page/App"),
        },
        keep=_has("Date"),
    ),
    Section(
        "inferences",
        ["inferences_about_you"],
        {
            "category": optional("Category"),
            "type": optional("Type of inference"),
            "description": optional("Description"),
            "inference": optional("Inference"),
        },
    ),
    # Payments and services
    Section(
        "receipts",
        ["receipts", "receipts_v2"],
        {
            "date": optional("Transaction Made At"),
            "description": optional("Description"),
            "amount": optional("Total Amount"),
            "currency": optional("Currency Code"),
            "payment_method": optional("Payment Method Type"),
            "invoice_number": optional("Invoice Number"),
        },
    ),
    Section(
        "service_engagements",
        ["engagements"],
        {
            "date": optional("Creation Time"),
            "marketplace_type": optional("Marketplace Type"),
            "body": optional("Body"),
            "currency": optional("Currency Code"),
            "amount": optional("Currency Amount"),
            "billing_unit": optional("Billing Time Unit"),
            "free_consultation": optional("Free Consultation included"),
        },
    ),
    Section(
        "service_opportunities",
        ["opprtunities"],
        {
            "date": optional("Creation Time"),
            "marketplace_type": optional("Marketplace Type"),
            "category": optional("Service Category"),
            "location": optional("Location"),
            "questions_answers": optional("Questions and Answers"),
            "preferred_providers": optional("Preferred Providers"),
            "status": optional("Status"),
        },
    ),
    # Identity
    Section(
        "verifications",
        ["verifications"],
        {
            "first_name": optional("First name"),
            "middle_name": optional("Middle name"),
            "last_name": optional("Last name"),
            "verification_type": optional("Verification type"),
            "issuing_authority": optional("Issuing authority"),
            "document_type": optional("Document type"),
            "provider": optional("Verification service provider"),
            "verified_date": optional("Verified date"),
            "expiry_date": optional("Expiry date"),
        },
    ),
    Section(
        "identity_assets",
        ["private_identity_asset"],
        {
            "name": plain("Private Identity Asset Name"),
            "has_content": derived(lambda: cell("Private Identity Asset Raw Text") != ""),
        },
        keep=_has("Private Identity Asset Name"),
    ),
]


def _bold(c: Column) -> Column:
    return when_present(c, "**", c, "**")


def _labelled(label: str, c: Column) -> Column:
    return when_present(c, f"**{label}:** ", c)


def _quoted(c: Column) -> Column:
    """A blank line and the text as a block quote."""
    return when_present(c, "\n> ", c)


def _linked(style: Style, label: str) -> Column:
    """A blank line and a link to the entry's ``url``."""
    url = style.url(F.col("url"))
    return when_present(url, f"\n[{label}](", url, ")")


def _experience_block(_: Style, lang: str) -> Column:
    role, location = localised("role", lang), value("location")
    bullets = F.filter(
        F.transform(F.col("achievements"), lambda a: get_text(a["text"], lang)), lambda b: b != ""
    )
    listed = F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n")
    meta = F.concat(
        F.coalesce(_bold(role), F.lit("")),
        F.lit(" | "),
        dates.open_range(F.col("start"), F.col("end")),
        F.coalesce(when_present(location, " | ", location), F.lit("")),
    )
    return lines(
        F.concat(F.lit("## "), value("company")),
        meta,
        BLANK,
        tx.blank_to_null(listed),
        BLANK,
        RULE,
    )


def _education_block(_: Style, lang: str) -> Column:
    notes, activities = localised("notes", lang), value("activities")
    return lines(
        F.concat(F.lit("## "), value("institution")),
        tx.blank_to_null(
            F.concat_ws(
                " | ",
                _bold(localised("degree", lang)),
                dates.started_range(F.col("start"), F.col("end")),
            )
        ),
        BLANK,
        when_present(notes, tx.blockquote(notes), "\n"),
        when_present(activities, "Activities: ", activities, "\n"),
        RULE,
    )


def _certification_block(style: Style, _: str) -> Column:
    return lines(
        F.concat(F.lit("## "), value("name")),
        tx.blank_to_null(
            F.concat_ws(" | ", _bold(value("issuer")), tx.blank_to_null(value("date")))
        ),
        _linked(style, "View Certificate"),
        BLANK,
        RULE,
    )


def _language_item() -> Column:
    name, proficiency = value("name"), value("proficiency")
    return F.coalesce(when_present(proficiency, "**", name, "**: ", proficiency), name)


def _project_block(style: Style, lang: str) -> Column:
    description = localised("description", lang)
    return lines(
        F.concat(F.lit("## "), value("title")),
        dates.closed_range(F.col("start"), F.col("end")),
        when_present(description, "\n", description),
        _linked(style, "View Project"),
        BLANK,
        RULE,
    )


def _recommendation_block(heading: str, person: str):
    def block(_: Style, lang: str) -> Column:
        company, date = value("company"), value("date")
        return lines(
            F.concat(F.lit(f"## {heading} "), value(person)),
            tx.blank_to_null(
                F.concat_ws(
                    " ",
                    _bold(value("title")),
                    when_present(company, "at ", company),
                    when_present(date, "| ", date),
                )
            ),
            _quoted(localised("text", lang)),
            BLANK,
            RULE,
        )

    return block


def _post_block(style: Style, lang: str) -> Column:
    content = localised("content", lang)
    return lines(
        F.concat(F.lit("## "), value("date")),
        when_present(content, "\n", content),
        _linked(style, "View Post"),
        BLANK,
        RULE,
    )


def _comment_block(style: Style, lang: str) -> Column:
    message = localised("message", lang)
    return lines(
        F.concat(F.lit("**"), value("date"), F.lit("**")),
        when_present(message, tx.blockquote(message)),
        tx.blank_to_null(tx.link_cell(style.url(F.col("url")))),
    )


def _message_block(_: Style, __: str) -> Column:
    return lines(
        F.concat(F.lit("## "), value("date")),
        F.concat(F.lit("**From:** "), value("from_name"), F.lit(" → **To:** "), value("to_name")),
        _labelled("Subject", value("subject")),
        _quoted(tx.truncate(value("content"))),
        BLANK,
        RULE,
    )


def _answer_block(_: Style, __: str) -> Column:
    return lines(
        F.concat(F.lit("**Q:** "), value("question")),
        F.concat(F.lit("**A:** "), value("answer")),
    )


def _screening_block(_: Style, __: str) -> Column:
    answers = F.transform(
        F.col("responses"),
        lambda r: F.concat(F.lit("- **"), r["key"], F.lit(":** "), r["value"]),
    )
    return lines(
        F.concat(F.lit("## Response "), F.col("number").cast("string")),
        F.array_join(answers, "\n"),
    )


def _alert_block(style: Style, _: str) -> Column:
    return lines(
        F.concat(F.lit("**Alert ID:** "), style.shown(F.col("search_id"))),
        _labelled("Query", value("query_context")),
    )


def _opportunity_block(_: Style, __: str) -> Column:
    details = value("questions_answers")
    return lines(
        F.concat(F.lit("## "), value("category")),
        F.concat(F.lit("**Date:** "), value("date")),
        _labelled("Location", value("location")),
        _labelled("Status", value("status")),
        when_present(details, "\n**Details:**\n> ", details),
        BLANK,
        RULE,
    )


def _verification_block(_: Style, __: str) -> Column:
    name = F.concat_ws(
        " ", *[tx.skip_na(F.col(c)) for c in ("first_name", "middle_name", "last_name")]
    )
    return lines(
        F.concat(F.lit("## "), name),
        _labelled("Type", value("verification_type")),
        _labelled("Document", value("document_type")),
        _labelled("Provider", value("provider")),
        _labelled("Verified", value("verified_date")),
        _labelled("Expires", tx.skip_na(F.col("expiry_date"))),
    )


def _preferences_record(_: Style, __: str) -> Column:
    def listed(label: str, name: str) -> Column:
        joined = F.array_join(F.col(name), ", ")
        return F.when(F.size(name) > 0, F.concat(F.lit(f"\n**{label}:** "), joined, F.lit("\n")))

    return F.concat_ws(
        "",
        listed("Locations", "locations"),
        listed("Job Titles", "job_titles"),
        listed("Job Types", "job_types"),
        listed("Industries", "industries"),
        F.when(F.col("open_to_recruiters"), "\n**Open to Recruiters:** Yes\n"),
        listed("Dream Companies", "dream_companies"),
    )


def _targeting_record(_: Style, __: str) -> Column:
    entries = F.transform(
        F.col("criteria"),
        lambda e: F.concat(
            F.lit("\n**"), tx.title_case_key(e["key"]), F.lit(":** "), e["value"], F.lit("\n")
        ),
    )
    return F.array_join(entries, "")


def _record_document(section: str, title: str, line) -> Document:
    return Document(section, f"# {title}\n", line)


def _asset_item() -> Column:
    state = F.when(F.col("has_content"), " (with content)").otherwise(" (no content)")
    return F.concat(value("name"), state)


def _course_item() -> Column:
    status = tx.completion_status(F.col("completed_at"))
    return F.concat(F.lit("**"), value("title"), F.lit("** ("), status, F.lit(")"))


PROFILE_DOCUMENT = Document("profile", "", profile_text, separator="", multilingual=True)

DOCUMENTS: list[Document] = [
    PROFILE_DOCUMENT,
    # Activity
    table("search_queries", "Search History", {"Time": "time", "Query": escaped("query")}),
    table(
        "logins",
        "Login History",
        {"Date": "date", "IP Address": "ip_address", "Type": "login_type"},
    ),
    table(
        "security_challenges",
        "Security Challenges",
        {
            "Date": "date",
            "IP Address": "ip_address",
            "Country": "country",
            "Type": "challenge_type",
        },
    ),
    # Advertising
    table("ads_clicked", "Ads Clicked", {"Date": "date", "Ad ID": "ad_id"}),
    _record_document("ad_targeting", "Ad Targeting Criteria", _targeting_record),
    table(
        "lan_ads",
        "LinkedIn Audience Network Ads",
        {"Date": "date", "Action": "action", "Ad ID": "ad_id", "Page/App": "page_app"},
    ),
    table(
        "inferences",
        "LinkedIn's Inferences About You",
        {
            "Category": "category",
            "Type": "type",
            "Description": "description",
            "Inference": "inference",
        },
    ),
    # Content
    blocks("posts", "Posts", _post_block, multilingual=True),
    blocks("comments", "Comments", _comment_block, multilingual=True),
    table("reactions", "Reactions", {"Date": "date", "Type": "type", "Link": link("url")}),
    table("reposts", "Reposts", {"Date": "date", "Link": link("url")}),
    table("votes", "Poll Votes", {"Date": "date", "Option": "option", "Link": link("url")}),
    table("saved_items", "Saved Items", {"Saved At": "saved_at", "Link": link("url")}),
    table("events", "Events", {"Name": "name", "Time": "time", "Status": "status"}),
    table(
        "media",
        "Uploaded Media",
        {"Date": "date", "Description": "description", "Link": link("url")},
    ),
    blocks("messages", "Messages", _message_block),
    # Identity
    blocks("verifications", "Identity Verifications", _verification_block),
    bullet_list("identity_assets", "Uploaded Documents", _asset_item),
    # Jobs
    table(
        "job_applications",
        "Job Applications",
        {"Date": "date", "Company": "company", "Position": "title", "Resume": "resume_used"},
    ),
    table(
        "saved_jobs",
        "Saved Jobs",
        {"Date": "date", "Company": "company", "Position": "title"},
    ),
    _record_document("job_preferences", "Job Seeker Preferences", _preferences_record),
    blocks("saved_job_answers", "Saved Job Application Answers", _answer_block),
    blocks(
        "screening_responses",
        "Screening Question Responses",
        _screening_block,
        prepare=lambda rows: number_rows(rows, ["export_id"], "ord", "number"),
    ),
    blocks("saved_job_alerts", "Saved Job Alerts", _alert_block),
    # Learning
    bullet_list("learning", "LinkedIn Learning", _course_item),
    table(
        "learning_reviews",
        "Learning Reviews",
        {"Content": "content", "Rating": shown("rating"), "Date": shown("date")},
    ),
    # Network
    table(
        "connections",
        "Connections",
        {
            "Name": "name",
            "Company": "company",
            "Position": "position",
            "Connected": "connected_on",
        },
    ),
    bullet_list("companies_followed", "Companies Followed", lambda: value("name")),
    table(
        "members_followed",
        "Members Followed",
        {"Name": "name", "Date": "date", "Status": "status"},
    ),
    table(
        "invitations",
        "Connection Invitations",
        {"From": "from", "To": "to", "Date": "sent_at", "Direction": "direction"},
    ),
    table(
        "imported_contacts",
        "Imported Contacts",
        {"Name": "name", "Email": "emails", "Title": "title"},
    ),
    # Payments
    table(
        "receipts",
        "Payment Receipts",
        {
            "Date": "date",
            "Description": "description",
            "Amount": "amount",
            "Currency": "currency",
        },
    ),
    # Professional
    Document(
        "skills", "# Skills\n\n", lambda _style, _lang: value("name"), "\n", separator=", "
    ),
    blocks("experience", "Experience", _experience_block, multilingual=True),
    blocks("education", "Education", _education_block, multilingual=True),
    blocks("certifications", "Certifications", _certification_block),
    bullet_list("languages", "Languages", _language_item),
    blocks("projects", "Projects", _project_block, multilingual=True),
    # Recommendations
    blocks(
        "recommendations",
        "Recommendations",
        _recommendation_block("From", "author"),
        multilingual=True,
    ),
    blocks(
        "recommendations_given",
        "Recommendations Given",
        _recommendation_block("To", "recipient"),
        multilingual=True,
    ),
    table(
        "endorsements",
        "Endorsements",
        {"Skill": "skill", "Endorsed By": "endorser", "Date": shown("date")},
    ),
    table(
        "endorsements_given",
        "Endorsements Given",
        {"Skill": "skill", "Endorsed": "endorsee", "Date": shown("date")},
    ),
    # Services
    table(
        "service_engagements",
        "Service Marketplace Engagements",
        {
            "Date": "date",
            "Type": "marketplace_type",
            "Amount": "amount",
            "Currency": "currency",
        },
    ),
    blocks("service_opportunities", "Service Marketplace Opportunities", _opportunity_block),
]

# The profile document is built from six sections at once.
DOCUMENT_SOURCES = {
    "profile": Section(
        "profile", ["profile", "email_addresses", "phonenumbers"], {}, build=profile_parts
    )
}
