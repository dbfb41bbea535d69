"""Which column of the test tables feeds which CSV column.

Every expression is SQL that Spark and DuckDB read alike, so both sides of a check start from the
same rows. All rows of a table are used, texts whole; conditions only decide what other cells hold. Blank
texts come in rows of their own, added behind the table's.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources.raw import as_raw_rows


@dataclass(frozen=True)
class Binding:
    table: str
    export: str
    order: str
    cells: dict[str, str]

    def blank_rows(self) -> tuple[str, str] | None:
        """The text column of the table that some cell holds, and for which of its rows a further
        row with a blank text is added."""
        known = BLANK_ROWS.get(self.table)
        return known if known and known[0] in self.cells.values() else None


#: A blank row follows the rows of its table in its export.
BLANK_ROWS = {
    "documents": ("text", "doc_id % 11 = 0"),
    "pages": ("html", "page_id % 11 = 0"),
    "conversations": ("text", "turn % 11 = 5"),
    "benchmark": ("text", "item_id % 11 = 0"),
}
BLANK_ORDER = 1 << 36


def text_of(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def either(condition: str, then: str, otherwise: str = "''") -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


def day(ts: str) -> str:
    return text_of(f"CAST({ts} AS DATE)")


def us_time(ts: str) -> str:
    d = day(ts)
    return f"substr({d}, 6, 2) || '/' || substr({d}, 9, 2) || '/' || substr({d}, 3, 2) || ', 11:04 PM'"


def utc_time(ts: str) -> str:
    return f"replace({day(ts)}, '-', '/') || ' 02:51:39 UTC'"


def url(path: str) -> str:
    return f"'https://example.com/' || {text_of(path)}"


MEMBER = f"'member-' || {text_of('o_custkey')}"
NATION = f"'nation-' || {text_of('c_nationkey')}"
SUPPLIERS = f"'nation-' || {text_of('s_nationkey')}"
USER = f"'user-' || {text_of('user_id')}"
HOST = "split_part(url, '/', 3)"
FINISHED = "o_orderstatus = 'F'"
OPEN = "o_orderstatus = 'O'"
LONG = "n_chars > 1500"
PARTIAL_DATE = (
    "CASE WHEN n_chars < 500 THEN '' WHEN n_chars < 1000 THEN '2020' "
    "WHEN n_chars < 1500 THEN '2020-03-01' WHEN n_chars < 2500 THEN 'Mar 2020' "
    "WHEN n_chars < 3500 THEN '2020-13' ELSE '2021-00-10' END"
)
LATE_DATE = (
    "CASE WHEN n_chars < 1500 THEN '' WHEN n_chars < 2500 THEN '2022-12' ELSE '2023' END"
)
US_DATE = (
    "CASE WHEN n_chars < 500 THEN '' WHEN n_chars < 1000 THEN '08/19/24, 11:04 PM' "
    "WHEN n_chars < 1500 THEN '1/1/99' WHEN n_chars < 2500 THEN '13/1/24, x' "
    "ELSE '2023-05-15' END"
)
ROLE = (
    "CASE WHEN lang = 'es' THEN 'Ingeniero de la empresa' WHEN n_chars < 800 THEN '' "
    "WHEN lang = 'de' THEN 'Leiter der Technik' ELSE 'Engineer, ' || lang END"
)


def _orders(cells: dict[str, str]) -> Binding:
    return Binding("orders", MEMBER, "o_orderkey", cells)


def _documents(export: str, cells: dict[str, str]) -> Binding:
    return Binding("documents", export, "doc_id", cells)


def _events(cells: dict[str, str]) -> Binding:
    return Binding("events", USER, "event_id", cells)


def _parts(cells: dict[str, str]) -> Binding:
    return Binding("part", "p_brand", "p_partkey", cells)


def _pages(cells: dict[str, str]) -> Binding:
    return Binding("pages", HOST, "page_id", cells)


def _customers(cells: dict[str, str]) -> Binding:
    return Binding("customer", NATION, "c_custkey", cells)


def _suppliers(cells: dict[str, str]) -> Binding:
    return Binding("supplier", SUPPLIERS, "s_suppkey", cells)


JOB_CELLS = {
    "Application Date": either("c_acctbal > 5000", "'2024-02-01'"),
    "Company Name": either("c_acctbal > 0", "c_name"),
    "Job Title": either("c_mktsegment < 'F'", "''", "c_mktsegment"),
    "Job Url": either("c_acctbal > 2000", url("c_custkey")),
    "Resume Name": either("c_acctbal > 1000", "c_mktsegment || '.pdf'"),
    "Contact Email": either("c_acctbal > 3000", "lower(c_name) || '@example.com'"),
    "Contact Phone Number": text_of("c_custkey"),
    "Question And Answers": either("c_acctbal < 3000", "'Q: ' || c_mktsegment"),
}
SUPPLIER_JOB_CELLS = {
    "Application Date": "'2024-03-01'",
    "Company Name": "s_name",
    "Job Title": either("s_acctbal > 0", "'Supplier'"),
}
ANSWERS = {
    "Years Of Experience": either("p_size > 5", text_of("p_size")),
    "Skill": either("p_type = 'PROMO'", "''", "p_name"),
    "skill": either("p_size > 45", "p_type"),
}

BINDINGS: dict[str, Binding] = {
    # Profile tables: one export per ordering customer, one row per order.
    "profile": _orders(
        {
            "First Name": either(FINISHED, "''", "o_orderpriority"),
            "Last Name": "'No ' || " + text_of("o_custkey"),
            "Headline": either(
                OPEN, "'Responsable de la empresa'", either(FINISHED, "''", "'Head of ' || o_orderpriority")
            ),
            "Summary": either("o_totalprice > 100000", "'Works | with ' || o_orderpriority"),
            "Industry": either("o_totalprice > 200000", "o_orderpriority"),
            "Geo Location": either(OPEN, "o_orderpriority"),
            "Location": either(FINISHED, "''", "'Town ' || o_orderstatus"),
            "Twitter Handles": either(OPEN, "'[' || lower(o_orderpriority) || ']'", either(FINISHED, "'[]'")),
            "Websites": either(FINISHED, "''", "'a.example.com, ;b.example.com; ' || lower(o_orderstatus)"),
            "Birth Date": either(OPEN, day("o_orderdate")),
        }
    ),
    "email_addresses": _orders(
        {
            "Email Address": either(
                "o_totalprice < 20000", "''", text_of("o_orderkey") + " || '@example.com'"
            ),
            "Primary": either(FINISHED, "'YES'", "'No'"),
        }
    ),
    "phonenumbers": _orders(
        {"Number": either("o_totalprice < 50000", "''", "'+1 ' || " + text_of("o_orderkey"))}
    ),
    "registration": _orders({"Registered At": either(OPEN, day("o_orderdate"))}),
    "connections": _orders(
        {
            "First Name": either(FINISHED, "''", "o_orderpriority"),
            "Last Name": either("o_totalprice < 100000", "''", "'Z' || o_orderstatus"),
            "URL": either(OPEN, url("o_orderkey")),
            "Email Address": either(FINISHED, "'x@example.com'"),
            "Company": either("o_totalprice > 300000", "'Company ' || o_orderpriority"),
            "Position": either(OPEN, "'Lead'"),
            "Connected On": day("o_orderdate"),
        }
    ),
    # Professional
    "skills": _parts(
        {
            "Name": "CASE WHEN p_size < 3 THEN ' ' "
            "WHEN p_type = 'ECONOMY' THEN 'Sobre ' || p_type || ' (' || p_name || ')' "
            "WHEN p_type = 'PROMO' THEN upper(p_name) || ' ' "
            "WHEN p_type = 'SMALL' THEN p_name || ' (' || upper(p_name) || ' )' ELSE p_name END"
        }
    ),
    "positions": _documents(
        "source",
        {
            "Company Name": either("n_chars > 6000", "''", "'Company ' || source"),
            "Title": ROLE,
            "Description": "text",
            "Location": either(LONG, "''", "'Town'"),
            "Started On": PARTIAL_DATE,
            "Finished On": LATE_DATE,
        },
    ),
    "education": _documents(
        "lang",
        {
            "School Name": "'School ' || source",
            "Degree Name": ROLE,
            "Notes": "text",
            "Activities": either(LONG, "source"),
            "Start Date": PARTIAL_DATE,
            "End Date": LATE_DATE,
        },
    ),
    "certifications": _parts(
        {
            "Name": either("p_size < 3", "''", "p_name"),
            "Authority": either("p_type = 'SMALL'", "''", "p_type"),
            "Started On": either("p_size < 20", "'2020-05-01'", either("p_size < 30", "'2021'")),
            "Finished On": either("p_size > 25", "'2024-11'"),
            "Url": either("p_type = 'PROMO'", url("p_partkey")),
            "License Number": either("p_size > 10", text_of("p_partkey")),
        }
    ),
    "languages": _parts(
        {
            "Name": "CASE WHEN p_type = 'ECONOMY' THEN 'Inglés' WHEN p_type = 'PROMO' THEN 'English (UK)' "
            "WHEN p_type = 'SMALL' THEN 'español' WHEN p_type = 'LARGE' THEN '' "
            "WHEN p_size > 40 THEN '(unnamed)' ELSE p_name || ' (' || p_type || ')' END",
            "Proficiency": either("p_size < 25", "'Level ' || " + text_of("p_size")),
        }
    ),
    "projects": _documents(
        "lang",
        {
            "Title": either("doc_id % 13 = 0", "''", "'Project ' || source"),
            "Description": "text",
            "Url": either(LONG, "'https://example.com/' || source"),
            "Started On": PARTIAL_DATE,
            "Finished On": LATE_DATE,
        },
    ),
    # Recommendations
    "recommendations_received": _documents(
        "source",
        {
            "First Name": "upper(lang)",
            "Last Name": either(LONG, "''", "'R'"),
            "Company": either(LONG, "source"),
            "Job Title": either("n_chars < 2000", "'Lead'"),
            "Text": "text",
            "Creation Date": US_DATE,
            "Status": either("n_chars < 3000", "'VISIBLE'", "'visible'"),
        },
    ),
    "recommendations_given": _documents(
        "source",
        {
            "First Name": either(LONG, "''", "lang"),
            "Last Name": "'G'",
            "Company": either(LONG, "source"),
            "Job Title": either("n_chars < 2000", "'Lead'"),
            "Text": "text",
            "Creation Date": US_DATE,
        },
    ),
    "endorsement_received_info": _orders(
        {
            "Skill Name": "o_orderpriority",
            "Endorser First Name": either(OPEN, "'Ann'"),
            "Endorser Last Name": text_of("o_custkey"),
            "Endorser Public Url": either("o_totalprice > 200000", url("o_orderkey")),
            "Endorsement Date": either("o_totalprice < 250000", utc_time("o_orderdate"), day("o_orderdate")),
            "Endorsement Status": either(FINISHED, "'PENDING'", "'ACCEPTED'"),
        }
    ),
    "endorsement_given_info": _orders(
        {
            "Skill Name": "o_orderpriority",
            "Endorsee First Name": "'Bo'",
            "Endorsee Last Name": either(FINISHED, "''", "o_orderstatus"),
            "Endorsee Public Url": "''",
            "Endorsement Date": either(OPEN, "''", utc_time("o_orderdate")),
            "Endorsement Status": either("o_totalprice > 100000", "'ACCEPTED'", "'accepted'"),
        }
    ),
    # Learning
    "learning": _parts(
        {
            "Content Title": either("p_size < 3", "''", "p_name || ' course'"),
            "Content Description": either("p_size > 20", "p_type"),
            "Content Type": "'Video'",
            "Content Last Watched Date (if viewed)": either("p_size > 10", "'2023-01-01'"),
            "Content Completed At (if completed)": either("p_size > 30", "'2023-02-01'"),
            "Content Saved": either("p_type = 'PROMO'", "'TRUE'", "'no'"),
        }
    ),
    "reviews": _documents(
        "source",
        {
            "Reviewee": either("doc_id % 13 = 0", "''", "'Course ' || lang"),
            "Review Type": "'COURSE'",
            "Review Section": either(LONG, "lang"),
            "Creation Date": either(LONG, "'2022-01-01'"),
            "Rating": either("n_chars < 2000", text_of("n_chars")),
            "Review Text": "text",
            "Reviewer": "source",
            "Review Tags": "''",
        },
    ),
    # Network
    "company_follows": _parts(
        {
            "Organization": either("p_type = 'SMALL'", "''", "p_name"),
            "Followed On": either("p_size > 25", "'2022-03-03'"),
        }
    ),
    "member_follows": _customers(
        {
            "FullName": either("c_acctbal < 0", "''", "c_name"),
            "Date": either("c_acctbal > 5000", "'2022-04-04'"),
            "Status": either("c_mktsegment = 'BUILDING'", "''", "c_mktsegment"),
        }
    ),
    "invitations": _customers(
        {
            "From": either("c_acctbal < 1000", "''", "c_name"),
            "To": either("c_mktsegment = 'BUILDING'", "''", "c_mktsegment"),
            "Sent At": either("c_acctbal > 5000", "'1/2/23, 4:05 PM'"),
            "Message": either("c_acctbal > 8000", "'Hi ' || c_name"),
            "Direction": either("c_acctbal > 2000", "'OUTGOING'", "'INCOMING'"),
            "inviterProfileUrl": url("c_custkey"),
            "inviteeProfileUrl": "''",
        }
    ),
    "importedcontacts": _customers(
        {
            "FirstName": either("c_acctbal < 1000", "''", "'Kim'"),
            "MiddleName": either("c_mktsegment = 'BUILDING'", "'Q'"),
            "LastName": either("c_acctbal < 500", "''", "c_name"),
            "Emails": either("c_acctbal > 200", "'k@example.com'"),
            "PhoneNumbers": either("c_acctbal > 6000", text_of("c_custkey")),
            "Title": either("c_mktsegment = 'MACHINERY'", "''", "c_mktsegment"),
            "Location": "''",
            "CreatedAt": "'2020'",
            "UpdatedAt": "''",
        }
    ),
    # Content
    "shares": _documents(
        "source",
        {
            "Date": either("doc_id % 13 = 0", "''", "'2024-01-' || lang"),
            "ShareLink": either(LONG, url("doc_id")),
            "ShareCommentary": "text",
            "SharedUrl": either("n_chars < 1000", url("doc_id")),
            "MediaUrl": "''",
            "Visibility": "upper(lang)",
        },
    ),
    "comments": _documents(
        "source",
        {
            "Date": either("doc_id % 13 = 0", "''", "'2024-02-' || lang"),
            "Link": either(LONG, url("doc_id")),
            "Message": "text",
        },
    ),
    "reactions": _events(
        {
            "Date": either("event_type = 'error'", "''", day("ts")),
            "Type": either("event_type = 'view'", "''", "upper(event_type)"),
            "Link": either("value > 50", url("event_id")),
        }
    ),
    "instantreposts": _pages(
        {"Date": either("length(url) < 35", "''", "'2024-03-03'"), "Link": either("length(html) > 2000", "url")}
    ),
    "votes": _pages(
        {
            "Date": either("length(url) < 30", "''", "'2024-04-04'"),
            "Link": "url",
            "OptionText": "html",
        }
    ),
    "saved_items": _pages(
        {
            "savedItem": either("page_id % 13 = 0", "''", "url"),
            "CreatedTime": either("length(url) > 40", "'2024-05-05'"),
        }
    ),
    "events": _events(
        {
            "Event Name": either("event_type = 'view'", "''", "event_type"),
            "Event Time": either("value > 20", day("ts")),
            "Status": either("value > 60", "props"),
            "External Url": url("event_id"),
        }
    ),
    "rich_media": _pages(
        {
            "Date/Time": either("length(url) > 40", "'2024-06-06'"),
            "Media Description": "html",
            "Media Link": either("page_id % 13 = 0", "''", "url"),
        }
    ),
    "messages": Binding(
        "conversations",
        f"'conversation-' || {text_of('conv_id')}",
        "turn",
        {
            "CONVERSATION ID": text_of("conv_id"),
            "CONVERSATION TITLE": either("role = 'system'", "'Rules'"),
            "FROM": "role",
            "SENDER PROFILE URL": "''",
            "TO": either("role = 'user'", "'assistant'", "'user'"),
            "RECIPIENT PROFILE URLS": url("turn"),
            "DATE": either("turn % 13 = 7", "''", "'2024-07-07 10:' || " + text_of("turn")),
            "SUBJECT": either("role = 'system'", "'Setup'"),
            "CONTENT": "text",
            "FOLDER": "'INBOX'",
        },
    ),
    # Jobs
    "job_applications": _customers(JOB_CELLS),
    "job_applications_1": _suppliers(SUPPLIER_JOB_CELLS),
    "job_applications_2": _customers(
        {
            "Company Name": either("c_acctbal > 9000", "'Second ' || c_name"),
            "Job Title": either("c_acctbal < -900", "'Third'"),
            "Resume Name": "'cv.pdf'",
        }
    ),
    "saved_jobs": _customers(
        {
            "Saved Date": "'2024-08-08'",
            "Company Name": either("c_acctbal > 0", "c_name"),
            "Job Title": either("c_mktsegment = 'BUILDING'", "''", "c_mktsegment"),
            "Job Url": either("c_acctbal > 5000", url("c_custkey")),
        }
    ),
    "job_seeker_preferences": Binding(
        "orders",
        MEMBER,
        "o_orderkey",
        {
            "Locations": either(FINISHED, "''", "o_orderpriority || ' | ' || o_orderstatus || '||'"),
            "Industries": either(OPEN, "'Retail|Trade'"),
            "Preferred Job Types": "' | '",
            "Job Titles": either("o_totalprice > 200000", "'Lead|' || o_orderpriority"),
            "Open To Recruiters": either(OPEN, "'YES'", "'No'"),
            "Dream Companies": either("o_totalprice < 100000", "'Acme '"),
            "Profile Shared With Job Poster": either(FINISHED, "'yes'"),
            "Introduction Statement": either(OPEN, "'Hello'"),
            "Phone Number": text_of("o_custkey"),
        },
    ),
    "job_applicant_saved_answers": _parts(
        {
            "Question": either("p_size < 5", "''", "p_name || '?'"),
            "Answer": either("p_type = 'PROMO'", "''", "p_type"),
        }
    ),
    "job_applicant_saved_screening_question_responses": _parts(ANSWERS),
    "job_applicant_saved_screening_question_responses_1": _parts(
        {"Job Title": either("p_type = 'SMALL'", "p_name")}
    ),
    "job_applicant_saved_screening_question_responses_2": _parts(
        {"Notice Period": either("p_size > 40", "'none'")}
    ),
    "savedjobalerts": _suppliers(
        {
            "SAVED_SEARCH_ID": either("s_acctbal < 0", "''", text_of("s_suppkey")),
            "ALERT_PARAMETERS": "s_name",
            "QUERY_CONTEXT": either("s_acctbal > 3000", "s_name"),
        }
    ),
    # Activity and advertising
    "searchqueries": _events(
        {"Time": day("ts"), "Search Query": either("value < 5", "''", "event_type || ' | ' || props")}
    ),
    "logins": _events(
        {
            "Login Date": either("event_type = 'error'", "''", day("ts")),
            "IP Address": either("value > 10", "'10.0.0.' || " + text_of("user_id")),
            "User Agent": "props",
            "Login Type": either("event_type = 'view'", "''", "event_type"),
        }
    ),
    "security_challenges": _events(
        {
            "Challenge Date": either("event_type = 'click'", "''", day("ts")),
            "IP Address": "'10.0.0.' || " + text_of("user_id"),
            "User Agent": "props",
            "Country": either("value > 30", "'US'"),
            "Challenge Type": either("value > 60", "'CAPTCHA'"),
        }
    ),
    "ads_clicked": _events(
        {
            "Ad clicked Date": either("event_type = 'click'", day("ts")),
            "Ad Title/Id": either("value > 10", text_of("event_id")),
        }
    ),
    "ad_targeting": _events(
        {
            "Member Age": either("value > 30", "'25-34'"),
            "member age": either("value > 60", "'35-44'"),
            "Job Seniority2x": either("event_type = 'error'", "''", "event_type"),
            "Company Names": either("value > 90", "props"),
        }
    ),
    "lan_ads_engagement": _events(
        {
            "Date": either("event_type = 'purchase'", "''", day("ts")),
            "Action": either("event_type = 'view'", "''", "event_type"),
            "Ad Title/Id": either("value > 20", text_of("event_id")),
            "Page/App": either("value > 40", "props"),
        }
    ),
    "inferences_about_you": _events(
        {
            "Category": "event_type",
            "Type of inference": either("value > 20", "'guess'"),
            "Description": either("value > 40", "props"),
            "Inference": either("value > 60", "'yes'", "'no'"),
        }
    ),
    # Payments and services
    "receipts": _customers(
        {
            "Transaction Made At": either("c_acctbal > 0", "'2023-09-09'"),
            "Description": "c_mktsegment",
            "Total Amount": text_of("c_acctbal"),
            "Currency Code": either("c_acctbal > 4000", "'EUR'"),
            "Payment Method Type": "'CARD'",
            "Invoice Number": text_of("c_custkey"),
        }
    ),
    "receipts_v2": _suppliers(
        {
            "Transaction Made At": "'2024-09-09'",
            "Description": either("s_acctbal > 0", "s_name"),
            "Total Amount": text_of("s_acctbal"),
            "Currency Code": "'USD'",
        }
    ),
    "engagements": _documents(
        "source",
        {
            "Creation Time": either(LONG, "'2024-10-10'"),
            "Marketplace Type": either("n_chars < 1000", "lang"),
            "Body": "text",
            "Currency Code": "'EUR'",
            "Currency Amount": text_of("n_chars"),
            "Billing Time Unit": "''",
            "Free Consultation included": either("lang = 'en'", "'true'", "'false'"),
        },
    ),
    "opprtunities": _documents(
        "source",
        {
            "Creation Time": either(LONG, "'2024-11-11'"),
            "Marketplace Type": "lang",
            "Service Category": either("n_chars < 500", "''", "'Service ' || lang"),
            "Location": either("n_chars < 2000", "source"),
            "Questions and Answers": "text",
            "Preferred Providers": "''",
            "Status": either(LONG, "'OPEN'"),
        },
    ),
    # Identity
    "verifications": _customers(
        {
            "First name": either("c_acctbal < 1000", "'N/A'", "c_mktsegment"),
            "Middle name": either("c_mktsegment = 'BUILDING'", "'N/A'"),
            "Last name": either("c_acctbal > 0", "c_name"),
            "Verification type": either("c_acctbal > 3000", "'ID'"),
            "Issuing authority": "'State'",
            "Document type": either("c_acctbal > 5000", "'Passport'"),
            "Verification service provider": either("c_acctbal < 5000", "'Checker'"),
            "Verified date": either("c_acctbal > 2000", "'2024-01-01'"),
            "Expiry date": either("c_acctbal > 7000", "'N/A'", either("c_acctbal > 4000", "'2030-01-01'")),
        }
    ),
    "private_identity_asset": Binding(
        "benchmark",
        "'asset-' || (item_id % 7)",
        "item_id",
        {
            "Private Identity Asset Name": either("item_id % 5 = 0", "''", "'Asset ' || item_id"),
            "Private Identity Asset Raw Text": "text",
        },
    ),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_table(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """A bound table in the raw shape."""
    b = BINDINGS[key]
    cells = {name: F.expr(e) for name, e in b.cells.items()}
    rows = read(spark, sf_dir, b.table)
    bound = as_raw_rows(rows, key, F.expr(b.export), F.expr(b.order), cells)
    if (blanks := b.blank_rows()) is None:
        return bound
    column, which = blanks
    added = rows.filter(which).withColumn(column, F.lit(""))
    order = F.expr(b.order) + F.lit(BLANK_ORDER)
    return bound.unionByName(as_raw_rows(added, key, F.expr(b.export), order, cells))


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which executors share; a local session without
    that setting gets a temporary one, which goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="dossier-checks-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/documents-{uuid.uuid4().hex}"


def raw_tables(spark: SparkSession, sf_dir: str, keys) -> dict[str, DataFrame]:
    return {k: raw_table(spark, sf_dir, k) for k in keys}


def source_sql(key: str, columns: list[str] | None = None) -> str:
    """The same rows for DuckDB: export_id, ord and one column per CSV column."""
    b = BINDINGS[key]
    names = columns if columns is not None else list(b.cells)
    cells = "".join(f", {b.cells.get(n, chr(39) * 2)} AS \"{n}\"" for n in names)
    bound = f"SELECT {b.export} AS export_id, {b.order} AS ord{cells} FROM {b.table}"
    if (blanks := b.blank_rows()) is None:
        return bound
    column, which = blanks
    return (
        f"{bound} UNION ALL SELECT {b.export}, {b.order} + {BLANK_ORDER}{cells} "
        f"FROM (SELECT * REPLACE ('' AS {column}) FROM {b.table} WHERE {which}) added"
    )
