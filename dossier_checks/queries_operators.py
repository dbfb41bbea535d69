"""Operator checks: one Spark query and one SQL statement per operator on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_checks import sql_parts as q
from dossier_checks.archives import DAMAGED_EVERY, document_archives
from dossier_checks.bindings import (
    BINDINGS,
    PARTIAL_DATE,
    US_DATE,
    day,
    new_folder,
    raw_tables,
    read,
    us_time,
    utc_time,
)
from dossier_checks.sql_sections import DOCUMENT_SQL
from dossier import DOCUMENTS, documents, manifest
from dossier.functions import dates, language
from dossier.functions import text as tx
from dossier.operators.assemble import assemble
from dossier.operators.merge import merge_bilingual
from dossier.operators.numbering import number_rows
from dossier.operators.records import open_record
from dossier.operators.select_first import (
    count_rows,
    first_per_key,
    first_row,
    keep_last_entry,
    preferred_else_first,
)
from dossier.operators.sources import union_sources
from dossier.operators.translations import dedup_translations
from dossier.plans.layouts import table_header
from dossier.plans.profile import profile_text
from dossier.plans.section import Style
from dossier.sources.archives import raw_rows, row_issues
from dossier.sources.raw import get_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(sql: str):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


def projection(name: str, table: str, key: str, columns: dict[str, tuple[Column | Callable[[], Column], str]]):
    """A row-wise check: Spark Columns against SQL expressions over one whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(key, *[make().alias(n) for n, (make, _) in columns.items()])

    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {', '.join(f'{sql} AS {n}' for n, (_, sql) in columns.items())} FROM {table}"


TEXT = lambda: F.col("text")

# --- language and text -----------------------------------------------------------------------


@check(
    f"SELECT doc_id, {q.matches('text')} AS matches, {q.words('text')} AS words, {q.lang('text')} AS detected FROM documents"
)
def detect_language(spark, sf_dir):
    """Counts are a step of their own, so both serve the output and the decision."""
    counts = read(spark, sf_dir, "documents").select(
        "doc_id",
        language.spanish_matches(TEXT()).cast("long").alias("matches"),
        tx.word_count(TEXT()).cast("long").alias("words"),
    )
    return counts.withColumn("detected", language.language_of_counts(F.col("matches"), F.col("words")))


projection(
    "text_fallback",
    "documents",
    "doc_id",
    {
        "in_es": (
            lambda: language.get_text(language.create_text(TEXT(), language.detect_language(TEXT())), "es"),
            "text",
        ),
        "in_declared": (
            lambda: language.get_text(language.create_text(TEXT(), F.col("lang")), "es"),
            "CASE WHEN lang IN ('en', 'es') THEN text ELSE '' END",
        ),
        "languages": (
            lambda: F.array_join(language.languages_of(language.create_text(TEXT(), F.col("lang"))), ","),
            "CASE WHEN text <> '' THEN lang ELSE '' END",
        ),
    },
)
projection(
    "merge_texts",
    "documents",
    "doc_id",
    {
        "en": (
            lambda: language.merge_texts(
                language.create_text(TEXT(), F.col("lang")),
                language.create_text(F.col("source"), F.lit("en")),
            )["en"],
            "CASE WHEN lang = 'en' AND text <> '' THEN text ELSE source END",
        ),
        "es": (
            lambda: language.merge_texts(
                language.create_text(TEXT(), F.col("lang")),
                language.create_text(F.col("source"), F.lit("en")),
            )["es"],
            "CASE WHEN lang = 'es' THEN nullif(text, '') END",
        ),
    },
)
projection(
    "split_bullets",
    "documents",
    "doc_id",
    {
        "n": (lambda: F.size(tx.split_bullets(TEXT())).cast("long"), f"len({q.bullets('text')})"),
        "bullets": (lambda: F.array_join(tx.split_bullets(TEXT()), "\n"), f"array_to_string({q.bullets('text')}, chr(10))"),
    },
)
projection(
    "truncate_text",
    "conversations",
    "conv_id",
    {
        "turn": (lambda: F.col("turn"), "turn"),
        "shown": (
            lambda: tx.truncate(TEXT()),
            "CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END",
        ),
        "quoted": (lambda: tx.blockquote(TEXT()), "'> ' || text"),
    },
)
projection(
    "escape_pipe",
    "documents",
    "doc_id",
    {"escaped": (lambda: tx.escape_pipe(TEXT()), "replace(text, '|', '\\|')")},
)
URL_CASES = (
    "CASE WHEN length(html) < 1500 THEN 'javascript:' || url WHEN length(html) < 2500 THEN ' ' || url || '(1)[2] ' "
    "WHEN length(html) < 3500 THEN '' WHEN length(html) < 4500 THEN 'mailto:' || url ELSE url END"
)
projection(
    "sanitize_url",
    "pages",
    "page_id",
    {
        "safe": (
            lambda: tx.sanitize_url(F.expr(URL_CASES)),
            f"CASE WHEN regexp_matches(trim({URL_CASES}), '^(http://|https://|mailto:)') THEN "
            f"replace(replace(replace(trim({URL_CASES}), ')', '%29'), '[', '%5B'), ']', '%5D') ELSE '' END",
        ),
        "cell": (
            lambda: tx.link_cell(F.expr(URL_CASES)),
            f"CASE WHEN {URL_CASES} <> '' THEN '[View](' || {URL_CASES} || ')' ELSE '' END",
        ),
    },
)
LISTED = "p_name || ' | ' || p_type || '||' || p_brand || ';' || ' ,' || p_name || '(' || p_type || ' )'"
BRACKETED = "CASE WHEN p_size < 10 THEN '[]' WHEN p_size < 30 THEN '[[' || p_name || ']' ELSE p_name || '[x]y' END"
projection(
    "split_lists",
    "part",
    "p_partkey",
    {
        "piped": (lambda: F.array_join(tx.split_pipe_list(F.expr(LISTED)), "/"), q.joined(q.pipe_list(LISTED), "/")),
        "sites": (lambda: F.array_join(tx.split_websites(F.expr(LISTED)), "/"), q.joined(q.parts(LISTED, "[,;]"), "/")),
        "inner_text": (
            lambda: tx.paren_extract(F.expr(LISTED)),
            q.strip(f"regexp_extract({LISTED}, '\\(([^)]+)\\)', 1)"),
        ),
        "outer_text": (lambda: tx.before_paren(F.expr(LISTED)), q.strip(f"split_part({LISTED}, '(', 1)")),
        "unbracketed": (lambda: tx.strip_brackets(F.expr(BRACKETED)), f"nullif(trim({BRACKETED}, '[]'), '')"),
    },
)
BLANKABLE = "CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 1000 THEN ' ' ELSE c_mktsegment END"
projection(
    "blank_to_null",
    "customer",
    "c_custkey",
    {
        "value": (lambda: tx.blank_to_null(F.expr(BLANKABLE)), f"nullif({BLANKABLE}, '')"),
        "present": (lambda: tx.is_present(F.expr(BLANKABLE)), f"{BLANKABLE} <> ''"),
        "either_one": (
            lambda: tx.first_nonblank(F.expr(BLANKABLE), F.col("c_name")),
            f"CASE WHEN {BLANKABLE} <> '' THEN {BLANKABLE} ELSE c_name END",
        ),
    },
)
projection(
    "build_names",
    "customer",
    "c_custkey",
    {
        "full_name": (
            lambda: tx.full_name(F.expr(BLANKABLE), F.col("c_name")),
            f"trim({BLANKABLE} || ' ' || c_name)",
        ),
        "joined": (
            lambda: tx.join_nonblank(F.col("c_name"), F.expr(BLANKABLE), F.lit("")),
            f"concat_ws(' ', c_name, nullif({BLANKABLE}, ''))",
        ),
    },
)
projection(
    "flag_equals",
    "events",
    "event_id",
    {
        "is_click": (lambda: tx.flag_equals(F.upper("event_type"), "click"), "event_type = 'click'"),
        "status": (
            lambda: tx.completion_status(F.expr("CASE WHEN value > 50 THEN props ELSE '' END")),
            "CASE WHEN value > 50 THEN 'Completed' ELSE 'In Progress' END",
        ),
        "known": (
            lambda: tx.skip_na(F.expr("CASE WHEN value > 50 THEN event_type WHEN value > 20 THEN 'N/A' ELSE '' END")),
            "CASE WHEN value > 50 THEN event_type END",
        ),
    },
)
projection(
    "lookup_default",
    "customer",
    "c_custkey",
    {
        "segment": (
            lambda: tx.lookup(
                F.col("c_mktsegment"), {"BUILDING": "Construction", "MACHINERY": "Machines"}, F.col("c_mktsegment")
            ),
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END",
        )
    },
)
projection(
    "table_key",
    "pages",
    "page_id",
    {
        "key": (
            lambda: tx.table_key(F.concat(F.replace("url", F.lit("-"), F.lit(" ")), F.lit(".csv"))),
            "replace(lower(regexp_replace(regexp_replace(replace(url, '-', ' ') || '.csv', '^.*/', ''), '(.)\\.csv$', '\\1')), ' ', '_')",
        ),
        "header_key": (lambda: tx.normalise_key(F.col("url")), "replace(lower(url), ' ', '_')"),
        "safe": (
            lambda: tx.is_safe_file_name(F.col("url")),
            "NOT (contains(url, '..') OR starts_with(url, '/') OR starts_with(url, '\\'))",
        ),
        "file_name": (lambda: tx.markdown_file_name(F.col("url")), "CASE WHEN url LIKE '%.md' THEN url ELSE url || '.md' END"),
    },
)
NOTED = "CASE WHEN n_chars < 2000 THEN 'Notes:' || chr(10) || '\"a, b\"' || chr(10) || text ELSE text END"
projection(
    "notes_preamble",
    "documents",
    "doc_id",
    {
        "content": (
            lambda: tx.skip_header_notes(F.expr(NOTED)),
            f"""(SELECT CASE WHEN starts_with(x.c, 'Notes') AND hit IS NOT NULL
                 THEN array_to_string(lines[hit:], chr(10)) ELSE x.c END
               FROM (SELECT y.c, lines, list_position(list_transform(lines, lambda l:
                       contains(l, ',') AND NOT starts_with({q.strip('l')}, '"')), TRUE) AS hit
                     FROM (SELECT {NOTED} AS c, string_split({NOTED}, chr(10)) AS lines) y) x)""",
        )
    },
)
TITLE_KEY = "p_type || '_' || p_name || '2x_' || lower(p_brand)"
projection(
    "title_key",
    "part",
    "p_partkey",
    {
        "title": (
            lambda: tx.title_case_key(F.expr(TITLE_KEY)),
            f"""array_to_string(list_transform(regexp_extract_all(replace({TITLE_KEY}, '_', ' '), '\\p{{L}}+|\\P{{L}}+'),
                lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')""",
        )
    },
)

# --- dates -----------------------------------------------------------------------------------

projection(
    "format_date",
    "documents",
    "doc_id",
    {"shown": (lambda: dates.format_date(F.expr(PARTIAL_DATE)), q.date(f"({PARTIAL_DATE})"))},
)
projection(
    "order_month",
    "orders",
    "o_orderkey",
    {
        "month": (lambda: dates.format_date(F.expr(day("o_orderdate"))), q.date(f"({day('o_orderdate')})")),
        "year": (lambda: dates.year_of(F.expr(day("o_orderdate"))), "CAST(year(o_orderdate) AS STRING)"),
        "end_year": (
            lambda: dates.end_year_of(F.expr(f"CASE WHEN o_orderstatus = 'F' THEN {day('o_orderdate')} ELSE '' END")),
            "CASE WHEN o_orderstatus = 'F' THEN CAST(year(o_orderdate) AS STRING) END",
        ),
    },
)
projection(
    "us_datetime",
    "orders",
    "o_orderkey",
    {
        "month": (
            lambda: dates.parse_us_datetime(F.expr(us_time("o_orderdate"))),
            "strftime(o_orderdate, '%b %Y')",
        )
    },
)
projection(
    "us_datetime_forms",
    "documents",
    "doc_id",
    {"shown": (lambda: dates.parse_us_datetime(F.expr(US_DATE)), q.us_date(f"({US_DATE})"))},
)
projection(
    "utc_date",
    "events",
    "event_id",
    {
        "month": (
            lambda: dates.parse_utc_date(
                F.expr(f"CASE WHEN value > 20 THEN {utc_time('ts')} ELSE {day('ts')} END")
            ),
            "CASE WHEN value > 20 THEN strftime(ts, '%b %Y') END",
        )
    },
)
START = "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END"
END = "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END"
projection(
    "date_range",
    "orders",
    "o_orderkey",
    {
        "open_range": (
            lambda: dates.open_range(F.expr(START), F.expr(END)),
            f"concat_ws(' - ', nullif({START}, ''), coalesce({END}, 'Present'))",
        ),
        "started_range": (
            lambda: dates.started_range(F.expr(START), F.expr(END)),
            f"CASE WHEN {START} <> '' THEN concat_ws(' - ', {START}, {END}) END",
        ),
        "closed_range": (
            lambda: dates.closed_range(F.expr(START), F.expr(END)),
            f"nullif(concat_ws(' - ', nullif({START}, ''), {END}), '')",
        ),
    },
)

# --- filters and sources -----------------------------------------------------------------------


@check("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def status_filter(spark, sf_dir):
    return (
        read(spark, sf_dir, "lineitem")
        .filter((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
        .select("l_orderkey", "l_linenumber", "l_quantity")
    )


@check(f"SELECT c_custkey FROM customer WHERE {BLANKABLE} <> '' OR c_acctbal < -500")
def require_any(spark, sf_dir):
    present = tx.is_present(F.expr(BLANKABLE)) | (F.col("c_acctbal") < -500)
    return read(spark, sf_dir, "customer").filter(present).select("c_custkey")


@check("SELECT lang, detected, count(*) AS n FROM (SELECT lang, " + q.lang("text") + " AS detected FROM documents) GROUP BY 1, 2")
def language_confusion(spark, sf_dir):
    return (
        read(spark, sf_dir, "documents")
        .groupBy("lang", language.detect_language(TEXT()).alias("detected"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@check(
    f"SELECT s_name AS name, s_suppkey AS key, s_suppkey AS ord FROM supplier UNION ALL "
    f"SELECT c_name, c_custkey, c_custkey + {1 << 48} FROM customer"
)
def union_files(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))
    return union_sources([suppliers, customers], "key")


@check(
    "SELECT 'nation-' || CAST(c_nationkey AS STRING) AS export_id, c_custkey AS ord, c_mktsegment AS description FROM customer"
)
def get_raw_table(spark, sf_dir):
    raw = raw_tables(spark, sf_dir, ["receipts", "receipts_v2"])
    both = raw["receipts"].unionByName(raw["receipts_v2"])
    return get_table(both, ["receipts"]).select("export_id", "ord", F.col("cells")["Description"].alias("description"))


# --- aggregates ------------------------------------------------------------------------------


@check(
    "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"
)
def first_order(spark, sf_dir):
    return first_row(
        read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_totalprice"]
    )


@check(
    "SELECT o_custkey, arg_min(o_totalprice, CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE o_orderkey + 1000000000000 END) AS price "
    "FROM orders GROUP BY o_custkey"
)
def primary_else_first(spark, sf_dir):
    return preferred_else_first(
        read(spark, sf_dir, "orders"),
        ["o_custkey"],
        "o_orderkey",
        F.col("o_orderstatus") == "O",
        F.col("o_totalprice"),
        "price",
    )


@check("SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1")
def count_per_nation(spark, sf_dir):
    return count_rows(read(spark, sf_dir, "customer"), ["c_nationkey"], "n_customers")


@check(
    "SELECT p_brand, p_partkey, p_name, p_size FROM part "
    "QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) = 1"
)
def dedup_first(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    return first_per_key(parts, ["p_brand"], F.lower("p_name"), "p_partkey")


@check(
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"
)
def last_entry(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return keep_last_entry(orders, ["o_custkey"], "o_orderkey")


TRANSLATED = (
    "CASE WHEN p_type = 'ECONOMY' THEN p_type || ' (' || p_name || ')' WHEN p_type = 'PROMO' THEN upper(p_name) ELSE p_name END"
)


@check(
    f"""WITH kept AS (
          SELECT p_size, p_partkey, {TRANSLATED} AS full_name, p_type = 'ECONOMY' AS paired, p_name FROM part
          QUALIFY row_number() OVER (PARTITION BY p_size, lower({TRANSLATED}) ORDER BY p_partkey) = 1)
        SELECT k.p_size, k.p_partkey, CASE WHEN paired THEN p_name ELSE full_name END AS name FROM kept k
        WHERE NOT paired OR NOT EXISTS (SELECT 1 FROM kept o WHERE NOT o.paired AND o.p_size = k.p_size
          AND lower(o.full_name) = lower(k.p_name) AND o.p_partkey < k.p_partkey)"""
)
def dedup_translated_names(spark, sf_dir):
    return dedup_translations(read(spark, sf_dir, "part"), ["p_size"], "p_partkey", F.expr(TRANSLATED))


@check(
    f"""SELECT source, min(doc_id) AS ord, first(n_chars ORDER BY doc_id) AS n_chars,
          arg_min(text, doc_id) FILTER (WHERE code = 'en' AND text <> '') AS text_en,
          arg_min(text, doc_id) FILTER (WHERE code = 'es' AND text <> '') AS text_es
        FROM (SELECT *, {q.lang('text')} AS code FROM documents) GROUP BY source"""
)
def bilingual_merge(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "source",
        F.col("doc_id").alias("ord"),
        "n_chars",
        language.create_text(TEXT(), language.detect_language(TEXT())).alias("text"),
    )
    merged = merge_bilingual(docs, ["source"], "ord", ["text"])
    return merged.select(
        "source", "ord", "n_chars", F.col("text")["en"].alias("text_en"), F.col("text")["es"].alias("text_es")
    )


@check(
    f"""WITH b AS (SELECT source, doc_id, {q.lang('text')} AS code, {q.bullets('text')} AS list FROM documents),
        u AS (SELECT source, doc_id, code, unnest(list) AS bullet, generate_subscripts(list, 1) - 1 AS pos FROM b)
        SELECT source, CAST(pos AS BIGINT) AS pos, arg_min(bullet, doc_id) FILTER (WHERE code = 'en') AS en,
               arg_min(bullet, doc_id) FILTER (WHERE code = 'es') AS es
        FROM u GROUP BY source, pos"""
)
def bullet_merge(spark, sf_dir):
    bullets = language.create_texts(
        tx.split_bullets(TEXT()), language.detect_language(TEXT()), ["en", "es"]
    )
    docs = read(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("ord"), bullets.alias("bullets")
    )
    merged = merge_bilingual(docs, ["source"], "ord", [], bullets="bullets")
    return merged.select("source", F.posexplode("bullets").alias("pos", "bullet")).select(
        "source",
        F.col("pos").cast("long").alias("pos"),
        F.col("bullet.text")["en"].alias("en"),
        F.col("bullet.text")["es"].alias("es"),
    )


@check("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS number FROM conversations")
def enumerate_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return number_rows(turns, ["conv_id"], "turn", "number")


@check(
    "SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS number FROM orders"
)
def enumerate_large_groups(spark, sf_dir):
    """Three groups hold all rows; each is numbered in spans."""
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return number_rows(orders, ["o_orderstatus"], "o_orderkey", "number", span_bits=10)


@check(
    """SELECT p_partkey, concat_ws(chr(10), 'part_name=' || p_name, 'size=' || coalesce(CASE WHEN p_size > 25 THEN p_brand END, CAST(p_size AS STRING)),
          CASE WHEN p_type <> 'PROMO' THEN 'type=' || p_type END) AS record FROM part"""
)
def open_records(spark, sf_dir):
    header = F.array(F.lit("Part Name"), F.lit("Size"), F.lit("Type"), F.lit("SIZE"))
    cells = F.create_map(
        F.lit("Part Name"), F.col("p_name"),
        F.lit("Size"), F.col("p_size").cast("string"),
        F.lit("Type"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise(""),
        F.lit("SIZE"), F.when(F.col("p_size") > 25, F.col("p_brand")),
    )
    pairs = F.transform(open_record(header, cells), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(pairs, "\n").alias("record"))


# --- documents -------------------------------------------------------------------------------


@check(
    f"""SELECT n_regionkey, {q.lit(table_header("Nations", ["Key", "Name"]))} ||
          string_agg('| ' || CAST(n_nationkey AS STRING) || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS content
        FROM nation GROUP BY n_regionkey"""
)
def table_document(spark, sf_dir):
    lines = read(spark, sf_dir, "nation").select(
        "n_regionkey",
        F.col("n_nationkey").alias("ord"),
        F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |")).alias("text"),
    )
    docs = assemble(lines, ["n_regionkey"], header=table_header("Nations", ["Key", "Name"]), footer="\n")
    return docs.select("n_regionkey", "content")


@check(
    """SELECT s_nationkey, '# Suppliers' || chr(10) || chr(10) || string_agg('- ' || s_name, chr(10) ORDER BY s_suppkey) || chr(10) AS content
       FROM supplier GROUP BY s_nationkey"""
)
def list_document(spark, sf_dir):
    lines = read(spark, sf_dir, "supplier").select(
        "s_nationkey", F.col("s_suppkey").alias("ord"), F.concat(F.lit("- "), "s_name").alias("text")
    )
    docs = assemble(lines, ["s_nationkey"], header="# Suppliers\n\n", footer="\n")
    return docs.select("s_nationkey", "content")


PART_BYTES = 4096


@check(
    f"""WITH line AS (SELECT o_orderstatus, o_orderkey, chr(10) || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority AS t FROM orders),
        run AS (SELECT *, sum(strlen(t)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - strlen(t) AS before,
                       sum(strlen(t)) OVER d AS total, max(strlen(t)) OVER d AS longest, max(o_orderkey) OVER d AS last
                FROM line WINDOW d AS (PARTITION BY o_orderstatus)),
        placed AS (SELECT *, CASE WHEN total > {PART_BYTES}
                     THEN before // ({PART_BYTES} - least(longest, {PART_BYTES} // 2)) ELSE 0 END AS part_no FROM run)
        SELECT o_orderstatus, CAST(part_no AS BIGINT) AS part_no,
          CASE WHEN part_no = 0 THEN '# Orders' || substr(string_agg(t, '' ORDER BY o_orderkey), 2)
               ELSE string_agg(t, '' ORDER BY o_orderkey) END
          || CASE WHEN max(o_orderkey) = any_value(last) THEN '!' ELSE '' END AS content
        FROM placed GROUP BY o_orderstatus, part_no"""
)
def document_parts(spark, sf_dir):
    """Three documents hold all orders; each is cut into parts of a bounded size."""
    lines = read(spark, sf_dir, "orders").select(
        "o_orderstatus",
        F.col("o_orderkey").alias("ord"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("text"),
    )
    docs = assemble(lines, ["o_orderstatus"], header="# Orders", footer="!", part_bytes=PART_BYTES)
    return docs.select("o_orderstatus", "part_no", "content")


@check(
    """SELECT c_custkey, concat_ws(chr(10), '# ' || c_name || chr(10),
          CASE WHEN o_orderpriority IS NOT NULL THEN '**' || o_orderpriority || '**' || chr(10) END,
          n_name || ' | ' || r_name || ' | ' || c_mktsegment || chr(10),
          CASE WHEN o_orderstatus IS NOT NULL THEN '## Summary' || chr(10) || chr(10) || o_orderstatus || chr(10) END) AS content
       FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
       LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o
         ON o.o_custkey = c_custkey"""
)
def profile_assembly(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    first = first_row(
        read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_orderpriority"]
    )
    rows = (
        read(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            "c_custkey",
            F.col("c_name").alias("name"),
            language.create_text(F.col("o_orderpriority"), F.lit("en")).alias("title"),
            F.col("n_name").alias("location"),
            F.col("r_name").alias("email"),
            F.col("c_mktsegment").alias("phone"),
            language.create_text(F.col("o_orderstatus"), F.lit("en")).alias("summary"),
        )
    )
    return rows.select("c_custkey", profile_text(Style(), "en").alias("content"))


@check(
    """SELECT source, count(DISTINCT lang) AS n_files, array_to_string(list_sort(list(DISTINCT lang || '.md')), ',') AS files
       FROM documents GROUP BY source"""
)
def manifest_of_documents(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(
        "source", "lang", F.col("doc_id").alias("ord"), TEXT().alias("text")
    )
    docs = assemble(lines, ["source", "lang"]).withColumn("file_name", tx.markdown_file_name(F.col("lang")))
    listed = manifest(docs, ["source"])
    return listed.select("source", "n_files", F.array_join("files", ",").alias("files"))


def _english_documents() -> str:
    return " UNION ALL ".join(
        f"SELECT export_id, '{d.section}' AS section, {i} AS section_rank, content FROM ({DOCUMENT_SQL[d.section]}) WHERE lang = 'en'"
        for i, d in enumerate(DOCUMENTS)
    )


@check(_english_documents())
def all_documents(spark, sf_dir):
    """Every document of the catalog over every bound table, in one plan."""
    docs = documents(raw_tables(spark, sf_dir, BINDINGS), lines_path=f"{new_folder(spark)}/lines")
    return docs.select("export_id", "section", "section_rank", "content")


# --- archives --------------------------------------------------------------------------------

LINES = f"""
  SELECT CAST(doc_id AS STRING) AS export_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no
  FROM documents"""


@check(
    f"""SELECT export_id, CAST(row_no AS BIGINT) AS row_no, 'text_lines' AS table_key, 2 AS entry_idx,
          p[1] AS first_cell, p[2] AS second_cell, p[3] AS third_cell,
          CASE WHEN len(p) > 3 THEN array_to_string(p[4:], '.') END AS overflow
        FROM (SELECT *, string_split(line, '.') AS p FROM ({LINES}))"""
)
def archive_rows(spark, sf_dir):
    """Every document as an archive with a preamble and a shadowed entry, read back as rows."""
    rows = raw_rows(document_archives(spark, sf_dir)).filter(F.col("row_no") >= 0)
    cells = F.col("cells")
    return rows.select(
        "export_id",
        "row_no",
        "table_key",
        "entry_idx",
        cells["First"].alias("first_cell"),
        cells["Second"].alias("second_cell"),
        cells["Third"].alias("third_cell"),
        F.array_join("overflow", ".").alias("overflow"),
    )


@check(
    f"""SELECT 'damaged-' || doc_id AS export_id, 'archive' AS stage, NULL AS section, CAST(NULL AS BIGINT) AS row_no,
          'invalid or corrupted archive: File is not a zip file' AS message FROM documents WHERE doc_id % {DAMAGED_EVERY} = 0
        UNION ALL
        SELECT export_id, 'row', 'text_lines', row_no, CASE WHEN n < 3 THEN 'short row' ELSE 'extra cells' END
        FROM (SELECT *, len(string_split(line, '.')) AS n FROM ({LINES})) WHERE n <> 3"""
)
def archive_issues(spark, sf_dir):
    """Damaged archives and defective rows of the same archives."""
    return row_issues(raw_rows(document_archives(spark, sf_dir)))
