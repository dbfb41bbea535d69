"""SQL fragments for the DuckDB side of the checks, written apart from the Spark code."""

from __future__ import annotations

from dossier_checks.bindings import source_sql

NL = "\n"
# White space, month labels and stop words; results are only right when these match.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  　"
SPACE_CLASS = r"\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MONTHS = "['', 'Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
PLAIN_STOP_WORDS = (
    "'el','la','los','las','un','una','unos','unas','de','del','en','con','por','para','sobre',"
    "'entre','que','como','donde','cuando','quien','es','son','fue','fueron','muy','durante'"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def col(name: str) -> str:
    return f'"{name}"'


def opt(name: str) -> str:
    return f"nullif(\"{name}\", '')"


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACES)})"


def name(first: str, last: str) -> str:
    return strip(f'"{first}" || \' \' || "{last}"')


def matches(x: str) -> str:
    """Accented stop words hold one accented letter each, so two plain counts add up."""
    return (
        f"(len(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: w IN ({PLAIN_STOP_WORDS}))) "
        f"+ len(regexp_extract_all(lower({x}), '[áéíóúñ¿¡]')))"
    )


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE_CLASS}]+'))"


def lang(x: str) -> str:
    return (
        f"CASE WHEN {x} <> '' AND {matches(x)} * 1.0 / nullif({words(x)}, 0) > 0.1 "
        f"THEN 'es' ELSE 'en' END"
    )


def texts(field: str, x: str) -> dict[str, str]:
    return {
        f"{field}_en": f"CASE WHEN {x} <> '' AND {lang(x)} = 'en' THEN {x} END",
        f"{field}_es": f"CASE WHEN {x} <> '' AND {lang(x)} = 'es' THEN {x} END",
    }


def month(x: str) -> str:
    number = f"TRY_CAST({x} AS INTEGER)"
    return (
        f"CASE WHEN regexp_full_match({x}, '[0-9]+') AND {number} BETWEEN 0 AND 12 "
        f"THEN {MONTHS}[{number} + 1] END"
    )


def date(x: str) -> str:
    token_count = f"len(regexp_extract_all({x}, '[^{SPACE_CLASS}]+'))"
    year = f"split_part({x}, '-', 1)"
    return (
        f"CASE WHEN {x} = '' THEN '' WHEN contains({x}, ' ') AND {token_count} = 2 THEN {x} "
        f"WHEN contains({x}, '-') THEN coalesce({month(f"split_part({x}, '-', 2)")} || ' ' || {year}, {year}) "
        f"ELSE {x} END"
    )


def us_date(x: str) -> str:
    d = f"split_part({x}, ',', 1)"
    y = f"split_part({d}, '/', 3)"
    century = (
        f"CASE WHEN TRY_CAST({y} AS INTEGER) < 50 THEN '20' WHEN TRY_CAST({y} AS INTEGER) >= 50 THEN '19' END"
    )
    return (
        f"CASE WHEN {x} <> '' THEN coalesce(CASE WHEN len(string_split({d}, '/')) = 3 THEN "
        f"{month(f"split_part({d}, '/', 1)")} || ' ' || {century} || {y} END, {d}) END"
    )


def utc_date(x: str) -> str:
    d = f"split_part({x}, ' ', 1)"
    return (
        f"CASE WHEN len(string_split({d}, '/')) = 3 THEN "
        f"{month(f"split_part({d}, '/', 2)")} || ' ' || split_part({d}, '/', 1) END"
    )


def parts(x: str, pattern: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({x}, '{pattern}'), "
        f"lambda v: {strip('v')}), lambda v: v <> '')"
    )


def pipe_list(x: str) -> str:
    return parts(x, "\\|")


def joined(x: str, separator: str = "|") -> str:
    return f"array_to_string({x}, '{separator}')"


def bullets(x: str) -> str:
    pattern = f"[•\\-*][{SPACE_CLASS}]*|\\n+|\\p{{Nd}}+\\.[{SPACE_CLASS}]*"
    return (
        f"list_filter(list_transform(string_split_regex({x}, '{pattern}'), "
        f"lambda v: {strip('v')}), lambda v: length(v) >= 10)"
    )


def shown(x: str) -> str:
    return f"coalesce({x}, '')"


def rows(table: str, fields: dict[str, str], where: str = "TRUE") -> str:
    """Section rows: one bound table, projected and filtered."""
    chosen = "".join(f", {e} AS \"{f}\"" for f, e in fields.items())
    return f"SELECT export_id, ord{chosen} FROM ({source_sql(table)}) WHERE {where}"


def split_rows(tables: list[str], columns: list[str], fields: dict[str, str], where: str) -> str:
    """Section rows of several files in list order."""
    union = " UNION ALL ".join(
        f"SELECT export_id, ord + {i << 48} AS ord, {', '.join(col(c) for c in columns)} "
        f"FROM ({source_sql(t, columns)})"
        for i, t in enumerate(tables)
    )
    chosen = "".join(f", {e} AS \"{f}\"" for f, e in fields.items())
    return f"SELECT export_id, ord{chosen} FROM ({union}) WHERE {where}"


def first(table_sql: str, fields: dict[str, str]) -> str:
    """Per export the row with the smallest ord, then projected."""
    chosen = "".join(f", {e} AS \"{f}\"" for f, e in fields.items())
    return (
        f"SELECT export_id, ord{chosen} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY export_id ORDER BY ord) AS rn FROM ({table_sql})) WHERE rn = 1"
    )


def document(
    section: str,
    header: str,
    line: str,
    separator: str = NL,
    footer: str = "",
    lang_code: str = "en",
) -> str:
    return (
        f"SELECT export_id, '{lang_code}' AS lang, {lit(header)} || string_agg({line}, "
        f"{lit(separator)} ORDER BY ord) || {lit(footer)} AS content FROM ({section}) GROUP BY export_id"
    )


def table_line(*cells: str) -> str:
    inner = " || ' | ' || ".join(f"({c})" for c in cells)
    return f"'| ' || {inner} || ' |'"


def block(*lines: str) -> str:
    """Null lines are left out; the block ends with a line break."""
    return f"concat_ws({lit(NL)}, {', '.join(lines)}) || {lit(NL)}"


def when(x: str, line: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN {line} END"


def spoken(field: str, code: str) -> str:
    codes = dict.fromkeys([code, "en", "es"])
    return f"coalesce({', '.join(f'nullif({field}_{c}, {chr(39) * 2})' for c in codes)}, '')"


def link(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN '[View](' || {x} || ')' ELSE '' END"
