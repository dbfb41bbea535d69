"""String functions. Every function takes and returns a Column; none needs Python at run time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.fixed import (
    MAX_MESSAGE_LENGTH,
    MIN_BULLET_LENGTH,
    SAFE_LINK_PREFIXES,
    WHITESPACE,
)

# The whitespace set as a Java character-class body (ranges match much faster than a listing).
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The lookahead skips most positions with one class test.
BULLET_PATTERN = rf"(?=[•\-*\n\p{{Nd}}])(?:[•\-*][{WS}]*|\n+|\p{{Nd}}+\.[{WS}]*)"
PAREN_PATTERN = r"\(([^)]+)\)"

_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def strip(c: Column) -> Column:
    """Drop whitespace of any kind at both ends (``trim`` alone only drops U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    """Exactly the empty string becomes null; whitespace-only text is kept."""
    return F.nullif(c, F.lit(""))


def is_present(c: Column) -> Column:
    return text_or_blank(c) != ""


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat(text_or_blank(first), F.lit(" "), text_or_blank(last)))


def join_nonblank(*parts: Column, separator: str = " ") -> Column:
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def first_nonblank(*options: Column) -> Column:
    return F.coalesce(*[blank_to_null(o) for o in options], F.lit(""))


def flag_equals(c: Column, word: str) -> Column:
    return F.lower(text_or_blank(c)) == word


def normalise_key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def lookup(c: Column, table: Mapping[str, str], default: Column) -> Column:
    """Value of a small fixed table, or ``default`` where the key is not in it."""
    pairs = [F.lit(v) for pair in table.items() for v in pair]
    return F.coalesce(F.create_map(*pairs)[c], default)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.array_remove(F.split(c, r"(?U)[\s\x1c-\x1f]+"), ""))


def split_bullets(c: Column) -> Column:
    """Bullet texts of a description, in order; fragments below the minimum length are dropped."""
    parts = F.transform(F.split(text_or_blank(c), BULLET_PATTERN), strip)
    return F.filter(parts, lambda p: F.length(p) >= MIN_BULLET_LENGTH)


def split_list(c: Column, pattern: str) -> Column:
    parts = F.transform(F.split(text_or_blank(c), pattern), strip)
    return F.filter(parts, lambda p: p != "")


def split_pipe_list(c: Column) -> Column:
    return split_list(c, r"\|")


def split_websites(c: Column) -> Column:
    return split_list(c, "[,;]")


def strip_brackets(c: Column) -> Column:
    return blank_to_null(F.btrim(text_or_blank(c), F.lit("[]")))


def has_paren(c: Column) -> Column:
    return c.rlike(PAREN_PATTERN)


def paren_extract(c: Column) -> Column:
    """Stripped text of the first non-empty parenthesis; blank when there is none."""
    return strip(F.regexp_extract(c, PAREN_PATTERN, 1))


def before_paren(c: Column) -> Column:
    return strip(F.substring_index(c, "(", 1))


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def sanitize_url(c: Column) -> Column:
    """Blank unless the link has a safe prefix; characters that break Markdown links are encoded."""
    url = strip(text_or_blank(c))
    safe = F.lit(False)
    for prefix in SAFE_LINK_PREFIXES:
        safe = safe | url.startswith(prefix)
    encoded = url
    for character, code in ((")", "%29"), ("[", "%5B"), ("]", "%5D")):
        encoded = F.replace(encoded, F.lit(character), F.lit(code))
    return F.when(safe, encoded).otherwise("")


def truncate(c: Column, limit: int = MAX_MESSAGE_LENGTH) -> Column:
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))
    ).otherwise(c)


def title_case_key(c: Column) -> Column:
    """``seniority_2x`` -> ``Seniority 2X``: upper case after every character that has no case."""
    words = F.split(
        F.replace(c, F.lit("_"), F.lit(" ")), f"(?<!{_CASED})(?={_CASED})"
    )
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(
                F.upper(F.substring(w, 1, 1)),
                F.lower(F.substring(w, 2, 2**31 - 1)),
            ),
        ),
        "",
    )


def completion_status(completed_at: Column) -> Column:
    return F.when(is_present(completed_at), "Completed").otherwise("In Progress")


def link_cell(url: Column, label: str = "View") -> Column:
    return F.when(
        is_present(url), F.concat(F.lit(f"[{label}]("), url, F.lit(")"))
    ).otherwise("")


def skip_na(c: Column) -> Column:
    """Null where the value is blank or the literal ``N/A``."""
    return F.when(is_present(c) & (c != "N/A"), c)


def blockquote(c: Column) -> Column:
    return F.concat(F.lit("> "), c)


def table_key(entry_name: Column) -> Column:
    """Key of a CSV entry: directory and suffix dropped, lower case, spaces to underscores."""
    base = F.substring_index(entry_name, "/", -1)
    return normalise_key(F.regexp_replace(base, r"(?<=.)\.csv$", ""))


def skip_header_notes(content: Column) -> Column:
    """Drop a ``Notes`` preamble in front of the first line that looks like a CSV header."""
    lines = F.split(content, "\n")
    headers = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), strip(line).alias("line"))),
        lambda x: x["line"].contains(",") & ~x["line"].startswith('"'),
    )
    start = F.get(headers, F.lit(0))["i"]
    has_notes = strip(F.substring_index(content, "\n", 1)).startswith("Notes")
    return F.when(
        has_notes & start.isNotNull(),
        F.array_join(F.slice(lines, start + 1, F.size(lines)), "\n"),
    ).otherwise(content)


def is_safe_file_name(c: Column) -> Column:
    return ~(c.contains("..") | c.startswith("/") | c.startswith("\\"))


def markdown_file_name(c: Column) -> Column:
    return F.when(c.endswith(".md"), c).otherwise(F.concat(c, F.lit(".md")))
