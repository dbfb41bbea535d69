"""Language detection and multilingual text (``MAP<language, text>``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.fixed import (
    OUTPUT_LANGUAGES,
    SPANISH_CHARACTERS,
    SPANISH_SHARE,
    SPANISH_WORDS,
)
from dossier.functions.text import is_present, word_count

# A stop word with an accent holds exactly one counted character, so it is counted by that.
PLAIN_SPANISH_WORDS = tuple(w for w in SPANISH_WORDS if not set(w) & set(SPANISH_CHARACTERS))
SPANISH_CHARACTER_CLASS = f"[{SPANISH_CHARACTERS}{SPANISH_CHARACTERS.upper()}]"
NOT_IN_WORD = r"[^\p{L}\p{N}_]+"

# Letters outside ASCII that equal an ASCII letter when case is ignored.
CASE_VARIANTS = {"ı": "i", "İ": "i", "ſ": "s"}

TEXT_TYPE = "map<string,string>"


def spanish_matches(text: Column) -> Column:
    """Stop words and marked characters in a text, letter case ignored.

    Two plain scans and a hash lookup per word; one pattern with all alternatives and word bounds
    gives the same number at twice the cost.
    """
    folded = text
    for variant, letter in CASE_VARIANTS.items():
        folded = F.replace(folded, F.lit(variant), F.lit(letter))
    tokens = F.split(F.lower(folded), NOT_IN_WORD)
    return F.regexp_count(text, F.lit(SPANISH_CHARACTER_CLASS)) + F.size(
        F.filter(tokens, lambda w: w.isin(*PLAIN_SPANISH_WORDS))
    )


def language_of_counts(matches: Column, words: Column) -> Column:
    """``es`` when more than a tenth of the words carry a Spanish mark, else ``en``."""
    share = F.try_divide(matches.cast("double"), words)
    return F.when(share > SPANISH_SHARE, "es").otherwise("en")


def detect_language(text: Column) -> Column:
    """Language of a text; blank text is ``en``."""
    return language_of_counts(spanish_matches(text), word_count(text))


@dataclass(frozen=True)
class Detector:
    """A language detector: a Column function and the codes it can return."""

    detect: Callable[[Column], Column] = detect_language
    languages: Sequence[str] = OUTPUT_LANGUAGES


def empty_text() -> Column:
    return F.create_map().cast(TEXT_TYPE)


def create_text(text: Column, language: Column) -> Column:
    return F.when(is_present(text), F.create_map(language, text)).otherwise(empty_text())


def _tagged(texts: Column, code: str) -> Column:
    return F.transform(texts, lambda t: F.struct(F.create_map(F.lit(code), t).alias("text")))


def create_texts(texts: Column, language: Column, languages: Sequence[str]) -> Column:
    """``ARRAY<STRUCT<text>>`` of texts that share one language.

    The language is chosen outside the lambda (inside, it would be detected per element), and
    with two possible languages both arguments are evaluated once.
    """
    if len(languages) == 2:
        first, second = [_tagged(texts, code) for code in languages]
        return F.when(language == languages[0], first).otherwise(second)
    codes = F.array_repeat(language, F.size(texts))
    return F.zip_with(texts, codes, lambda t, code: F.struct(F.create_map(code, t).alias("text")))


def merge_texts(*texts: Column, languages: Sequence[str] | None = None) -> Column:
    """Per language, the first argument with non-empty text wins; ``languages`` keeps only those."""
    if languages is not None:
        return text_from(
            {
                code: F.coalesce(*[F.nullif(t.getItem(code), F.lit("")) for t in texts])
                for code in languages
            }
        )
    maps = [F.coalesce(t, empty_text()) for t in texts]
    codes = F.array_distinct(F.concat(*[F.map_keys(m) for m in maps]))
    entries = F.transform(
        codes,
        lambda code: F.struct(
            code.alias("key"),
            F.coalesce(*[F.nullif(F.try_element_at(m, code), F.lit("")) for m in maps]).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(entries, lambda e: is_present(e["value"])))


def text_from(values: dict[str, Column]) -> Column:
    """Multilingual text from one Column per language; null and blank languages are left out."""
    entries = F.array(
        *[F.struct(F.lit(code).alias("key"), c.alias("value")) for code, c in values.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: is_present(e["value"])))


def get_text(text: Column, language: str, fallbacks: Sequence[str] = OUTPUT_LANGUAGES) -> Column:
    """Text in the wanted language, else in the first fallback that has any, else blank."""
    codes = dict.fromkeys([language, *fallbacks])
    blank = F.lit("")
    return F.coalesce(
        *[F.nullif(text.getItem(code), blank) for code in codes],
        blank,
    )


def languages_of(text: Column) -> Column:
    return F.map_keys(F.map_filter(text, lambda _, v: v != ""))
