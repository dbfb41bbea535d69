"""Stages that keep all columns keep them whatever they are called."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.llm import exact_dedup, jaccard_join, language_id, mixing

RANDOM = random.Random(3)
ODD = ["repeats", "slice", "a.b", "__hash", "__row", "__sha", "row", "__lang", "node", "n", "id", "again"]
SAID = [" ".join(RANDOM.choices("uno dos tres cuatro cinco seis siete ocho".split(), k=30)) for _ in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(60):
        text = [None, "½ ²", SAID[i % 6], SAID[i % 6] + " fin", f"{SAID[i % 6]}  x{i}"][i % 5]
        rows.append((i, text, "es", f"s{i % 3}", *(f"{name}{i}" for name in ODD)))
    columns = ["doc_id", "text", "lang", "source", *ODD]
    schema = ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in columns)
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "stage",
    [exact_dedup.first_of_copies, jaccard_join.one_of_each, mixing.in_mixed_order, language_id.accepted],
)
def test_stage(docs, stage):
    plain = docs.select("doc_id", "text", "lang", "source")
    out = stage(docs)
    assert out.columns == docs.columns
    got = {r[0]: tuple(r) for r in out.collect()}
    assert set(got) == {r.doc_id for r in stage(plain).collect()} and len(got) == out.count()
    for i, row in got.items():
        assert row[4:] == tuple(f"{name}{i}" for name in ODD)


def test_signs_that_are_no_letters(docs):
    found = language_id.identified(docs).filter(F.col("doc_id") % 5 < 2).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 1.0)} and len(found) == 24
    for text in ("½ ²", "①Ⅷ", "12_3", "́", ""):
        assert not len(language_id.grams(text))
    assert len(language_id.grams("aª")) and len(language_id.grams("语"))
