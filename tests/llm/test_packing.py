"""Packing against plain versions: the sum-of-squares rule, pieces, and the order of a mix."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import encoding, mixing, packing
from dossier.llm.encoding import Encoder
from dossier.llm.registry import BYTE_BPE, WORD_BPE, vocabulary


def plain_rule(sizes, capacity):
    """Tries every open gap and a new sequence, and counts the squares anew for each."""
    bins, places = [], []
    for size in sizes:
        best = None
        for gap in sorted({g for g in bins if size <= g < capacity} | {capacity}):
            after = list(bins)
            if gap == capacity:
                after.append(capacity - size)
            else:
                after[after.index(gap)] = gap - size
            squares = sum(after.count(g) ** 2 for g in set(after) if 0 < g < capacity)
            if best is None or squares < best[0]:
                best = (squares, gap)
        gap = best[1]
        if gap == capacity:
            bins.append(capacity - size)
        else:
            bins[bins.index(gap)] = gap - size
        places.append(gap)
    return places, sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares(seed):
    sizes = np.random.default_rng(seed).integers(1, 13, 60)
    into, at, fill = packing.sum_of_squares(sizes, 12)
    gaps, left = plain_rule(sizes.tolist(), 12)
    assert [12 - a for a in at.tolist()] == gaps
    assert sorted((12 - fill).tolist()) == left
    assert [sizes[into == b].sum() for b in range(len(fill))] == fill.tolist()


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_words_in_a_full_cache(name, monkeypatch):
    monkeypatch.setattr(encoding, "CACHED", 5)
    encoder = Encoder(vocabulary(name))
    texts = ["It's a word, (a) word2x and 'a' Word's.", "", "so 12 it's IT'S!", "a word, again a b c d e f g h"]
    for text in texts * 3:
        ids = encoder._tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == array("I", ids).tobytes()
        assert len(encoder._words) <= 5


def test_forms_of_a_word_are_looked_up_once():
    encoder = Encoder(vocabulary(WORD_BPE))
    model, pieces = encoder._model, []

    class Counting:
        def tokenize(self, piece):
            pieces.append(piece)
            return model.tokenize(piece)

    encoder._words.clear()
    encoder._model = Counting()
    text = "Zweimal zweimal, ZWEIMAL. Élan élan. élan,"
    assert encoder.ids(text) == array("I", encoder._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert len(pieces) == len(set(pieces)) == 4
    for text in ("ΣΊΣΥΦΟΣ Σ. ΑΣ,", "İSTANBUL, İ. Straße.", "x., y.. 'z', 1, a1. ,", "Ａ， ﬁ. Ⅷ,"):
        ids = encoder._tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == array("I", ids).tobytes()
    assert encoding.kept_encoder(vocabulary(WORD_BPE)) is encoding.kept_encoder(vocabulary(WORD_BPE))


def mix_of(spark):
    rows = [(i, f"{'word ' * (i % 37)}{i}", "aab"[i % 3] if i < 900 else "c") for i in range(1200)]
    rows += [(None, None, None), (None, None, None), (5, "again", "a"), (5, "again", "a")]
    rows += [(7, "x y " * 400, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_in_mix(spark):
    docs = mix_of(spark)
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    options = {"weights": weights, "block_rows": 4}
    pieces = packing.packed_in_mix(docs, vocabulary(BYTE_BPE), length=128, stretch=8, **options)
    pieces = packing.stored(pieces, "packed")
    rows = pieces.toPandas()
    encoder = Encoder(vocabulary(BYTE_BPE))
    wanted = []
    for doc_id, text, _ in docs.collect():
        ids = encoder.ids(text or "") + bytes(4)
        wanted += [(doc_id, k, s, len(p) // 4, zlib.crc32(p)) for k, s, p in packing._cut(ids, 128)]
    got = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, wanted))
    for _, parts in rows.sort_values("offset").groupby("sequence_id"):
        assert parts.offset.tolist() == (parts.length.cumsum() - parts.length).tolist()
        assert parts.length.sum() <= 128
    # Read in order of the sequences, the sources keep to the mix up to a stretch.
    slots = mixing.mixed(docs, tie=mixing.tie_of(docs), **options).toPandas()
    slot_of = dict(zip(slots.doc_id, slots.mix_slot // 8, strict=True))
    first = rows[rows.doc_id.notna() & ~rows.doc_id.isin([5, 7])].sort_values(["sequence_id", "offset"])
    stretches = [slot_of[d] for d in first.doc_id]
    assert stretches == sorted(stretches) and len(set(stretches)) > 10
    names = dict(zip(slots.doc_id, slots.source, strict=True))
    early = [names[d] for d, s in zip(first.doc_id, stretches, strict=True) if s < 10]
    for name, share in weights.items():
        assert abs(early.count(name) / len(early) - share) < 0.06


def test_in_mix_without_documents(spark):
    none = mix_of(spark).limit(0)
    assert packing.packed_in_mix(none, vocabulary(BYTE_BPE)).count() == 0


def test_pipeline_packs_by_the_places_of_its_mixing(spark):
    docs = mix_of(spark)
    mixed = corpus_pipeline.mixed_sources(spark, docs, "")
    assert mixed.count() == docs.count()
    usual = corpus_pipeline.packed_sequences(spark, mixed, "").toPandas()
    own = packing.packed_in_mix(docs, vocabulary(BYTE_BPE)).toPandas()
    order = ["sequence_id", "offset"]
    tables = [t.sort_values(order).fillna(-1).values.tolist() for t in (usual, own)]
    assert tables[0] == tables[1]
    # Another mix of the same documents gives other sequences, named by its places.
    turned = packing.stored(mixed.withColumn("mix_slot", 1000 - F.col("mix_slot")), "turned")
    rows = corpus_pipeline.packed_sequences(spark, turned, "").toPandas()
    place = {r.doc_id: r.mix_slot * 64 + r.mix_place for r in turned.collect() if r.doc_id not in (None, 5, 7)}
    seen = 0
    for sequence, parts in rows.groupby("sequence_id"):
        if parts.doc_id.notna().all() and not parts.doc_id.isin([5, 7]).any():
            assert sequence >> 24 == min(place[d] for d in parts.doc_id)
            seen += 1
    assert seen > 5
