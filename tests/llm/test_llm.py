"""The operators against plain versions, on the smallest tables and on rows with every oddity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

brute = pytest.importorskip("brute")
from dossier.llm import (  # noqa: E402
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    linking,
    mixing,
    packing,
    suffix_dedup,
    token_files,
    toxicity,
    vp_search,
)
from dossier.llm.encoding import Encoder  # noqa: E402
from dossier.llm.registry import BYTE_BPE, WORD_BPE, vocabulary  # noqa: E402

SMALL = "/root/testdata/sf0.001"
RANDOM = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "eta.", "theta", "été", "straße"]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) + RANDOM.choice(["", "s", "n", "ly", "ing"]) for _ in range(n))


def changed(text, n):
    words = text.split(" ")
    for i in RANDOM.sample(range(len(words)), n):
        words[i] = f"new{i}"
    return " ".join(words)


BASE, LONG = prose(60), prose(350)
TEXTS = [
    None, "", "   \n ", "one", "one two three", "One  two\tthree", BASE, BASE, BASE + " ", changed(BASE, 2),
    changed(BASE, 3), changed(BASE, 20), LONG, changed(LONG, 15), prose(60) + BASE + prose(60), prose(40),
    "12345 !!!", BASE[: len(BASE) // 2] + prose(30), "x" * 900, "a b c d e f g\na b c d e f g\nother",
]
TEXTS += [changed(BASE, 2) for _ in range(12)] + [prose(20) + "\n" + BASE for _ in range(4)]
ROWS = list(enumerate(TEXTS))
SCHEMA = "doc_id long, text string, lang string, source string, kept string, n int, node long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(i, t, "en" if i % 3 else None, "a" if i % 3 == 0 else None, "k", i, 1) for i, t in ROWS], SCHEMA
    )


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_exact_dedup(odd, none):
    def key(t):
        return re.sub(r"[ \t-\r]+", " ", t or "")

    first, size = {}, Counter(key(t) for _, t in ROWS)
    for i, t in ROWS:
        first.setdefault(key(t), i)
    expected = {
        (i, first[key(t)], size[key(t)], first[key(t)] == i, hashlib.sha256(key(t).encode()).hexdigest())
        for i, t in ROWS
    }
    assert {tuple(r) for r in exact_dedup.copies(odd).collect()} == expected
    kept = exact_dedup.first_of_copies(odd.unionByName(odd))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert exact_dedup.copies(none).count() == exact_dedup.first_of_copies(none).count() == 0


def test_exact_dedup_null_ids(spark):
    rows = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (3, "a", 3), (None, "b", 4)], "doc_id long, text string, n int")
    assert sorted(r.n for r in exact_dedup.first_of_copies(rows).collect()) == [3, 4]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(odd, width, percent):
    found = jaccard_join.similarity_groups(odd, width=width, percent=percent).collect()
    sized = brute.similar(ROWS, width, percent)
    least = {}
    for (i, _), (_, g) in zip(ROWS, sized, strict=True):
        least[g] = min(i, least.get(g, i))
    expected = {i: (n, least[g]) for (i, _), (n, g) in zip(ROWS, sized, strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_jaccard_join_empty(none):
    assert jaccard_join.similarity_groups(none).count() == 0
    assert jaccard_join.one_of_each(none).count() == 0


def test_line_dedup(odd, none):
    found = {(r.doc_id, r.line_no): (r.keep_id, r.keep_line_no) for r in line_dedup.line_groups(odd).collect()}
    assert found == brute.fuzzy_lines(ROWS)
    assert line_dedup.line_groups(none).count() == 0


def test_windows_of_long_texts(spark):
    generator = np.random.default_rng(3)
    passage, long = (bytes(generator.integers(97, 123, n, np.uint8)) for n in (700, 66_000))
    long = long[:65_300] + passage + long[65_300:]
    other = b"begins " + passage[:400] + b" ends" + long[5:90]
    hashes = suffix_dedup._window_hashes(long)
    assert len(hashes) == len(long) - 199 == len(np.unique(hashes))
    assert (hashes[65_300:65_501] == suffix_dedup._window_hashes(other)[7:208]).all()
    assert (suffix_dedup._window_hashes(passage * 100)[:700] == hashes[65_300:65_801][0]).sum() == 1
    w = suffix_dedup.Windows(long)
    assert w.sizes.sum() == len(hashes) and not hasattr(w, "hashes")
    docs = spark.createDataFrame([(1, long.decode()), (2, other.decode()), (3, "short")], "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(docs).collect()}
    assert found == {1: (400, 1), 2: (400, 1), 3: (0, 0)}


def test_suffix_dedup(odd, none):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.without_repeats(odd).collect()}
    expected = brute.without_repeats([(t or "").encode() for _, t in ROWS])
    assert found == {i: e for (i, _), e in zip(ROWS, expected, strict=True)}
    assert suffix_dedup.without_repeats(none).count() == 0


def test_loser_tree():
    runs = []
    for _ in range(5):
        names = sorted({bytes(RANDOM.choices(b"ab", k=RANDOM.randrange(1, 9))) for _ in range(40)})
        runs.append({s: [(len(s), i, 1)] for i, s in enumerate(names)})
    tree = suffix_dedup.LoserTree([suffix_dedup.Run(suffix_dedup._encoded(r, sorted(r))) for r in runs])
    every = sorted(s for r in runs for s in r)
    equal = [a == b for a, b in zip(every, [None, *every], strict=False)]
    assert [(e, p[0, 0]) for e, p in tree] == [(e, len(s)) for e, s in zip(equal, every, strict=True)]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_encoder(name):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name))
    odd = [t or "" for t in TEXTS] + ["a ", "a  b", " \n a", "<|endoftext|> x", "IT'S we'LL", "ΟΔΟΣ İ", "é x\xa0y"]
    odd += ["".join(RANDOM.choices(" \n\tab1.,'é ßS", k=RANDOM.randrange(25))) for _ in range(500)]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids, text


def test_token_files(odd, none):
    found = token_files.round_trip(odd, vocabulary(WORD_BPE), shard_ids=500).orderBy("doc_id").collect()
    encoder, start = Encoder(vocabulary(WORD_BPE)), 0
    for (i, t), row in zip(ROWS, found, strict=True):
        ids = encoder.ids(t or "") + (1).to_bytes(4, "little")
        assert tuple(row) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert token_files.round_trip(none, vocabulary(WORD_BPE)).count() == 0


def test_planes():
    ids = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint32)
    for some in (ids, ids % 50_000, np.zeros(3, np.uint32), ids[:1]):
        assert (token_files.from_planes(token_files.planes(some), len(some)) == some).all()


def test_packing(odd, none, small):
    for docs in (odd, small):
        pieces = packing.packed(docs, vocabulary(BYTE_BPE), with_ids=True, chunk=40)
        rows = pieces.collect()
        total = sum(r.length for r in rows)
        by_sequence, by_doc = {}, {}
        for r in rows:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
            by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, bytes(r.ids)))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.LENGTH
        encoder = Encoder(vocabulary(BYTE_BPE))
        for doc_id, text in docs.select("doc_id", "text").collect():
            parts = sorted(by_doc[doc_id])
            assert b"".join(p[3] for p in parts) == encoder.ids(text or "") + bytes(4)
            assert all(p[2] == packing.LENGTH for p in parts[1:])
        assert len(by_sequence) <= 1.1 * -(-total // packing.LENGTH) + 2
    assert packing.packed(none, vocabulary(BYTE_BPE)).count() == 0


def test_mixing(small, none, odd):
    rows = mixing.mixed(small, block_rows=1, slots=40).toPandas()
    assert len(rows) == small.count()
    assert not rows.duplicated(["mix_slot", "mix_place"]).any()
    weight = rows.groupby("source").size() ** 0.5
    shares = (40 * weight / weight.sum()).round().clip(lower=1)
    first = rows[rows.mix_phase == 1].sort_values("mix_slot")
    last = first.groupby("source").mix_slot.max().min()
    first = first[first.mix_slot <= last]
    for source, share in (shares / max(80, shares.sum())).items():
        placed = (first.source == source).cumsum().to_numpy()
        exact = (first.mix_slot.to_numpy() + 1) * share * max(80, shares.sum()) / shares.sum()
        assert len(placed) == 0 or abs(placed - exact).max() < 2.5
    assert mixing.mixed(none).count() == 0
    assert mixing.in_mixed_order(odd).count() == len(ROWS)


def test_mixing_windows(spark):
    """With given weights, no source is a block ahead or behind in any slot."""
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(3000)], "doc_id long, source string")
    rows = mixing.mixed(docs, weights={"a": 0.5, "b": 0.3, "c": 0.2}, block_rows=1, slots=10).toPandas()
    # Twelve slots a period (four per source): six, four and two of them; up to where "a" runs out.
    first = rows[rows.mix_slot < 1980].sort_values("mix_slot")
    for source, share in {"a": 6 / 12, "b": 4 / 12, "c": 2 / 12}.items():
        placed = (first.source == source).cumsum().to_numpy()
        assert abs(placed - (first.mix_slot.to_numpy() + 1) * share).max() < 1


def test_near_copies_with_null_and_repeated_ids(spark):
    """Each row is decided on its own text: one row of each group stays, others of the id too."""
    a, b, c, other = prose(80), prose(80), prose(80), prose(80)
    rows = [
        (1, a), (2, changed(a, 1)), (2, other),  # only one row of id 2 is a near copy
        (3, b), (3, changed(b, 1)),  # near copies that share an id
        (4, c), (None, changed(c, 1)),  # a near copy without an id
        (None, "Y " + b[::-1]), (None, "Z " + b[::-1]),  # a group without ids
        (5, ""), (5, ""), (6, other[::-1]), (6, other[::-1]),
    ]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept)
    assert found == [-1, 1, 2, 3, 4, 5, 5, 6]
    assert {r.text for r in kept if r.doc_id in (1, 2, 4)} == {a, other, c}


def test_mixing_keeps_to_the_weights(spark):
    """The deviation from the given weights does not grow, nor do small sources get more."""
    docs = spark.createDataFrame([(i, "abcdef"[i % 6]) for i in range(9000)], "doc_id long, source string")
    weights = {"a": 0.47, "b": 0.3, "c": 0.2, "d": 0.029, "e": 0.001}
    rows = mixing.mixed(docs, weights=weights, block_rows=1).toPandas().sort_values("mix_slot")
    assert rows.mix_slot.tolist() == list(range(9000))
    first = rows[rows.mix_phase == 1]
    assert len(first) > 3100
    for source, share in {**weights, "f": 0}.items():
        placed = (first.source == source).cumsum().to_numpy()
        assert abs(placed - (first.mix_slot.to_numpy() + 1) * share).max() < 1


def test_line_dedup_typos(spark):
    """One typo in short, long and space-free lines, which leave the bits of whole words far apart."""
    line = " ".join(WORDS) + " " + prose(4)
    pairs = [(prose(20), 30), (line, 12), (prose(100), 200), ("漢字仮名交文章" * 12, 40), ("q" * 11 + "wertyuiopasdfghjk" * 4, 33)]
    rows = [(2 * i + k, x if k == 0 else x[:at] + "z" + x[at + 1 :]) for i, (x, at) in enumerate(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.line_groups(docs, bits=line_dedup.GRAM_BITS, grams=line_dedup.GRAMS).collect()
    assert {r.doc_id: r.keep_id for r in found} == {i: i - i % 2 for i, _ in rows}


def test_line_dedup_hashes(spark):
    """The n-grams cut out of bytes are those of the regular expression, in characters of every length."""
    generator = random.Random(3)
    sizes = [*range(1, 12)] * 8 + [125, 126, 127, 128, 129, 300, 5000]
    keys = sorted({"".join(generator.choice("ab é漢𝒳 z0") for _ in range(n)) for n in sizes})
    keys += sorted({"".join(generator.choice("ab é漢 z0") for _ in range(n)) for n in sizes} - set(keys))
    lines = spark.createDataFrame([(i, k, 0, 0) for i, k in enumerate(keys)], "node long, key string, id long, line_no int")
    for n in (2, 3, 5):
        found, plain = line_dedup._gram_hashed(lines, n), line_dedup._hashed(lines, n)
        assert sorted(found.select(plain.columns).collect()) == sorted(plain.collect())


def test_line_dedup_long_lines_of_one_language(spark, monkeypatch):
    """Long lines of few words look alike by hash; only copies become pairs, and all of these are found."""
    draw = random.Random(5)
    words = ["the", "of", "and", "in", *("".join(draw.choices("aeinorst", k=draw.randint(3, 7))) for _ in range(60))]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(100)]
    copies = []
    for text in texts[:20]:
        letters = list(text)
        for at in draw.sample(range(len(letters)), 6):
            letters[at] = draw.choice("xyz")
        copies.append("".join(letters))
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    counts, real = {}, line_dedup.stored

    def counted(df, name):
        table = real(df, name)
        counts[name] = table.count()
        return table

    monkeypatch.setattr(line_dedup, "stored", counted)
    found = line_dedup.line_groups(docs, bits=line_dedup.GRAM_BITS, grams=line_dedup.GRAMS).collect()
    assert {r.doc_id: r.keep_id for r in found} == {i: i - 100 if i >= 100 else i for i in range(120)}
    assert counts["pairs"] < 60


def test_line_dedup_common_shingle(spark):
    """More lines than a block may hold share all their first words; near copies among them are found."""
    n = 3 * line_dedup.LARGE_BLOCK
    draw = random.Random(6)
    ends = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=150)) for _ in range(n)]
    start = "one common passage of many words that opens every line of all of these documents here "
    texts = [start + e for e in ends] + [start + e[:-1] + "9" for e in ends[:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup.line_groups(docs, bits=line_dedup.GRAM_BITS, grams=line_dedup.GRAMS).collect()
    assert {r.doc_id: r.keep_id for r in found} == {i: i - n if i >= n else i for i in range(n + 50)}


def test_linked_pairs_tries_one_pair_a_node_first(spark):
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30)] + [(40, 41), (40, 42), (41, 42), (29, 50), (30, 50)]
    pairs = linking.stored(spark.createDataFrame(pairs, "a long, b long"), "pairs")
    tried = []

    def verified(some):
        tried.append(some.count())
        # 40 and 42 are far apart, 29 and 50 too.
        return some.filter("NOT (a = 40 AND b = 42) AND NOT (a = 29 AND b = 50)")

    links, groups = linking.linked_pairs(pairs, verified)
    heads = {r.node: r.group for r in groups.collect()}
    assert heads == {i: 0 for i in range(30)} | {40: 40, 41: 40, 42: 40, 30: 30, 50: 30}
    assert sum(tried) < 40
    linking.discard(links, groups)


def test_line_dedup_leaves_no_members(spark):
    """Of the tables with a row for each node and bucket none stays after the groups are found."""
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.glob("llm-*/*"))
    docs = spark.createDataFrame([(i, f"{BASE} {i}") for i in range(300)], "doc_id long, text string")
    groups = line_dedup.line_groups(docs, bits=line_dedup.GRAM_BITS, grams=line_dedup.GRAMS)
    assert not {p.name for p in set(base.glob("llm-*/*")) - before} & {"members", "many", "lines", "nodes"}
    assert {r.keep_id for r in groups.collect()} == {0}


def test_search(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.toPandas().sort_values("vec_id")
    vectors, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
    odd = spark.createDataFrame([(10**6, None), (10**6 + 20, [0.0] * 64), (10**6 + 40, [float("nan")] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    for factor, least in ((1.0, 1.0), (vp_search.FACTOR, 0.9)):
        found = {}
        for r in vp_search.nearest(table.drop("label").unionByName(odd), factor=factor, shard_rows=100).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        hits = []
        for i in np.flatnonzero(ids % 20 == 0):
            scores = (vectors * vectors[i]).sum(axis=1)
            scores[i] = -np.inf
            best = ids[np.lexsort((ids, -scores))[:20]].tolist()
            hits.append(len(set(best) & {v for _, v in found[ids[i]]}) / 20)
            assert factor > 1 or [v for _, v in sorted(found[ids[i]])] == best
        assert len(found) == len(hits) and np.mean(hits) >= least


def test_language(spark, none, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert ((zlib.crc32(b"17") % 5 == 0) == rows[rows.doc_id == 17].held_out).all()
    found = {r.doc_id: r.lang_pred for r in language_id.identified(odd).collect()}
    assert [found[i] for i in (0, 1, 2, 16)] == ["und"] * 4 and found[6] == "en"
    assert language_id.identified(none).count() == 0
    assert language_id.accepted(odd).columns == odd.columns


def test_toxicity(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"
    )
    some = labels.filter("doc_id % 3 <> 0")
    rows = toxicity.toxic_documents(docs, some).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert rows[rows.toxic == 1].is_toxic.mean() > 0.75
    assert rows[rows.toxic == 0].is_toxic.mean() < 0.02
    assert toxicity.toxic_documents(none, labels).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL)
    pieces = rows.toPandas()
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns and kept.count() <= docs.count(), name
        docs = kept
    # What the last stage packs is what the stages before it kept, stretch by stretch of their mix.
    assert set(pieces.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    mix = mixing.mixed(docs, tie=mixing.tie_of(docs)).toPandas().set_index("doc_id")
    order = pieces.sort_values(["sequence_id", "offset"]).doc_id.map(mix.mix_slot // packing.STRETCH)
    assert order.is_monotonic_increasing


def test_shared_folder_is_the_sessions(spark):
    from dossier.llm.common import shared_folder

    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert Path(shared_folder(spark)).parent.exists()
