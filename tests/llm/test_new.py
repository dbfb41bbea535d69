"""Source divergence, sharding and structure repair against plain versions and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier.llm import divergence, oracles, sharding, structure

RANDOM = random.Random(11)

WORDS = ["Alpha", "beta", "été", "Été", "straße", "I'm", "x2y", "语言", "𝔘nit", "naïve", "z"]
TEXTS = [None, "", "  \n", "123 !?", *(" ".join(RANDOM.choices(WORDS, k=k)) for k in [1, 5, 30] * 30)]
TEXTS += ["word\x00other\x7fthird[fourth`fifth{sixth", "a" * 5000, "long " * 3000] + ["same text"] * 40
DOCUMENTS = [
    (None if i == 7 else i % 120, t, [None, "en", "de"][i % 3], [None, "", "a", "b"][i % 4], "k", 1, 2)
    for i, t in enumerate(TEXTS)
]
SCHEMA = "doc_id long, text string, lang string, source string, shard string, slot int, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(DOCUMENTS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_divergence(least):
    docs = [(lang or "", source or "", re.findall(
        "[^\x00-\x40\x5b-\x60\x7b-\x7f]+",
        (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source, *_ in DOCUMENTS]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        total = Counter(t for d in mine for t in d[2] if t in kept)

        def share(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in groups.items():
            pairs = [(-sum(far(share(c, t), share(o, t)) for t in kept), n) for n, o in groups.items() if n != s]
            terms = [(-far(share(c, t), share(total, t)), t) for t in kept if c[t] and share(c, t) > share(total, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, n, -v, k + 1) for k, (v, n) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("least,cells", [(1, 4), (3, 1 << 18), (10, 7), (10**6, 4)])
def test_divergence(odd, monkeypatch, least, cells):
    for name, value in (("_CHUNK", 300), ("_LONG", 900), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.divergence(odd.repartition(3), least=least).collect()
    assert sorted(map(tuple, got)) == plain_divergence(least)


def test_divergence_empty(none):
    assert divergence.divergence(none).collect() == []


def test_long_texts_are_counted_by_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "_LONG", 7)
    text = "Ab cdefghijklmnopqrstuvwxyzäöü,, ab  x" * 3
    got = [t.decode() for piece in divergence._terms(text.encode()) for t in piece]
    assert got == re.findall("[a-zäöü]+", text.lower())


def test_skyband_holds_every_first_rank(spark):
    rows = [("l", str(i % 2), f"t{RANDOM.randrange(10**6):06d}{i}", RANDOM.randrange(1, 9), RANDOM.randrange(9, 30))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n long, in_lang long")
    kept = {tuple(r) for r in divergence.skyband(df.repartition(5), 3).collect()}
    beaten = {
        a: sum(b[1] == a[1] and b[3] >= a[3] and b[4] <= a[4] and b[2] < a[2] for b in rows) for a in rows
    }
    assert kept == {a for a, n in beaten.items() if n < 3}


def jump(key, shards):
    state, bucket, to = key % 2**64, -1, 0
    while to < shards:
        bucket = to
        state = (state * 2862933555777941757 + 1) % 2**64
        to = int((bucket + 1) * (2.0**31 / ((state >> 33) + 1)))
    return bucket


def test_jump(spark):
    keys = [None, 0, 1, -1, 2**63 - 1, -(2**63), *(RANDOM.getrandbits(64) - 2**63 for _ in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 24, 25, 700):
        got = [r[0] for r in df.select(sharding.shard_of(F.col("k"), shards)).collect()]
        assert got == [jump(k or 0, shards) for k in keys]


def test_shard_list(odd, none):
    got = sharding.shard_list(odd).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in DOCUMENTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "key" and r["shard"] == jump(r["doc_id"] or 0, 24)
        assert r["grown_shard"] == jump(r["doc_id"] or 0, 25) and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_list(none).collect() == []


def test_sharding_of_other_keys(spark):
    """Sparse, negative, repeated, null and text keys; kept columns that clash go."""
    rows = [(k, f"n{k}", "x") for k in [-(2**62), 2**62, -1, 0, 65535, 65536, 2**33, 2**49] for _ in range(40)]
    rows += [(None, "gone", "x")] * 30 + [(None, f"n{i}", "x") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, name string, shard string")
    for key in ("id", "name"):
        out = sharding.sharded(df, key, 5)
        assert out.columns == ["id", "name", "shard", "slot", "grown_shard"]
        got = out.collect()
        assert Counter((r["id"], r["name"]) for r in got) == Counter(r[:2] for r in rows)
        for shard in range(5):
            mine = sorted((r["slot"], r["id"] is None, r["id"] or 0) for r in got if r["shard"] == shard)
            assert [m[0] for m in mine] == list(range(len(mine)))
            if key == "id":
                assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def least_edits(rows, role=0, ends=(0, 3)):
    """By dynamic programming over whole strings of edits."""
    states = {role: (0, "")}

    def put(to, state, into):
        if state is not None and (to not in into or state < into[to]):
            into[to] = state

    def inserted():
        for _ in range(3):
            for q, (cost, audit) in list(states.items()):
                put(structure._NEXT[q], (cost + 3, audit + "I"), states)

    inserted()
    for initial, fault in rows:
        new = {}
        for q, (cost, audit) in states.items():
            put(q, (cost + 4, audit + "D"), new)
            if fault not in (1, 2):
                cost += 3 * (fault == 3)
                if initial in structure._KEPT[q]:
                    put(structure._KEPT[q][initial], (cost, audit + "K"), new)
                put(structure._NEXT[q], (cost + 3, audit + "R"), new)
        states = new
        inserted()
    found = [states[e] for e in ends if e in states]
    return min(found) if found else None


def test_search():
    for _ in range(1500):
        rows = [(RANDOM.choice(["s", "u", "a", "u", "a", "x", ""]), RANDOM.choice([0, 0, 0, 1, 2, 3]))
                for _ in range(RANDOM.randrange(10))]
        for role in range(4):
            for ends in ((0, 3), (0,), (1,), (2,), (3,)):
                assert structure.Search(rows, ends).best(role) == least_edits(rows, role, ends)


def test_search_of_many_rows():
    rows = [("sua"[RANDOM.randrange(3)], RANDOM.randrange(4)) for _ in range(structure.SEGMENT)]
    assert structure.Search(rows, (0, 3)).best() == least_edits(rows)


SAID = ["Yes.", "no", "", " \t", "Why?\n", "Done! ", None, "…", "½.", "a:b"]
CONVERSATIONS = [
    (c, t, RANDOM.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]),
     RANDOM.choice(SAID) if RANDOM.random() < 0.5 else f"said {RANDOM.random()}.", "k", 1)
    for c in [*range(60), None, 10**12, -3]
    for t in [*range(RANDOM.randrange(8)), *([None, 2, 2, 9] if RANDOM.random() < 0.3 else [])]
]
CONVERSATIONS += [(500, t, ["user", "assistant"][t % 2], f"turn {t % 700}.", "k", 1) for t in range(1500)]
CONVERSATIONS += [(501, 3, "user", "again.", "k", 1)] * 900 + [(502, 4, "user", "x" * 10**6 + ".", "k", 1)]
CONVERSATION_SCHEMA = "conv_id long, turn long, role string, text string, copies string, first int"


def plain_repair():
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in CONVERSATIONS:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        draw = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        role = "user" if draw == 4 else role
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        groups[conv] += [((turn is not None, turn or 0), turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            inner = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not inner else 2 if (role, text) in seen else 0 if inner[-1] in ".!?" else 3)
            seen.add((role, text))
        roles = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit = least_edits(list(zip(roles, faults, strict=True)))
        kept = structure.repaired_rows([r[2:] for r in rows], audit)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [structure.SEGMENT, 3, 1])
def test_repair(spark, segment):
    df = spark.createDataFrame(CONVERSATIONS, CONVERSATION_SCHEMA).repartition(7)
    got = structure.repaired(df, segment=segment).collect()
    assert sorted(map(tuple, got), key=repr) == plain_repair()


def test_repair_over_many_tasks(spark):
    """A conversation of many rows lies in several tasks."""
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(CONVERSATIONS, CONVERSATION_SCHEMA)
        got = structure.repaired(df, segment=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert sorted(map(tuple, got), key=repr) == plain_repair()


def test_repair_empty(spark):
    assert structure.repaired(spark.createDataFrame([], CONVERSATION_SCHEMA)).collect() == []


def test_sql_of_odd_rows(spark, odd, tmp_path):
    """The SQL agrees on the odd rows too."""
    talk = spark.createDataFrame([c for c in CONVERSATIONS if c[0] not in (500, 501, 502)], CONVERSATION_SCHEMA)
    con = duckdb.connect()
    for name, df in (("documents", odd.drop("a.b")), ("conversations", talk)):
        df.write.parquet(str(tmp_path / name))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}/*.parquet')")
    for df, sql in (
        (divergence.divergence(odd), oracles.DIVERGENCE),
        (structure.repaired(talk), oracles.STRUCTURE_REPAIR),
    ):
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql}) x").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
