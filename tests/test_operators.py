"""Aggregates, dedup, merge, numbering, records and assembly."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.functions.language import create_text, merge_texts
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
from dossier.operators.skew import hot_keys, spread_hot_keys
from dossier.operators.sources import source_order, union_sources
from dossier.operators.translations import dedup_translations


def shuffled(rows):
    rows = list(rows)
    random.Random(7).shuffle(rows)
    return rows


def named(spark, lists):
    rows = [(str(e), i, n) for e, names in enumerate(lists) for i, n in enumerate(names)]
    return spark.createDataFrame(shuffled(rows), "e string, ord long, name string").repartition(7)


def names_of(df, n):
    out = {str(i): [] for i in range(n)}
    for r in sorted(df.collect(), key=lambda r: r.ord):
        out[r.e].append(r.name)
    return [out[str(i)] for i in range(n)]


def test_first_row_and_counts(spark):
    df = spark.createDataFrame(
        shuffled([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")]), "e string, ord long, v string"
    )
    assert {(r.e, r.ord, r.v) for r in first_row(df, ["e"], "ord").collect()} == {
        ("a", 1, None), ("b", 5, "z"),
    }
    assert {(r.e, r.v) for r in keep_last_entry(df, ["e"], "ord").collect()} == {("a", "x"), ("b", "z")}
    assert {(r.e, r.n) for r in count_rows(df, ["e"], "n").collect()} == {("a", 2), ("b", 1)}


def test_preferred_else_first(spark):
    df = spark.createDataFrame(
        shuffled([("a", 0, "No", "1"), ("a", 1, "yes", "2"), ("a", 2, "Yes", "3"),
                  ("b", 0, "No", "4"), ("b", 1, "No", "5"), ("c", 0, "No", "6"), ("c", 1, "YES", "")]),
        "e string, ord long, p string, v string",
    )
    out = preferred_else_first(df, ["e"], "ord", F.lower("p") == "yes", F.col("v"), "v")
    assert {(r.e, r.v) for r in out.collect()} == {("a", "2"), ("b", "4"), ("c", "")}


def test_dedup_keeps_first_whole_row(spark):
    df = spark.createDataFrame(
        shuffled([("a", 0, "English", None), ("a", 1, "ENGLISH", "x"), ("a", 2, "French", "y")]),
        "e string, ord long, name string, level string",
    )
    out = first_per_key(df, ["e"], F.lower("name"), "ord").collect()
    assert {(r.ord, r.name, r.level) for r in out} == {(0, "English", None), (2, "French", "y")}


@pytest.mark.parametrize(
    "names, expected",
    [
        (["Python", "python", "PYTHON"], ["Python"]),
        (["B", "A (b)"], ["B"]),
        (["A (b)", "b"], ["b", "b"]),
        (["", "Python", "  "], ["Python"]),
        (["A (Y)", "B (Y)", "Y"], ["Y", "Y", "Y"]),
        (["A ( )", "A ()"], ["", "A ()"]),
    ],
)
def test_dedup_translations(spark, names, expected):
    out = dedup_translations(named(spark, [names]), ["e"], "ord", F.col("name"))
    assert names_of(out, 1) == [expected]


def model_dedup(names):
    """Our own sequential statement of the rule."""
    kept, plain, full = [], set(), set()
    for raw in names:
        name = raw.strip()
        if not name or name.lower() in full:
            continue
        pair = re.search(r"\(([^)]+)\)", name)
        if pair and pair[1].strip().lower() in plain:
            continue
        full.add(name.lower())
        if not pair:
            plain.add(name.lower())
        kept.append(pair[1].strip() if pair else name)
    return kept


def test_dedup_translations_on_random_lists(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "Ñ", "ñ ", "c d"]

    def one():
        return rng.choice(
            [rng.choice(words), f"{rng.choice(words)} ({rng.choice(words)})", f"({rng.choice(words)}", " "]
        )

    lists = [[one() for _ in range(rng.randint(1, 14))] for _ in range(400)]
    out = dedup_translations(named(spark, lists), ["e"], "ord", F.col("name"))
    assert names_of(out, len(lists)) == [model_dedup(x) for x in lists]


def test_hot_keys_are_spread_and_joined_once(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    right = spark.createDataFrame([("hot", 1), ("2000", 2)], "k string, v int")
    assert [r.k for r in hot_keys(left, ["k"], 0.1).collect()] == ["hot"]
    a, b, keys = spread_hot_keys(left, right, ["k"], F.col("id"), share=0.1, spread=8)
    assert a.filter("k = 'hot'").select("_salt").distinct().count() == 8
    assert a.join(b, keys).count() == 1501
    assert a.join(b, keys, "left_anti").count() == 1499


def texts(df, *names):
    return df.select(
        *[c for c in df.columns if c not in names],
        *[create_text(F.col(n), F.col("code")).alias(n) for n in names],
    )


def test_merge_bilingual_groups_nulls_and_keeps_first(spark):
    rows = [
        ("x", "Acme", None, 0, "en", "Dev", "first"),
        ("x", "Acme", None, 1, "es", "Des", "second"),
        ("x", "Acme", None, 2, "en", "Dev2", "third"),
        ("x", "Acme", "NYC", 3, "es", "", "fourth"),
        ("y", "Acme", None, 0, "es", "Otro", "fifth"),
    ]
    df = spark.createDataFrame(
        shuffled(rows), "e string, company string, location string, ord long, code string, role string, other string"
    ).repartition(5)
    out = merge_bilingual(texts(df, "role").drop("code"), ["e", "company", "location"], "ord", ["role"])
    assert {(r.e, r.location, r.ord, r.other, tuple(sorted(r.role.items()))) for r in out.collect()} == {
        ("x", None, 0, "first", (("en", "Dev"), ("es", "Des"))),
        ("x", "NYC", 3, "fourth", ()),
        ("y", None, 0, "fifth", (("es", "Otro"),)),
    }


def test_merge_bullets_by_position(spark):
    rows = [
        ("x", 0, "en", ["one", "two"]), ("x", 1, "es", ["uno"]), ("x", 2, "en", ["x", "y", "z"]), ("y", 0, "en", []),
    ]
    df = spark.createDataFrame(shuffled(rows), "e string, ord long, code string, b array<string>")
    df = df.select(
        "e", "ord",
        F.zip_with("b", F.array_repeat("code", F.size("b")), lambda b, c: F.struct(F.create_map(c, b).alias("text"))).alias("b"),
    ).repartition(4)
    out = {r.e: [x.text for x in r.b] for r in merge_bilingual(df, ["e"], "ord", [], bullets="b").collect()}
    assert out == {"x": [{"en": "one", "es": "uno"}, {"en": "two"}, {"en": "z"}], "y": []}


def test_merge_more_languages(spark):
    df = spark.createDataFrame([("x", 0, "fr", "un"), ("x", 1, "de", "ein")], "e string, ord long, code string, t string")
    out = merge_bilingual(texts(df, "t").drop("code"), ["e"], "ord", ["t"], languages=("fr", "de"))
    assert out.first().t == {"fr": "un", "de": "ein"}


def test_merge_keeps_any_language(spark):
    rows = [("x", 0, "fr", "un"), ("x", 1, "de", "ein"), ("x", 2, "en", "one"), ("x", 3, "fr", "deux")]
    df = texts(spark.createDataFrame(rows, "e string, ord long, code string, t string"), "t")
    df = df.withColumn("b", F.array(F.struct(F.col("t").alias("text")), F.lit(None).cast("struct<text: map<string,string>>")))
    expected = {"fr": "un", "de": "ein", "en": "one"}
    out = merge_bilingual(df.drop("code"), ["e"], "ord", ["t"], bullets="b").first()
    assert out.t == expected and out.b[0].text == expected
    other = F.create_map(F.lit("fr"), F.lit("late"), F.lit("pt"), F.lit("um"), F.lit("it"), F.lit(""))
    merged = df.filter("ord = 0").select(merge_texts(F.lit(None).cast("map<string,string>"), F.col("t"), other).alias("m"))
    assert merged.first().m == {"fr": "un", "pt": "um"}


def test_parts_do_not_depend_on_the_total(spark, monkeypatch):
    from dossier.operators import assemble as module

    lines = spark.range(400).select((F.col("id") % 4).alias("d"), F.col("id").alias("ord"), F.lit("x" * 20).alias("text"))
    found = []
    for most in (1 << 20, 2):
        monkeypatch.setattr(module, "MAX_CUTS", most)
        out = module.assemble(lines, ["d"], part_bytes=500, total_bytes=8400)
        found.append(sorted((r.d, r.part_no, r.content) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) > 8


def test_only_documents_of_large_sums_are_cut_by_spans(spark):
    from dossier.operators import assemble as module

    size = F.when(F.col("id") < 3000, 1).otherwise(10).cast("long")
    ids = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(-1).alias("d"), size.alias("_size"))
    kept = module._of_large_sums(ids, ["d"], part_bytes=500, total_bytes=13_000).groupBy("d").count().collect()
    assert {r.d: r["count"] for r in kept}[-1] == 1000 and len(kept) < 100


def test_number_rows_over_spans(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("ord")).repartition(9)
    out = number_rows(df, ["g"], "ord", "n", span_bits=6).collect()
    for g in range(3):
        numbers = [r.n for r in sorted((r for r in out if r.g == g), key=lambda r: r.ord)]
        assert numbers == list(range(1, len(numbers) + 1))


def test_union_keeps_list_order_then_row_order(spark):
    a = spark.createDataFrame([(0, "a0"), (1, "a1")], "row_no long, v string")
    b = spark.createDataFrame([(0, "b0")], "row_no long, v string")
    assert [r.v for r in union_sources([b, a], "row_no").orderBy("ord").collect()] == ["b0", "a0", "a1"]
    keyed = spark.createDataFrame([("t_1", 0), ("t", 5)], "k string, n long")
    ordered = keyed.withColumn("o", source_order(F.col("k"), ["t", "t_1"], F.col("n"))).orderBy("o")
    assert [r.k for r in ordered.collect()] == ["t", "t_1"]


def test_open_record_keeps_order_and_last_value(spark):
    df = spark.createDataFrame(
        [(["A B", "C", "a b", "D"], {"A B": "1", "C": "", "a b": "2", "D": "4"}),
         (["A B", "C"], {"A B": "1", "C": "3"}), (["A"], {"A": None})],
        "h array<string>, c map<string,string>",
    )
    out = df.select(open_record(F.col("h"), F.col("c")).alias("r")).collect()
    assert [[(e.key, e.value) for e in r.r] for r in out] == [
        [("a_b", "2"), ("d", "4")], [("a_b", "1"), ("c", "3")], [],
    ]


def rebuilt(parts, by):
    out = {}
    for r in sorted(parts, key=lambda r: r.part_no):
        out[r[by]] = out.get(r[by], "") + r.content
    return out


@pytest.mark.parametrize("partitions", ["1", "6"])
@pytest.mark.parametrize("total", [None, 10_000])
def test_assemble_parts_concatenate_to_the_document(spark, partitions, total):
    rows = [("big", i * 3, f"línea {i}") for i in range(800)] + [("small", 9, "z"), ("small", 2, "a")]
    lines = spark.createDataFrame(shuffled(rows), "d string, ord long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        parts = assemble(
            lines, ["d"], header="H\n", footer="F", separator=", ", part_bytes=500, total_bytes=total
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rebuilt(parts, "d") == {
        "big": "H\n" + ", ".join(f"línea {i}" for i in range(800)) + "F",
        "small": "H\na, zF",
    }
    big = [r for r in parts if r.d == "big"]
    assert len(big) > 10 and not any(r.whole for r in big)
    assert max(len(r.content.encode()) for r in big) <= 510
    assert [(r.part_no, r.whole) for r in parts if r.d == "small"] == [(0, True)]


@pytest.mark.parametrize("total", [None, 9000])
def test_a_long_line_does_not_shrink_the_other_parts(spark, total):
    rows = [("d", i, "x" * (3000 if i == 700 else 3)) for i in range(1500)] + [("e", 4000 * i, "y" * 99) for i in range(90)]
    lines = spark.createDataFrame(shuffled(rows), "d string, ord long, text string").repartition(3)
    parts = assemble(lines, ["d"], part_bytes=4096, total_bytes=total).collect()
    assert rebuilt(parts, "d") == {
        d: "\n".join(t for e, _, t in sorted(rows) if e == d) for d in ("d", "e")
    }
    sizes = [len(r.content) for r in sorted(parts, key=lambda r: r.part_no) if r.d == "d"]
    assert 3 <= len(sizes) <= 5 and max(sizes) <= 2048 + 3001
    assert [len(r.content) <= 4096 for r in parts if r.d == "e"] == [True] * 3


def test_one_line_above_the_limit_is_one_part(spark):
    lines = spark.createDataFrame([("d", 5, "x" * 90)], "d string, ord long, text string")
    parts = assemble(lines, ["d"], header="H", footer="F", part_bytes=10).collect()
    assert [(r.whole, r.content) for r in parts] == [(True, "H" + "x" * 90 + "F")]


def test_merge_keeps_rows_of_a_group_out_of_single_tasks(spark):
    """The plan combines before every shuffle of the merge."""
    df = spark.createDataFrame([("x", 0, "t")], "e string, ord long, t string").select(
        "e", "ord", create_text(F.col("t"), F.lit("en")).alias("t")
    )
    plan = merge_bilingual(df, ["e"], "ord", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
