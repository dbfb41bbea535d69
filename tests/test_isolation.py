"""A section that fails stops no other section and no other export."""

import zipfile

import pytest
from pyspark.sql import functions as F

from dossier import DOCUMENTS, SECTIONS, Section, convert
from dossier.plans import isolation
from dossier.plans.isolation import reason
from dossier.plans.layouts import table
from dossier.plans.section import derived, plain

PEOPLE = [f"p{i:02d}" for i in range(40)]


def picky():
    def read(name):
        if name in ("n07", "n23"):
            raise ValueError(f"cannot read {name}")
        return name.upper()

    return F.udf(read, "string")(F.col("cells")["Name"])


def broken():
    def read(name):
        raise RuntimeError("never works")

    return F.udf(read, "string")(F.col("cells")["Name"])


def badly_planned():
    raise KeyError("no such rule")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    for i, person in enumerate(PEOPLE):
        with zipfile.ZipFile(root / f"{person}.zip", "w") as archive:
            archive.writestr("Profile.csv", f"First Name,Last Name\nN,{person}\n")
            archive.writestr("Skills.csv", f"Name\nskill {person}\n")
            if i % 2:
                archive.writestr("Badges.csv", f"Name\nn{i:02d}\n")
    return root


def badge(key, make):
    return Section(key, ["badges"], {"name": make})


def own(key):
    return table(key, key.title(), {"Name": "name"})


def test_failing_sections_are_issues(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(isolation, "PARTS", 4)
    extra = [
        badge("picky", derived(picky)),
        badge("broken", derived(broken)),
        badge("planned", derived(badly_planned)),
        badge("unresolved", derived(lambda: F.col("no_such_column"))),
        badge("sound", plain("Name")),
    ]
    catalog = [d for d in DOCUMENTS if d.section in ("profile", "skills")]
    catalog += [own(s.key) for s in extra] + [own("unheard_of")]
    out = convert(spark, str(root), str(tmp_path / "out"), sections=[*SECTIONS, *extra], catalog=catalog)
    docs = {(r.section, r.export_id) for r in spark.read.parquet(out.documents).collect()}
    odd = set(PEOPLE[1::2])
    for section, exports in (
        ("profile", set(PEOPLE)), ("skills", set(PEOPLE)), ("sound", odd), ("picky", odd - {"p07", "p23"}),
    ):
        assert {e for s, e in docs if s == section} == exports
    assert {s for s, _ in docs} == {"profile", "skills", "sound", "picky"}
    issues = [r for r in spark.read.parquet(out.issues).collect() if r.stage == "section"]
    told = {(r.section, r.export_id): r.message for r in issues}
    assert len(told) == len(issues)
    assert told["picky", "p07"] == "ValueError: cannot read n07"
    assert told["picky", "p23"] == "ValueError: cannot read n23"
    assert told["planned", None].startswith("KeyError")
    assert "no_such_column" in told["unresolved", None]
    assert told["unheard_of", None].startswith("KeyError")
    assert told["broken", None] == "RuntimeError: never works"
    assert len(told) == 6


def test_second_run_replaces_the_first(spark, root, tmp_path):
    catalog = [d for d in DOCUMENTS if d.section in ("profile", "skills")]
    for some in (catalog, catalog[:1]):
        out = convert(spark, str(root), str(tmp_path / "out"), catalog=some)
    assert {r.section for r in spark.read.parquet(out.documents).collect()} == {catalog[0].section}


def test_reason_is_one_line():
    text = "Job aborted:\nTraceback (most recent call last):\n  File x\nValueError: boom: here\n\n\tat org.x"
    assert reason(RuntimeError(text)) == "ValueError: boom: here"
    assert reason(ValueError("plain\nmore")) == "ValueError: plain"
    assert reason(ValueError()) == "ValueError: "
