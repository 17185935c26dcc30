"""Names: what is stripped, what a bracket means, and which spellings are one."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwire.functions import names
from loomwire.operators.entities import mention_groups
from loomwire.operators.graph import components


@pytest.fixture(scope="module")
def parse(spark):
    def of(raw):
        return spark.createDataFrame([(raw,)], "raw string").select(names.composed("raw").alias("raw")).select(names.parsed(F.col("raw")).alias("p")).first()["p"]

    return of


def test_role_clause_goes(parse):
    p = parse("นายอนุทิน ชาญวีรกูล, นายกรัฐมนตรี")
    assert (p["head"], p["strong"]) == ("อนุทินชาญวีรกูล", [])


def test_brackets(parse):
    assert parse("กรมสอบสวนคดีพิเศษ (DSI)")["strong"] == ["dsi"]
    assert parse("กระทรวงการคลัง (สิงคโปร์)")["qualifiers"] == ["สิงคโปร์"]
    assert parse("United States (สหรัฐอเมริกา)")["strong"] == ["สหรัฐอเมริกา"]
    assert parse("สมชาย ใจดี (Minister of Education)")["strong"] == []
    assert parse("ชาย (อายุ 50 ปี)")["strong"] == []
    assert parse("Dr. Ann Lee")["head"] == "annlee"


@pytest.mark.parametrize("word", names.NO_NAMES)
def test_words_that_are_no_names_are_dropped(parse, word):
    p = parse(f"สมหญิง รักดี ({word})")
    assert (p["head"], p["strong"], p["weak"], p["qualifiers"]) == ("สมหญิงรักดี", [], [], [word])


def test_measures_in_thai_digits(parse):
    for measure in ("๕๐ ปี", "อายุ ๕๐", "30 คน", "ไม่ต่ำกว่า 15 คน"):
        assert parse(f"ชาย ({measure})")["weak"] == []


def test_commas_inside_brackets_part_nothing(parse):
    assert parse("full name, (Deputy Minister, Finance)")["head"] == "fullname"
    assert parse("Body (one, two), ประธาน")["weak"] == ["onetwo"]
    assert parse("one (two, Minister")["head"] == "one(twominister"


def test_any_number_of_role_clauses(parse):
    assert parse("Ann Lee, chief, deputy, former head of office, director, adviser")["head"] == "annlee"
    # a clause that is no role keeps what stands before it
    assert parse("Ann Lee, Minister, Ltd.")["head"] == "annleeministerltd."
    assert parse("ประธาน, ปลัด")["head"] == "ประธาน"


def test_decomposed_text_is_the_same_name(parse):
    assert parse(unicodedata.normalize("NFD", "José Díaz")) == parse("José Díaz")
    assert parse("José Díaz")["head"] == "josédíaz"


SAME = [
    ["Marta Ruiz", "Marta Ruiz (มาร์ตา รุยซ์)", "มาร์ตา รุยซ์ (Marta Ruiz)"],
    ["กรมชลประทาน (RID)", "RID", "RID (อาร์ไอดี)"],
    ["พรรคก้าวใหม่", "พรรคก้าวใหม่ (New Step Party)", "พรรคก้าวใหม่ (กม.)"],
    ["ญี่ปุ่น", "ญี่ปุ่น (Japan)"],
    ["สหราชอาณาจักร (UK)", "อังกฤษ (UK)"],
]
DIFFERENT = [
    ["กระทรวงพลังงาน", "กระทรวงพลังงาน (ญี่ปุ่น)"],
    ["สมชาย ดีงาม (รองอธิบดี)", "สมศรี ใจงาม (รองอธิบดี)"],
    ["นายสมชาย (ผู้เสียชีวิต)", "นายสมศักดิ์ (ผู้เสียชีวิต)"],
    ["ชาย (มือปืน)", "หญิง (มือปืน)"],
    ["กระทรวงพลังงาน (ญี่ปุ่น)", "กระทรวงแรงงาน (ญี่ปุ่น)"],
]


def test_spellings_of_one_thing_and_of_several(spark):
    rows = [(i, raw) for i, spellings in enumerate([*SAME, *DIFFERENT]) for raw in spellings]
    groups = {}
    for r in mention_groups(spark.createDataFrame(rows, "event_id long, raw string")).collect():
        groups.setdefault(r["event_id"], []).append(r["members"])
    for i, spellings in enumerate([*SAME, *DIFFERENT]):
        assert len(groups[i]) == (1 if i < len(SAME) else len(spellings)), spellings


def test_groups(spark):
    rows = [(1, "นายอนุทิน ชาญวีรกูล"), (1, "อนุทิน ชาญวีรกูล (Anutin Charnvirakul)"), (1, "Anutin Charnvirakul"), (1, "กระทรวงการคลัง"), (1, "กระทรวงการคลัง (สิงคโปร์)"), (2, "Anutin Charnvirakul")]
    got = {(r["event_id"], tuple(r["members"])): (r["name"], r["risky"]) for r in mention_groups(spark.createDataFrame(rows, "event_id long, raw string")).collect()}
    assert len(got) == 4
    assert got[1, ("Anutin Charnvirakul", "นายอนุทิน ชาญวีรกูล", "อนุทิน ชาญวีรกูล (Anutin Charnvirakul)")] == ("อนุทิน ชาญวีรกูล", True)
    assert got[1, ("กระทรวงการคลัง",)] == ("กระทรวงการคลัง", False)


def test_components_of_a_chain(spark):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 101)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
