"""Problem 1."""

import unicodedata

import pytest

from corpusforge.llm.canonical import TWINS, canonical_text

CASES = [
    ("á", "á"), ("ǫ́", "ǫ́"), ("Mel​ra­﻿k⁠‎", "Melrak"), ("a b c d　e", "a b c d e"),
    ("ｋａｌｄａ１２", "kalda12"), ("yﬁr ﬆod", "yfir stod"), ("ﬅ", "ſt"), ("rаndlаug", "randlaug"), ("Ϸórfіnnr", "Þórfinnr"), ("шлюxa", "шлюха"), ("λόγoς", "λόγος"),
    ("Kldafjall", "Kldafjall"), ("Ϸо́rgautr", "Þórgautr"), ("strο̈nd", "strönd"), ("АΜ", "AM"), ("Ⅷ ①", "VIII 1"), ("ﬓ", "մն"), ("ﻻ ﷺ", "لا صلى الله عليه وسلم"), ("㎏ ℌ Ⓐ", "kg H A"), ("ﬡ", "א"), ("р​аx", "pax"),
]
SAME = ["½ ⑴ № ™", "ſ ꝛ ꜵ m\u0304 ǫ\u0301", "Хольмъ скаръ", "Βαράγγοι", "！？（）、。「」", "“„«»” – — …", "ᚠᚢᚦ", "पे\u0921\u093c", "\t\n\r", "q\u0323", "", "Ostrings мерзавец"]


@pytest.mark.parametrize("at", range(1))
def test_cases(spark, at):
    rows = [(i, a, "x") for i, (a, _) in enumerate(CASES)] + [(100 + i, a, "x") for i, a in enumerate(SAME)] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "id int, text string, changed string")
    got = {r["id"]: (r["canonical"], r["changed"]) for r in canonical_text(df).collect()}
    for i, (a, want) in enumerate(CASES):
        assert got[i] == (want, True), (a, got[i])
    for i, a in enumerate(SAME):
        assert got[100 + i] == (a, False), a
    assert got[900] == (None, False)
    again = canonical_text(spark.createDataFrame([(i, v[0]) for i, v in got.items()], "id int, text string"))
    assert again.where("changed").count() == 0


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "rаn" * 200_000), (1, "rаn")], "id int, text string")
    assert [len(r["canonical"]) for r in canonical_text(df).collect()] == [600_000, 3]
    assert canonical_text(df.limit(0)).count() == 0


def test_twins_are_of_their_scripts():
    for row in (x.split() for line in TWINS.split("\n") for x in line.split("|") if x.strip()):
        for c, script in zip(row, ("LATIN", "CYRILLIC", "GREEK")):
            assert c == "-" or c == "ў" or unicodedata.name(c).startswith(script), row
