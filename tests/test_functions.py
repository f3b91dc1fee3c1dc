"""Column functions on literal rows, with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from formspark.functions import parse as P
from formspark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [("|RVJ1234567|", "RVJ1234567"), ("rvj 12345b7", "RVJ1234587"), ("RVJ297066", "RVJ0297066"), ("8VJ1O34567", "BVJ1034567"), ("AB1", "AB1"), (None, ""),
     ("RVJ12345678", "RVJ1234567"), ("", "")],
)
def test_fix_id(spark, raw, want):
    assert one(spark, raw, T.fix_id) == want


def test_fix_id_with_prefixes(spark):
    prefixes = F.create_map(F.lit("VJ"), F.lit("RVJ"))
    assert one(spark, "VJ2345678", lambda c: T.fix_id(c, prefixes)) == "RVJ2345678"
    assert one(spark, "XJ2345678", lambda c: T.fix_id(c, prefixes)) == "XJ2345678"


@pytest.mark.parametrize(
    "raw, want",
    [("2/1999)", "2/1999"), ("(3/4581-H", "3/4581-H"), ("S8", "58"), ("C 92", "C 92"), ("§4A", "54A"), ("12345", ""), ("°12", "12"), ("º12", "012"), ("~", ""), (None, ""),
     ("83©", "83C"), ("l7", "l7"), ("12™", "12TM")],
)
def test_clean_house(spark, raw, want):
    assert one(spark, raw, T.clean_house) == want


@pytest.mark.parametrize("raw, want", [("Name: José -", "Jose"), ("  A.  B' ", "A. B"), ("x1²y", "xy"), (None, ""), ("Nane|Ravi", "Ravi")])
def test_clean_name(spark, raw, want):
    assert one(spark, raw, T.clean_name) == want


@pytest.mark.parametrize("raw, want", [("Fatner", "Father"), ("falher", "Father"), ("husb", "Husband"), ("MOTHER", "Mother"), ("othor", "Othor"), (None, "")])
def test_relation(spark, raw, want):
    assert one(spark, raw, T.relation_type) == want


@pytest.mark.parametrize("raw, want", [("பெயர் : ஆஷா ab ராணி -", "ஆஷா ராணி"), ("28 பாலினம் : ஆண்", ""), ("abc", ""), (None, "")])
def test_clean_second_script(spark, raw, want):
    assert one(spark, raw, T.clean_second_script) == want


def test_second_script_names(spark):
    assert one(spark, "ஆஷா", T.is_second_script_name) is True
    assert one(spark, "பெண்", T.is_second_script_name) is False
    assert one(spark, None, T.is_second_script_name) is False
    assert one(spark, "12", T.is_contaminated) is True


@pytest.mark.parametrize("spec, want", [("101", [(101, 101)]), ("50-100", [(50, 100)]), ("1,5,10-20", [(1, 1), (5, 5), (10, 20)]), ("9-3", []), ("", [])])
def test_ranges(spec, want):
    assert T.parse_ranges(spec) == want


def test_bad_range():
    with pytest.raises(ValueError):
        T.parse_ranges("1,x")


def test_parse_cell(spark):
    text = "|12 rvj\nRVJ0000012\nName : Asha -\nFather\nName: Ravi\nHouse Number : 12 Saras Street\nAge : 17 Gender : Female\n45"
    r = one(spark, text, P.parse_first_language)
    assert r.asDict() == {
        "serial_no": "12", "epic_id": "RVJ0000012", "name_english": "Asha", "relation_name_english": "er", "relation_type": "Father", "house_no": "12",
        "age": "45", "gender": "Female",
    }
    assert set(one(spark, None, P.parse_first_language)) == {""}
    assert set(one(spark, "Photo\n Available ", P.parse_first_language)) == {""}


def test_parse_second_cell(spark):
    r = one(spark, "= 7\nபெயர் : ஆஷா ராணி\nகணவரின் பெயர் : ரவி குமார்", P.parse_second_language)
    assert tuple(r) == ("7", "ஆஷா ராணி", "ரவி குமார்")
    assert tuple(one(spark, "7\nx : ஆஷா ராணி\ny : ரவி குமார்", P.parse_second_language)) == ("7", "ஆஷா ராணி", "ரவி குமார்")
    assert tuple(one(spark, None, P.parse_second_language)) == ("", "", "")
    assert tuple(one(spark, "5", P.parse_second_language)) == ("5", "", "")
