"""Golden values of keys, cleaning and components."""

import pytest
from pyspark.sql import functions as F

from termloom.functions import complexity as cx
from termloom.functions import components as cp
from termloom.functions import text as tx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int").select(column.alias("v")).first()["v"]


def test_request_key(spark):
    k = lambda en: one(spark, tx.request_key(F.col("ds"), F.col("ec"), F.col("en"), F.col("mc")), ds="TEST_SYS", ec="test_code", en=en, mc="CT")
    assert k("  CT   Chest ") == "18d2114aaa2343a3f7e5c3f3b678ac9bb3515e5c52757a5463464780cb7e1045"
    assert k("Invalid Exam") == "a896351037d3b9b1c0ae856e7bed653e9a9243459a65045b649409dc85688ebe"
    api = tx.legacy_key("api", F.lit("BBMA"), F.lit("BR Bilateral Mammogram"), F.lit("Central-Philips"), F.lit("MG Mammogram Both"))
    assert one(spark, api) == "d6639b7fa0f443ff3666992732790dd603afea8d5ac4d6d4ec50c16fbec7a887"


def test_preimage(spark):
    none = F.lit(None).cast("string")
    assert one(spark, tx.preimage(none, none, F.lit("CT CHEST"), none)) == "v1|ds:|ec:|en:ct chest|mc:"
    assert one(spark, tx.preimage(F.lit("a|b"), none, F.lit("x"), none)) == "v1|ds:a%7Cb|ec:|en:x|mc:"


@pytest.mark.parametrize(("text", "clean"), [
    ("CT HEAD C-", "CT HEAD without contrast"), ("Chest (Mobile)", "Chest"), ("MR MRI Knee - NO REPORT", "MRI Knee"), ("PET/CT 18F-FDG WB Scan", "PET CT 18F-FDG WB"),
    ("US Pelvis - Female", "US Pelvis Female"), ("3rd trimester & hip", "Third trimester hip"), (None, ""),
])
def test_preprocess(spark, text, clean):
    assert one(spark, tx.preprocess(F.col("t")), t=text) == clean


def test_long_dictionary_equals_short(spark):
    rules = {f"AB{i}": f"word {i}" for i in range(60)}
    t = F.lit("AB7 and ab59, AB5 AB77")
    few = tx.expand_terms(t, {k: rules[k] for k in ("AB7", "AB59", "AB5")}, {})
    assert one(spark, tx.expand_terms(t, rules, {})) == one(spark, few) == "word 7 and word 59, word 5 AB77"


def test_poly_hash(spark):
    assert int(one(spark, tx.poly_hash(F.lit("abc"))), 36) == 96354
    assert one(spark, tx.poly_hash(F.lit(None).cast("string"))) == "0"


def test_nfc(spark):
    assert one(spark, tx.norm_field(F.lit("  CAFÉ  X "), unicode=True)) == "café x"


def test_components(spark):
    c = one(spark, cp.components(F.col("t"), F.col("m")), t="PET/CT chest with contrast left and right", m="Other")
    assert (c.modality, c.anatomy, c.laterality, c.contrast) == (["CT", "NM"], ["chest"], "bilateral", ["with"])
    assert one(spark, cp.components(F.col("t"), F.col("m")), t="Knee right", m="XR").modality == ["XR"]


def test_insertion_with_a_line_is_vascular(spark):
    assert "Non-Vascular Interventional" in one(spark, cp.techniques(F.lit("insertion of marker")))
    assert "Non-Vascular Interventional" not in one(spark, cp.techniques(F.lit("insertion of picc")))


def test_complexity_is_bounded(spark):
    t = "computed tomography angiography with and without contrast of lower-limb arteries using guided, dynamic technique"
    for f in (cx.structural, cx.terminology, cx.qualifier, cx.total_complexity):
        assert 0 <= one(spark, f(F.lit(t))) <= 1
    assert one(spark, cx.qualifier(F.lit("CT Head"))) < cx.SIMPLE_INPUT + 0.01
