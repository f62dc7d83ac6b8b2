"""Scoring and naming against plain Python over values typed anew here, not taken from the library."""

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.operators import scoring as sc

STOP = set("a an the and or with without for of in on to ct mr mri us xr x-ray nm pet scan imaging procedure examination study left right bilateral contrast view".split())
ANATOMICAL = {"artery", "vein", "vessel", "aorta", "carotid", "coronary", "pulmonary", "renal", "lobe", "segment", "vertebra", "disc"}
ADMINISTRATIVE = {"procedure", "examination", "study", "scan", "imaging", "view", "projection"}
TECHNIQUE = {"doppler", "angiography", "venography", "arteriography", "perfusion", "diffusion", "spectroscopy", "elastography"}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize(("text", "cat"), [
    ("knee", "CT Left Knee with contrast"), ("CT chest", "CT pulmonary artery angiography procedure"), ("head", "unknown words of the renal doppler scan view"), ("a b", "a b"),
])
def test_specificity(spark, text, cat):
    extra = set(cat.lower().split()) - set(text.lower().split())
    rest = extra - ANATOMICAL - ADMINISTRATIVE - TECHNIQUE - STOP
    expected = 0.10 * len(extra & ANATOMICAL) + 0.05 * len(extra & TECHNIQUE) - 0.20 * len(extra & ADMINISTRATIVE) - 0.15 * len(rest)
    assert value(spark, sc.specificity_score(F.lit(text), F.lit(cat))) == pytest.approx(expected)


@pytest.mark.parametrize(("text", "modality", "expected"), [
    ("lung biopsy", "CT", 0.60), ("Pulmonary Bx", "US", 0.25), ("thoracic biopsy", "Fluoroscopy", -0.45), ("hepatic biopsy", "CT", 0.40), ("renal biopsy", "US", 0.60), ("thyroid biopsy", "US", 0.45),
    ("bone biopsy", "IR", 0.10), ("vertebral biopsy", "CT", 0.35), ("prostate biopsy", "MRI", 0.30), ("skin biopsy", "CT", 0.25), ("skin biopsy", "MRI", 0.0), ("CT lung biopsy", "CT", 0.0), ("lung", "CT", 0.0), ("lung biopsy", "XR", 0.0),
])
def test_biopsy(spark, text, modality, expected):
    assert value(spark, sc.biopsy_preference(F.lit(text), lit(modality))) == pytest.approx(expected)


@pytest.mark.parametrize(("a", "b", "expected"), [
    ("CT", "HRCT", 0.9), ("CT", "PET", 0.4), ("MR", "MRI", 1.0), ("MRI", "CT", 0.0), ("XR", "DEXA", 0.9), ("DEXA", "XR", 0.2), ("PET/MRI", "MR", 0.6), ("FL", "Fluoroscopy", 1.0), ("US", "CT", 0.0), ("CT", "CT", 1.0),
])
def test_modality(spark, a, b, expected):
    assert value(spark, sc.modality_score(lit(a), lit(b))) == pytest.approx(expected)


@pytest.mark.parametrize(("gender", "age", "cat", "expected"), [
    ("female", None, "Mammography screening", 0.20), ("female", None, "Gynae pelvis", 0.20), ("female", None, "ovary", 0.0), ("male", None, "Scrotal US", 0.20), ("male", None, "testicle", 0.0), ("male", None, "Female pelvis", 0.20),
    ("pregnancy", None, "fetal scan", 0.25), (None, "paediatric", "Child chest", 0.15), ("female", "paediatric", "infant breast", 0.35),
])
def test_demographics(spark, gender, age, cat, expected):
    assert value(spark, sc.demographic_bonus(F.lit(gender), F.lit(age), F.lit(cat))) == pytest.approx(expected)


@pytest.mark.parametrize(("cat", "text", "blocked"), [
    ("MRI diffusion tensor", "MRI brain", True), ("MRI diffusion tensor", "MRI DTI", False), ("fMRI brain", "BOLD study", False), ("MR spectroscopy", "MRS head", True), ("MR spectroscopy", "spectroscopy", False), ("CT colonography", "CT abdomen", True),
    ("CT colonography", "virtual colonoscopy", False), ("SPECT bone", "bone", True), ("HRCT chest", "high resolution chest", False), ("CT head", "CT head", False),
])
def test_specialised_techniques(spark, cat, text, blocked):
    assert value(spark, sc.technique_penalty(F.lit(text), F.lit(cat), enabled=True)) == (-10.0 if blocked else 0.0)
    assert value(spark, sc.technique_penalty(F.lit(text), F.lit(cat))) == 0.0


@pytest.mark.parametrize(("text", "fsn", "expected"), [
    ("CT angiogram", "Computed tomography of artery and vein", 0.20), ("MRA neck", "Imaging of veins", -0.15), ("CTV head angio", "artery", 0.0), ("phlebogram angio", "artery", 0.0), ("angiography", "carotid", 0.0), ("CT", "artery", 0.0),
])
def test_vessels(spark, text, fsn, expected):
    assert value(spark, sc.vessel_preference(F.lit(text), F.lit(fsn))) == pytest.approx(expected)


@pytest.mark.parametrize(("model", "component", "rerank"), [
    ("medcpt", 0.65, 0.35), ("biolord", 0.60, 0.40), ("default", 0.60, 0.40), ("gpt-4o-mini", 0.45, 0.55), ("claude-3-haiku", 0.50, 0.50), ("gemini-2.5-flash-lite", 0.48, 0.52), ("anything else", 0.65, 0.35),
])
def test_model_weights(spark, model, component, rerank):
    d = spark.createDataFrame([(1, p, True, 0.4, 0.9) for p in (0, 1, 2)], "row_id int, cand_pos int, in_simple boolean, component double, rerank double").withColumns({"in_contrast": lit(), "cat_contrast": lit()})
    got = {r.cand_pos: r.final for r in sc.final_score(d, F.lit(model)).collect()}
    bonus = [0.0] * 3 if model[:3] in ("gpt", "cla", "gem") else [0.03, 0.027, 0.024]
    assert [got[p] for p in (0, 1, 2)] == pytest.approx([component * 0.4 + rerank * 0.9 + b for b in bonus])


@pytest.mark.parametrize(("entry", "parsed", "asked", "unsure", "peer"), [
    ("left", None, None, True, True), ("bilateral", None, None, True, True), (None, "right", None, True, True), (None, "bilateral", None, True, True), (None, None, None, False, False), ("other", "left", None, False, False),
    ("left", "left", "bilateral", False, True), ("bilateral", None, "bilateral", False, False), (None, "bilateral", "bilateral", False, True), ("left", "left", "left", False, False),
])
def test_sides(spark, entry, parsed, asked, unsure, peer):
    sides = [F.lit(x).cast("string") for x in (entry, parsed, asked)]
    assert (value(spark, sc.laterality_ambiguous(*sides)), value(spark, sc.needs_peer(*sides))) == (unsure, peer)


@pytest.mark.parametrize(("text", "expected"), [("Liver biopsy", True), ("bx liver", True), ("US liver biopsy", False), ("biopsy under fluoroscopy", False), ("liver", False)])
def test_ambiguous_biopsies(spark, text, expected):
    assert value(spark, sc.biopsy_ambiguous(F.lit(text))) == expected


def test_peers_are_the_first_candidates(spark):
    rows = [(1, 10, 5, "s", "left", None, 0), (1, 11, 5, "s", None, None, 3), (1, 12, 5, "s", "bilateral", "left", 2), (1, 13, 5, "s", "other", "bilateral", 1), (1, 14, 6, "s", "bilateral", None, 1), (1, 15, 5, "t", "bilateral", None, 1)]
    c = spark.createDataFrame(rows, "row_id int, entry_id int, concept_id int, sig string, entry_side string, laterality string, cand_pos int")
    assert [(r.entry_id, r.peer_id) for r in sc.peers_in_candidates(c.filter("entry_id = 10"), c).collect()] == [(10, 12)]


@pytest.mark.parametrize(("text", "expected"), [
    ("cta right hand at rest bilateral dxa (ct)", "CTA Right Hand at Rest Both DXA (CT)"), ("lt knee, both views BY hrct", "Left Knee, Both Views by HRCT"), ("the picc of lt. arm", "The PICC of Left Arm"), ("mri-head from above", "Mri-head from above"),
])
def test_title_case(spark, text, expected):
    assert value(spark, tx.title_case(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "expected"), [
    ('{"choice":"a","m":{"k":1},"confidence":0.9}', ("a", 0.9)), ('Sure: {"choice": "x } y", "confidence": 0.5} and {more}', ("x } y", 0.5)), ('{"choice": "b"}', ("b", 0.0)), ("none", (None, 0.0)), ('{"choice": "c"', (None, 0.0)),
    ('{"choice":"q \\" { z","confidence":1}', ('q " { z', 1.0)), (None, (None, 0.0)),
])
def test_choices(spark, text, expected):
    assert tuple(value(spark, tx.parse_choice(F.lit(text).cast("string")))) == expected


def test_input_key(spark):
    import hashlib
    import json

    fields = {"b": 'x "quoted"', "a": None, "c": "é"}
    got = value(spark, tx.input_key({k: F.lit(v).cast("string") for k, v in fields.items()}))
    assert got == hashlib.md5(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@pytest.mark.parametrize(("text", "cat", "base", "bonus", "violation", "component"), [
    # 0.25 + 0.35 + 0.10 + 0.20 * 1.25 + 0.10, and 0.25 for the exact name
    ("CT chest", "CT chest", 1.05, 0.25, None, 1.0),
    # artery 0.10 (and a technique, which the input lacks: 0.10 less), projection -0.20; scan and imaging are stop words
    ("CT chest", "CT chest artery projection scan imaging", 0.95, -0.10, None, 0.85),
    # prenatal is not in this scorer's list, obstetric is: 0.25; both names are of one level: 0.15
    ("US obstetric knee", "US prenatal knee", 1.05, 0.15, None, 1.0), ("US pregnancy knee", "US obstetric knee", 1.05, 0.40, None, 1.0),
    # fluoroscopy isn't an explicit modality here: lung biopsies prefer CT by 0.60; both are interventional, 0.15
    ("fluoroscopy biopsy lung", "CT biopsy lung", None, None, "modality", 0.0),
    # no context rules: an emergency on one side costs nothing
    ("CT chest emergency", "CT chest", 1.05, 0.0, None, 1.0),
    # laterality has no minimum; 0.10 * 0.1
    ("CT left knee", "CT right knee", 0.96, 0.0, None, 0.96),
    ("XR chest standard", "XR chest guided biopsy", None, None, "blocking", 0.0), ("CT knee", "CT head", None, None, "anatomy", 0.0),
])
def test_the_consolidated_scorer(spark, text, cat, base, bonus, violation, component):
    from termloom.functions import components as cp

    t, c = F.lit(text), F.lit(cat)
    row = spark.range(1).select(t.alias("in_text"), c.alias("cat_text"), F.concat(c, F.lit(" (procedure)")).alias("cat_fsn"), cp.components(t, F.lit("OTHER")).alias("i"), cp.components(c, F.lit("OTHER")).alias("e"))
    row = row.select("in_text", "cat_text", "cat_fsn", *[F.col(f"{s}.{n}").alias(f"{p}_{n}") for s, p in (("i", "in"), ("e", "cat")) for n in ("modality", "anatomy", "laterality", "contrast", "technique")])
    row = row.withColumns({"in_gender": cp.gender_context(F.col("in_text"), F.col("in_anatomy")), "in_age": cp.age_context(F.col("in_text"))})
    got = sc.scored(row, {}, "consolidated").first()
    assert got.breakdown.violation == violation and got.component == pytest.approx(component)
    if violation is None:
        assert got.breakdown.parts.base_score == pytest.approx(base) and got.breakdown.parts.bonuses_penalties == pytest.approx(bonus)


def test_the_consolidated_final(spark):
    assert value(spark, sc.final_consolidated(F.lit(0.8), F.lit(0.5), F.lit(0.6))) == pytest.approx(0.65 * 0.8 + 0.35 * 0.5 * 0.6)
