"""Component extraction: exam name to arrays of canonical terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escaped

#: Modality codes and patterns, in order of priority.
MODALITY_CODES = {"CT": "CT", "MR": "MRI", "MRI": "MRI", "XR": "XR", "US": "US", "NM": "NM", "PET": "NM", "MG": "MG", "MAMM": "MG", "MAMMO": "MG", "DEXA": "DEXA", "FL": "Fluoroscopy", "IR": "IR", "XA": "IR", "BR": "MG"}
MODALITY_PATTERNS = (
    ("NM", r"\b(pet[/\- ]?ct|spect[/\- ]?ct)\b"), ("CT", r"\b(pet[/\- ]?ct|spect[/\- ]?ct)\b"), ("NM", r"\b(pet[/\- ]?mr|spect[/\- ]?mr)\b"), ("MRI", r"\b(pet[/\- ]?mr|spect[/\- ]?mr)\b"),
    ("IR", r"\b(x-ray angiography|biopsy|drainage|stent|intervention|picc|insert)\b"),
    ("Fluoroscopy", r"\b(fl|fluoroscopy|barium|swallow|meal|enema|videofluoroscopy|image intensifier)\b"),
    ("DEXA", r"\b(dexa|dxa|bone densitometry)\b"), ("MRI", r"\b(mr|mri|mra|magnetic resonance)\b"), ("MG", r"\b(mg|mammo|mamm|mammography|tomosynthesis)\b"),
    ("US", r"\b(us|ultrasound|sonogram|doppler|duplex)\b"), ("NM", r"\b(nm|nuclear medicine|spect|scintigraphy|pet|v/q|mag3|renogram)\b"),
    ("CT", r"\b(ct|computed tomography)\b"), ("XR", r"\b(xr|x-ray|xray|radiograph|plain film)\b"),
)
#: Technique labels and their patterns (any of them).
TECHNIQUES = {
    "MRCP": (r"\b(mrcp|magnetic resonance cholangiopancreatography|cholangiopancreatography)\b",),
    "HRCT": (r"\b(hrct|high resolution)\b",),
    "Colonography": (r"\b(colonography|virtual colonoscopy)\b",),
    "Doppler": (r"\b(doppler|duplex)\b",),
    "Tomosynthesis": (r"\b(tomosynthesis|tomo)\b",),
    "Fluoroscopic GI/Swallow Study": (r"\b(barium|upper gi|lower gi|swallow|meal|enema|videofluoroscopy)\b",),
    "SPECT": (r"\b(spect|single photon)\b",),
    "V/Q Scan": (r"\b(v/q|ventilation perfusion)\b",),
    "Diagnostic Angiography": (r"\b(angiogram|angiography|arteriogram|arteriography|angio|dsa)\b",),
    "Arterial Interventional": (r"\b(stent|angioplasty|emboli[sz]ation|thrombolysis|thrombectomy|atherectomy)\b", r"\b(arterial|artery|aortic|aorta|carotid|femoral artery|renal artery)\b"),
    "Venous Interventional": (r"\b(venography|venogram|phlebography)\b", r"\b(picc|line|catheter|port|hickman|tunneled)\b", r"\b(venous|vein|vena cava|jugular|subclavian|femoral vein)\b", r"\b(ivc filter|vena cava filter|thrombolysis venous)\b"),
    "Non-Vascular Interventional": (r"\b(biopsy|bx|fna|drainage|aspirat|injection|vertebroplasty|ablation|guided|guidance|placement|locali[sz]ation|nephrostomy|tube)\b", r"\b(?!.*\b(?:picc|line|catheter)\b)(insertion|insert)\b"),
    "18F-FDG PET": (r"\b(fdg|18f.?fdg|f.?18.?fdg|fluorodeoxyglucose|18f.?fluorodeoxyglucose|fludeoxyglucose)\b",),
    "18F-PSMA PET": (r"\b(psma|18f.?psma|f.?18.?psma|prostate.?specific.?membrane.?antigen)\b", r"\b(18f.?dcfpyl|dcfpyl|18f.?pyl|pyl)\b"),
    "Gallium-68 PET": (r"\b(ga.?68|gallium.?68|68.?ga|68.?gallium)\b", r"\b(ga.?68.?dotatate|dotatate|ga.?68.?dotanoc|dotanoc|ga.?68.?dotatoc|dotatoc)\b", r"\b(ga.?68.?psma|68.?ga.?psma)\b"),
}
#: Words of patient and clinical context.
PREGNANCY = r"\b(obstetric|pregnancy|prenatal)\b|\b(fetal|fetus)\b|\b(trimester)\b"
FEMALE_TERMS = ("female pelvis", "uterus", "ovary", "ovaries", "endometrial", "cervix", "cervical screening", "cervical smear", "mammogram", "mammography", "breast", "breasts", "transvaginal")
FEMALE = r"\b(female)\b|\b(woman|women)\b|\b(gynae|gynecological|gynaecological)\b"
MALE_TERMS = ("prostate", "testicular", "scrotal", "scrotum", "testes", "testicle", "testicles", "penis", "penile")
MALE = r"\b(male)\b|\b(men)\b"
PAEDIATRIC = r"\b(paediatric|pediatric|paed|peds)\b|\b(child|children|infant|infants|baby|babies)\b|\b(newborn|neonate|neonatal)\b|\b(toddler|adolescent|juvenile)\b|\b(cdh|congenital)\b|\b(hip dysplasia|hips screening)\b|\b(developmental)\b"
ADULT = r"\b(adult)\b"
CLINICAL = {
    "diagnostic": r"\b(standard|routine|plain|simple|diagnostic|baseline|non-contrast)\b",
    "emergency": r"\b(emergency|urgent|stat|trauma|acute)\b",
    "follow-up": r"\b(follow.?up|post.?op|fu)\b",
    "intervention": r"\b(biopsy|drainage|injection|aspiration|fna|guided|guidance|insertion|placement|line|picc)\b",
    "screening": r"\b(screening|surveillance)\b",
}
INTERVENTIONS = ("biopsy", "drainage", "injection", "aspiration", "guided", "picc", "line")
#: Fixed values of the weak labels.
LABEL_MODALITIES = {"CT": "Computed Tomography", "MR": "Magnetic Resonance", "XR": "X-Ray", "US": "Ultrasound", "NM": "Nuclear Medicine"}
LABEL_ANATOMY = ("Head", "Brain", "Chest", "Abdomen", "Pelvis", "Spine", "Heart", "Lung", "Liver", "Kidney", "Shoulder", "Knee", "Hip", "Ankle", "Wrist", "Hand", "Foot", "Neck", "Femur", "Humerus", "Tibia", "Fibula", "Radius", "Ulna")
#: A default vocabulary; real ones come as a parameter.
VOCABULARY = {"chest": "chest", "thorax": "chest", "abdomen pelvis": "abdomen pelvis", "abdomen": "abdomen", "pelvis": "pelvis", "head": "head", "brain": "head", "knee": "knee", "shoulder": "shoulder", "lumbar spine": "lumbar spine", "spine": "spine", "liver": "liver", "kidney": "kidney", "breast": "breast", "prostate": "prostate", "lung": "lung", "hip": "hip", "carotid artery": "carotid", "carotid": "carotid"}


def tags(pairs) -> Column:
    """The labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for label, condition in pairs]))


def modalities(name: Column, code: Column) -> Column:
    """The source's code wins if it is known and not "Other"; else every pattern that fits, sorted."""
    low = F.lower(name)
    known = F.create_map(*[F.lit(x) for kv in MODALITY_CODES.items() for x in kv])[F.upper(code)]
    found = F.array_sort(F.array_distinct(tags((m, low.rlike(p)) for m, p in MODALITY_PATTERNS)))
    return F.when((F.upper(code) != "OTHER") & known.isNotNull(), F.array(known)).otherwise(found)


def extract_vocab(name: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """All non-overlapping hits, longest terms first, as sorted distinct canonical terms."""
    vocabulary = {k.lower(): v.lower() for k, v in (vocabulary or VOCABULARY).items()}
    keys = sorted(vocabulary, key=lambda k: -len(k))
    pattern = r"\b(" + "|".join(escaped(k) for k in keys) + r")\b"
    canonical = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(name), F.lit(pattern), 1), lambda t: canonical[t])))


def laterality(name: Column) -> Column:
    low = F.lower(name)
    left, right = low.rlike(r"\bleft\b"), low.rlike(r"\bright\b")
    return F.when(low.rlike(r"\bbilateral\b") | (left & right), "bilateral").when(left, "left").when(right, "right")


def contrast(name: Column) -> Column:
    low = F.lower(name)
    return tags((("with", low.rlike(r"\bwith contrast\b")), ("without", low.rlike(r"\bwithout contrast\b"))))


def techniques(name: Column) -> Column:
    low = F.lower(name)
    return F.array_sort(tags((label, low.rlike("|".join(patterns))) for label, patterns in TECHNIQUES.items()))


def build_name(modality: Column, technique: Column, anatomy: Column, side: Column) -> Column:
    short = F.when(side == "left", "Lt").when(side == "right", "Rt").when(side == "bilateral", "Both")
    return F.concat_ws(
        " ",
        F.when(F.size(modality) > 0, F.array_join(F.array_sort(F.array_distinct(modality)), "+")).otherwise("Unknown"),
        F.when(F.array_contains(technique, "Diagnostic Angiography"), "Angiogram"),
        F.when(F.size(anatomy) > 0, F.array_join(F.array_sort(F.array_distinct(anatomy)), " ")),
        short,
    )


def components(name: Column, code: Column, vocabulary=None) -> Column:
    return F.struct(
        modalities(name, code).alias("modality"), extract_vocab(name, vocabulary).alias("anatomy"), laterality(name).alias("laterality"), contrast(name).alias("contrast"), techniques(name).alias("technique")
    )


def any_of(low: Column, terms, anatomy: Column | None = None) -> Column:
    out = None
    for t in terms:
        one = low.contains(t) if anatomy is None else low.contains(t) | F.array_contains(anatomy, t)
        out = one if out is None else out | one
    return out


def gender_context(name: Column, anatomy: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(PREGNANCY), "pregnancy").when(any_of(low, FEMALE_TERMS, anatomy) | low.rlike(FEMALE), "female").when(any_of(low, MALE_TERMS, anatomy) | low.rlike(MALE), "male")


def age_context(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(PAEDIATRIC), "paediatric").when(low.rlike(ADULT), "adult")


def clinical_context(name: Column) -> Column:
    low = F.lower(name)
    return tags((c, low.rlike(p)) for c, p in CLINICAL.items())


def intervention_terms(name: Column) -> Column:
    return tags((t, F.lower(name).contains(t)) for t in INTERVENTIONS)


def weak_tags(fsn: Column, name: Column) -> Column:
    """Labels of a catalogue row from its two names; "without" is tested before "with and without", and "male" fits inside "female"."""
    low, long = F.lower(name), F.lower(fsn)
    modality = None
    for code, label in LABEL_MODALITIES.items():
        tag = F.lit(f"Modality:{label}")
        modality = F.when(name.startswith(code), tag) if modality is None else modality.when(name.startswith(code), tag)
    with_contrast = F.when(low.contains("without"), "Contrast:Without").when(low.contains("with and without"), "Contrast:WithAndWithout").otherwise("Contrast:With")
    side = F.when(low.contains("left"), "Laterality:Left").when(low.contains("right"), "Laterality:Right").when(low.contains("bilateral") | low.contains("both"), "Laterality:Bilateral")
    gender = F.when(any_of(long, ("male", "prostate")), "Gender:Male").when(any_of(long, ("female", "pregnancy", "uterus", "ovary")), "Gender:Female")
    anatomy = [F.when(low.contains(a.lower()), F.lit(f"Anatomy:{a}")) for a in LABEL_ANATOMY]
    return F.array_compact(F.array(modality, *anatomy, F.when(low.contains("contrast"), with_contrast), side, gender))
