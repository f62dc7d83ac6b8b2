"""Candidate scoring: every rule is a column expression over the candidate table.

Candidates have `row_id`, `cand_pos`, `in_text`, `in_*` and `cat_text`,
`cat_fsn`, `cat_*` component columns. Blocking rules come first in one CASE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rewrite_name
from .distinct import joined

#: Weights, bonuses and limits.
RULES = {
    "weights": {"anatomy": 0.25, "modality": 0.35, "laterality": 0.10, "contrast": 0.20, "technique": 0.10},
    "minimum": {"anatomy": 0.1, "modality": 0.35, "laterality": 0.0, "contrast": 0.3, "technique": 0.0, "combined": 0.25},
    "interventional": (0.15, -0.20), "exact": 0.25, "synonym": 0.15,
    "specificity": {"anatomical": 0.10, "administrative": -0.20, "technique": 0.05, "other": -0.15},
    "contrast": {"mismatch": 0.05, "null": 0.7, "prefer_none": True, "none_bonus": 0.25},
    "context": {"gender": 0.20, "age": 0.15, "pregnancy": 0.25, "clinical_penalty": -0.15},
    "generic_anatomy": (0.15, -0.05), "vessel": (0.20, -0.15), "level": (0.15, -0.10),
    "blocks": {"anatomy": -10.0, "hybrid": -6.0, "diagnostic": -8.0, "technique": -10.0},
    "final": {
        "general": (0.65, 0.35), "medcpt": (0.65, 0.35), "biolord": (0.60, 0.40), "default": (0.60, 0.40),
        "gpt-4o-mini": (0.45, 0.55), "claude-3-haiku": (0.50, 0.50), "gemini-2.5-flash-lite": (0.48, 0.52),
    },
    "position": (0.03, 0.003),
}
#: Word lists and pairs.
INCOMPATIBLE = (("breast", "penis"), ("arm", "leg"), ("upper limb", "lower limb"), ("heart", "kidney"), ("lung", "liver"), ("prostate", "breast"), ("prostate", "uterus"), ("artery", "bone"))
DIAGNOSTIC = ("standard", "routine", "screening", "plain", "simple", "without guidance", "non-contrast")
PROCEDURAL = ("biopsy", "guided", "guidance", "drainage", "injection", "insertion", "stent", "ablation", "percutaneous", "picc")
HYBRID = (
    (r"pet.*ct|pet/ct|pet-ct", r"pet.*mri|pet/mri|pet-mri|mri.*pet"),
    (r"pet.*mri|pet/mri|pet-mri", r"pet.*ct|pet/ct|pet-ct|ct.*pet"),
    (r"ct.*mri|ct/mri", r"mri.*ct|mri/ct"),
)
SPECIALISED = {
    "diffusion tensor": ("diffusion", "dti", "tensor"),
    "fmri": ("functional", "fmri", "bold"),
    "perfusion": ("perfusion", "pwi", "asl"),
    "spectroscopy": ("spectroscopy", "mrs"),
    "ct colonography": ("colonography", "virtual colonoscopy"),
    "ct angiography": ("angiography", "angio", "cta"),
    "hrct": ("high resolution", "hrct"),
    "with contrast": ("with contrast", "c+", "iv"),
    "spect": ("spect", "single photon"),
}
ANATOMICAL_WORDS = ("artery", "vein", "vessel", "aorta", "carotid", "coronary", "pulmonary", "renal", "lobe", "segment", "vertebra", "disc")
ADMIN_WORDS = ("procedure", "examination", "study", "scan", "imaging", "view", "projection")
TECHNIQUE_WORDS = ("doppler", "angiography", "venography", "arteriography", "perfusion", "diffusion", "spectroscopy", "elastography")
STOP_WORDS = (
    "a", "an", "the", "and", "or", "with", "without", "for", "of", "in", "on", "to",
    "ct", "mr", "mri", "us", "xr", "x-ray", "nm", "pet", "scan", "imaging", "procedure",
    "examination", "study", "left", "right", "bilateral", "contrast", "view",
)
BIOPSY = {
    "lung": {"ct": 0.60, "us": 0.25, "fluoroscopy": -0.50},
    "pulmonary": {"ct": 0.60, "us": 0.25, "fluoroscopy": -0.50},
    "chest": {"ct": 0.60, "us": 0.20, "fluoroscopy": -0.45},
    "thoracic": {"ct": 0.60, "us": 0.20, "fluoroscopy": -0.45},
    "liver": {"ct": 0.30, "us": 0.35, "fluoroscopy": -0.25},
    "hepatic": {"ct": 0.40, "us": 0.35, "fluoroscopy": -0.25},
    "kidney": {"ct": 0.30, "us": 0.60, "fluoroscopy": -0.20},
    "renal": {"ct": 0.30, "us": 0.60, "fluoroscopy": -0.20},
    "thyroid": {"us": 0.45, "ct": 0.15, "fluoroscopy": -0.30},
    "breast": {"us": 0.40, "mri": 0.25, "ct": 0.10, "fluoroscopy": -0.40},
    "bone": {"ct": 0.30, "fluoroscopy": 0.10, "us": -0.10},
    "spine": {"ct": 0.35, "fluoroscopy": 0.05, "us": -0.15},
    "vertebr": {"ct": 0.35, "fluoroscopy": 0.05, "us": -0.15},
    "prostate": {"us": 0.40, "mri": 0.30, "ct": 0.10, "fluoroscopy": -0.25},
}
BIOPSY_DEFAULT = {"ct": 0.25, "us": 0.20, "fluoroscopy": -0.15}
EXPLICIT = ("ct", "us", "ultrasound", "fluoroscop", "mri", "mr")
ANGIO = ("angiography", "angiogram", "angio", "cta", "ct angiography", "ct angiogram", "mr angiography", "mr angiogram", "mra")
VENOUS = ("venography", "venogram", "vein", "venous", "ctv", "ct venography", "mr venography", "mrv", "phlebography", "phlebogram", "dural venous sinus")
ARTERY_NAMES = ("artery", "arterial", "arteries")
VEIN_NAMES = ("vein", "venous", "veins", "venography")
PREGNANCY_NAMES = ("pregnancy", "obstetric", "prenatal", "fetal")
FEMALE_NAMES = ("breast", "mammography", "female", "gynae", "uterus")
MALE_NAMES = ("prostate", "scrotal", "male", "penis")
CHILD_NAMES = ("paediatric", "pediatric", "child", "infant")
#: The consolidated profile's lists for pregnancy, female, male and child, and its explicit modalities.
CONSOLIDATED_NAMES = (("pregnancy", "obstetric", "fetal"), ("breast", "mammography", "gynae"), ("prostate", "scrotal", "penis"), ("paediatric", "child"))
CONSOLIDATED_EXPLICIT = ("ct", "us", "ultrasound", "mri", "mr")
LEVELS = {
    "pregnancy": (("first trimester", "second trimester", "third trimester", "1st trimester", "2nd trimester", "3rd trimester"), ("pregnancy", "obstetric", "multiple pregnancy", "prenatal")),
    "anatomical": (("lumbar spine", "cervical spine", "thoracic spine"), ("spine",)),
}
CONTEXTS = {
    "emergency": (("emergency", "urgent", "stat", "trauma", "acute"), 0.15), "screening": (("screening", "surveillance", "routine", "annual"), 0.15),
    "intervention": (("biopsy", "drainage", "injection", "aspiration", "guided", "picc", "line"), 0.20), "pregnancy": (("obstetric", "pregnancy", "prenatal", "fetal", "trimester"), 0.25),
    "paediatric": (("paediatric", "pediatric", "paed", "peds", "child", "infant", "newborn"), 0.20),
}
SIMILAR = {
    "CT": {"CECT": 0.9, "DECT": 0.8, "HRCT": 0.9, "PET": 0.4, "XR": 0.2, "Fluoroscopy": 0.1},
    "MR": {"MRI": 1.0, "MRA": 0.95, "FMRI": 0.8, "CT": 0.1},
    "XR": {"X-ray": 1.0, "Xray": 1.0, "MG": 0.5, "FL": 0.6, "DEXA": 0.9},
    "US": {"Ultrasound": 1.0, "USS": 0.9, "MRI": 0.1},
    "MG": {"Mammography": 1.0, "Mammogram": 1.0, "Tomosynthesis": 0.9, "XR": 0.5},
    "NM": {"Nuclear Medicine": 1.0, "Scintigraphy": 0.8, "SPECT": 0.9, "PET": 0.4},
    "PET": {"PET/CT": 0.95, "PET-CT": 1.0, "CT": 0.4},
    "PET/CT": {"PET-CT": 1.0, "PET": 0.95, "CT": 0.4, "NM": 0.4},
    "PET-CT": {"PET/CT": 1.0, "PET": 0.95, "CT": 0.4, "NM": 0.4},
    "PET/MRI": {"PET-MRI": 1.0, "PET": 0.90, "MR": 0.6, "NM": 0.4},
    "PET-MRI": {"PET/MRI": 1.0, "PET": 0.90, "MR": 0.6, "NM": 0.4},
    "DEXA": {"DXA": 1.0, "Bone Densitometry": 1.0, "XR": 0.2},
    "DXA": {"DEXA": 1.0, "Bone Densitometry": 1.0, "XR": 0.2},
    "IR": {"Fluoroscopy": 0.6, "CT": 0.2, "US": 0.2},
    "FL": {"Fluoroscopy": 1.0, "XR": 0.6, "IR": 0.6},
}


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty is 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def has_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def modality_score(a: Column, b: Column, similar: dict | None = None) -> Column:
    pairs = {f"{x}|{y}": v for x, row in (similar or SIMILAR).items() for y, v in row.items()}
    table = F.create_map(*[F.lit(z) for kv in pairs.items() for z in kv])
    one = F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), 1.0).otherwise(F.coalesce(table[F.concat_ws("|", F.get(a, F.lit(0)), F.get(b, F.lit(0)))], F.lit(0.0)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).when((F.size(a) == 1) & (F.size(b) == 1), one).otherwise(jaccard(a, b))


def laterality_score(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 1.0).when(a.isNull() | b.isNull(), 0.7).otherwise(0.1)


def contrast_score(a: Column, b: Column, rules: dict = RULES) -> Column:
    r, none_a, none_b = rules["contrast"], F.size(a) == 0, F.size(b) == 0
    return (
        F.when(none_a & none_b, 1.0 + (r["none_bonus"] if r["prefer_none"] else 0.0))
        .when(none_a, 0.1 if r["prefer_none"] else r["null"])
        .when(none_b, r["null"])
        .when(F.array_sort(a) == F.array_sort(b), 1.0)
        .when(F.arrays_overlap(a, b), 0.8)
        .otherwise(r["mismatch"])
    )


def near_terms(terms: Column, words) -> Column:
    """The places in `words` that are in some term, or hold it."""
    near = lambda w: F.exists(terms, lambda t: t.contains(w) | F.lit(w).contains(t))
    return matched([near(w) for w in words])


def matched(tests: list[Column]) -> Column:
    """The places of the tests that hold, as an array of whole numbers."""
    return F.filter(F.array(*[F.when(t, i) for i, t in enumerate(tests)]), lambda x: x.isNotNull()) if tests else F.array().cast("array<int>")


def anatomy_clash(a_first: Column, a_second: Column, b_first: Column, b_second: Column) -> Column:
    """Whether one side is near the first word of an incompatible pair and the other near its second; from `near_terms`."""
    return F.arrays_overlap(a_first, b_second) | F.arrays_overlap(a_second, b_first)


def anatomy_score(a: Column, b: Column, pairs=INCOMPATIBLE, rules: dict = RULES) -> Column:
    first, second = [x for x, _ in pairs], [y for _, y in pairs]
    clash = anatomy_clash(near_terms(a, first), near_terms(a, second), near_terms(b, first), near_terms(b, second))
    return F.when(clash, rules["blocks"]["anatomy"]).otherwise(jaccard(a, b))


def threshold_violation(s: dict[str, Column], rules: dict = RULES, profile: str = "engine") -> Column:
    """The first component below its minimum, else "combined", else null; the consolidated profile has three minimums alone."""
    out = None
    for name in ("anatomy", "modality", "laterality", "contrast", "technique") if profile == "engine" else ("anatomy", "modality", "contrast"):
        low = s[name] < rules["minimum"][name]
        out = F.when(low, name) if out is None else out.when(low, name)
    return out if profile != "engine" else out.when(weighted(s, rules) < rules["minimum"]["combined"], "combined")


def weighted(s: dict[str, Column], rules: dict = RULES) -> Column:
    w = rules["weights"]
    return w["anatomy"] * s["anatomy"] + w["modality"] * s["modality"] + w["laterality"] * s["laterality"] + w["contrast"] * s["contrast"] + w["technique"] * s["technique"]


def diagnostic_penalty(text: Column, cat: Column, rules: dict = RULES) -> Column:
    return F.when(has_any(F.lower(text), DIAGNOSTIC) & has_any(F.lower(cat), PROCEDURAL), rules["blocks"]["diagnostic"]).otherwise(0.0)


def hybrid_penalty(text: Column, cat: Column, table=HYBRID, rules: dict = RULES) -> Column:
    hit = F.lit(False)
    for pattern, excluded in table:
        hit = hit | (F.lower(text).rlike(pattern) & F.lower(cat).rlike(excluded))
    return F.when(hit, rules["blocks"]["hybrid"]).otherwise(0.0)


def technique_penalty(text: Column, cat: Column, table: dict = SPECIALISED, enabled: bool = False, rules: dict = RULES) -> Column:
    if not enabled:
        return F.lit(0.0)
    hit = F.lit(False)
    for technique, needed in table.items():
        hit = hit | (F.lower(cat).contains(technique) & ~has_any(F.lower(text), needed))
    return F.when(hit, rules["blocks"]["technique"]).otherwise(0.0)


def interventional_score(a: Column, b: Column, rules: dict = RULES) -> Column:
    mine, theirs = (F.exists(x, lambda t: t.contains("Interventional")) for x in (a, b))
    return F.when(mine & theirs, rules["interventional"][0]).when(mine, rules["interventional"][1]).otherwise(0.0)


def demographic_groups(cat: Column, profile: str = "engine") -> Column:
    """Which of the demographic word lists an entry's name meets: 0 pregnancy, 1 female, 2 male, 3 child."""
    lists = (PREGNANCY_NAMES, FEMALE_NAMES, MALE_NAMES, CHILD_NAMES) if profile == "engine" else CONSOLIDATED_NAMES
    return matched([has_any(F.lower(cat), names) for names in lists])


def demographic_score(gender: Column, age: Column, groups: Column, rules: dict = RULES) -> Column:
    has, c = lambda i: F.array_contains(groups, i), rules["context"]
    by_gender = F.when((gender == "pregnancy") & has(0), c["pregnancy"]).when((gender == "female") & has(1), c["gender"]).when((gender == "male") & has(2), c["gender"]).otherwise(0.0)
    return by_gender + F.when((age == "paediatric") & has(3), c["age"]).otherwise(0.0)


def demographic_bonus(gender: Column, age: Column, cat: Column, rules: dict = RULES, profile: str = "engine") -> Column:
    return demographic_score(gender, age, demographic_groups(cat, profile), rules)


def context_rules(config: dict) -> list[tuple[str, list[str], float]]:
    """(context, keywords, bonus) from either shape of the rules: nested, or flat `*_keywords` and `*_bonus`."""
    nested = [(k, v["keywords"], v["bonus"]) for k, v in config.items() if isinstance(v, dict)]
    flat = [(k.removesuffix("_keywords"), v, config.get(k.removesuffix("_keywords") + "_bonus", 0.0)) for k, v in config.items() if k.endswith("_keywords")]
    return nested + flat


def context_hits(text: Column, contexts: dict = CONTEXTS) -> Column:
    return matched([has_any(F.lower(text), words) for words, _ in contexts.values()])


def context_score(mine: Column, theirs: Column, contexts: dict = CONTEXTS, rules: dict = RULES) -> Column:
    bonus = F.array(*[F.lit(b) for _, b in contexts.values()])
    return F.aggregate(mine, F.lit(0.0), lambda acc, i: acc + F.when(F.array_contains(theirs, i), F.get(bonus, i)).otherwise(rules["context"]["clinical_penalty"]))


def context_bonus(text: Column, cat: Column, contexts: dict = CONTEXTS, rules: dict = RULES) -> Column:
    return context_score(context_hits(text, contexts), context_hits(cat, contexts), contexts, rules)


def synonym_hits(text: Column, dictionary: dict[str, str]) -> tuple[Column, Column]:
    """The places of the abbreviations and of the expansions that a text holds."""
    low = F.lower(text)
    return matched([low.contains(k.lower()) for k in dictionary]), matched([low.contains(v.lower()) for v in dictionary.values()])


def synonym_score(a_short: Column, a_long: Column, b_short: Column, b_long: Column, rules: dict = RULES) -> Column:
    return F.when(F.arrays_overlap(a_short, b_long) | F.arrays_overlap(a_long, b_short), rules["synonym"]).otherwise(0.0)


def synonym_bonus(text: Column, cat: Column, dictionary: dict[str, str], rules: dict = RULES) -> Column:
    return synonym_score(*synonym_hits(text, dictionary), *synonym_hits(cat, dictionary), rules)


def biopsy_organ(text: Column, organs: dict = BIOPSY, explicit=EXPLICIT) -> Column:
    """The first organ of a biopsy without an explicit modality, "" without an organ; null for all else."""
    low = F.lower(text)
    out = F.when(~(low.contains("biopsy") | low.contains("bx")) | has_any(low, explicit), F.lit(None).cast("string"))
    for organ in organs:
        out = out.when(low.contains(organ), organ)
    return out.otherwise("")


def biopsy_key(modalities: Column) -> Column:
    m = F.transform(modalities, lambda x: F.lower(x))
    has = lambda x: F.array_contains(m, x)
    return F.when(has("ct"), "ct").when(has("us"), "us").when(has("mri"), "mri").when(has("fluoroscopy") | has("ir") | has("interventional"), "fluoroscopy")


def biopsy_score(organ: Column, key: Column, organs: dict = BIOPSY, default: dict = BIOPSY_DEFAULT) -> Column:
    values = {f"{o}|{k}": v for o, row in {**organs, "": default}.items() for k, v in row.items()}
    table = F.create_map(*[F.lit(z) for kv in values.items() for z in kv])
    return F.when(organ.isNull() | key.isNull(), 0.0).otherwise(F.coalesce(table[F.concat_ws("|", organ, key)], F.lit(0.0)))


def biopsy_preference(text: Column, modalities: Column, organs: dict = BIOPSY, default: dict = BIOPSY_DEFAULT, explicit=EXPLICIT) -> Column:
    return biopsy_score(biopsy_organ(text, organs, explicit), biopsy_key(modalities), organs, default)


def generic_anatomy(a: Column, b: Column, rules: dict = RULES) -> Column:
    return F.when(F.size(a) > 0, 0.0).when(F.size(b) == 0, rules["generic_anatomy"][0]).otherwise(rules["generic_anatomy"][1])


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def weighted_words(cat: Column, rules: dict = RULES, profile: str = "engine") -> Column:
    """The distinct words of an entry's name, each with what it adds where the input lacks it."""
    w, among = rules["specificity"], lambda t, words: t.isin(*words).cast("int")

    def weight(t: Column) -> Column:
        if profile != "engine":
            return F.when(t.isin(*STOP_WORDS), 0.0).otherwise(among(t, ANATOMICAL_WORDS) * w["anatomical"] + among(t, ADMIN_WORDS) * w["administrative"])
        rest = (~t.isin(*ANATOMICAL_WORDS, *ADMIN_WORDS, *TECHNIQUE_WORDS, *STOP_WORDS)).cast("int")
        return among(t, ANATOMICAL_WORDS) * w["anatomical"] + among(t, TECHNIQUE_WORDS) * w["technique"] + among(t, ADMIN_WORDS) * w["administrative"] + rest * w["other"]

    return F.transform(distinct_words(cat), lambda t: F.struct(t.alias("word"), weight(t).alias("weight")))


def specificity_sum(words: Column, weighted: Column) -> Column:
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + F.when(F.array_contains(words, x["word"]), 0.0).otherwise(x["weight"]))


def specificity_score(text: Column, cat: Column, rules: dict = RULES, profile: str = "engine") -> Column:
    return specificity_sum(distinct_words(text), weighted_words(cat, rules, profile))


def exact_bonus(text: Column, cat: Column, rules: dict = RULES) -> Column:
    return F.when(F.lower(F.trim(text)) == F.lower(cat), rules["exact"]).otherwise(0.0)


def generic_angiography(text: Column) -> Column:
    return has_any(F.lower(text), ANGIO) & ~has_any(F.lower(text), VENOUS)


def vessel_bonus(fsn: Column, rules: dict = RULES) -> Column:
    """What an entry adds for generic angiography."""
    low = F.lower(fsn)
    return F.when(has_any(low, ARTERY_NAMES), rules["vessel"][0]).when(has_any(low, VEIN_NAMES), rules["vessel"][1]).otherwise(0.0)


def vessel_preference(text: Column, fsn: Column, rules: dict = RULES) -> Column:
    return F.when(generic_angiography(text), vessel_bonus(fsn, rules)).otherwise(0.0)


def levels_of(text: Column, levels: dict = LEVELS) -> Column:
    """For each category "specific", "generic" or null."""
    low = F.lower(text)
    return F.array(*[F.when(has_any(low, specific), "specific").when(has_any(low, generic), "generic") for specific, generic in levels.values()])


def level_sum(mine: Column, theirs: Column, rules: dict = RULES) -> Column:
    of = lambda a, b: F.coalesce(F.when(a == b, rules["level"][0]).when((a == "specific") & (b == "generic"), rules["level"][1]), F.lit(0.0))
    return F.aggregate(F.zip_with(mine, theirs, of), F.lit(0.0), lambda acc, x: acc + x)


def level_score(text: Column, fsn: Column, levels: dict = LEVELS, rules: dict = RULES) -> Column:
    return level_sum(levels_of(text, levels), levels_of(fsn, levels), rules)


def input_features(inputs: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """`inputs` with `in_f`: all that the rules need of an input alone, found once for each input and not for each candidate."""
    c, text = F.col, F.col("in_text")
    short, long = synonym_hits(text, dictionary)
    first, second = ([p[k] for p in INCOMPATIBLE] for k in (0, 1))
    parts = {
        "exact": F.lower(F.trim(text)), "words": distinct_words(text), "diagnostic": has_any(F.lower(text), DIAGNOSTIC),
        "hybrid": matched([F.lower(text).rlike(p) for p, _ in HYBRID]), "context": context_hits(text), "short": short, "long": long,
        "organ": biopsy_organ(text), "organ2": biopsy_organ(text, explicit=CONSOLIDATED_EXPLICIT), "angiography": generic_angiography(text), "levels": levels_of(text),
        "first": near_terms(c("in_anatomy"), first), "second": near_terms(c("in_anatomy"), second), "interventional": F.exists("in_technique", lambda t: t.contains("Interventional")),
    }
    return inputs.withColumn("in_f", F.struct(*[v.alias(k) for k, v in parts.items()]))


def entry_features(catalogue: DataFrame, dictionary: dict[str, str], rules: dict = RULES) -> DataFrame:
    """`catalogue` with `cat_f`: all that the rules need of an entry alone."""
    c, text, fsn = F.col, F.col("cat_text"), F.col("cat_fsn")
    short, long = synonym_hits(text, dictionary)
    first, second = ([p[k] for p in INCOMPATIBLE] for k in (0, 1))
    parts = {
        "exact": F.lower(text), "weighted": weighted_words(text, rules), "weighted2": weighted_words(text, rules, "consolidated"), "procedural": has_any(F.lower(text), PROCEDURAL),
        "hybrid": matched([F.lower(text).rlike(p) for _, p in HYBRID]), "context": context_hits(text), "short": short, "long": long, "key": biopsy_key(c("cat_modality")),
        "groups": demographic_groups(text), "groups2": demographic_groups(text, "consolidated"), "vessel": vessel_bonus(fsn, rules), "levels": levels_of(fsn),
        "first": near_terms(c("cat_anatomy"), first), "second": near_terms(c("cat_anatomy"), second), "interventional": F.exists("cat_technique", lambda t: t.contains("Interventional")),
    }
    return catalogue.withColumn("cat_f", F.struct(*[v.alias(k) for k, v in parts.items()]))


def scored(cands: DataFrame, dictionary: dict[str, str], profile: str = "engine", rules: dict = RULES) -> DataFrame:
    """`cands` with every part of the score, and `component`.

    Rules read the features `in_f` and `cat_f`; candidates that don't come with them get them here. The consolidated profile has minimums
    for anatomy, modality and contrast alone, word lists of its own, and vessel and level bonuses in place of the context rules.
    """
    if "in_f" not in cands.columns:
        cands = input_features(cands, dictionary)
    if "cat_f" not in cands.columns:
        cands = entry_features(cands, dictionary, rules)
    c, i, e, one = F.col, lambda k: F.col(f"in_f.{k}"), lambda k: F.col(f"cat_f.{k}"), profile == "engine"
    blocks, inter = rules["blocks"], rules["interventional"]
    clash = anatomy_clash(i("first"), i("second"), e("first"), e("second"))
    base = cands.select(
        "*",
        F.when(clash, blocks["anatomy"]).otherwise(jaccard(c("in_anatomy"), c("cat_anatomy"))).alias("s_anatomy"), modality_score(c("in_modality"), c("cat_modality")).alias("s_modality"),
        laterality_score(c("in_laterality"), c("cat_laterality")).alias("s_laterality"), contrast_score(c("in_contrast"), c("cat_contrast"), rules).alias("s_contrast"),
        jaccard(c("in_technique"), c("cat_technique")).alias("s_technique"),
        F.when(i("diagnostic") & e("procedural"), blocks["diagnostic"]).otherwise(0.0).alias("p_diagnostic"), F.when(F.arrays_overlap(i("hybrid"), e("hybrid")), blocks["hybrid"]).otherwise(0.0).alias("p_hybrid"),
        technique_penalty(c("in_text"), c("cat_text")).alias("p_technique"),
        F.when(i("interventional"), F.when(e("interventional"), inter[0]).otherwise(inter[1])).otherwise(0.0).alias("b_interventional"),
        demographic_score(c("in_gender"), c("in_age"), e("groups" if one else "groups2"), rules).alias("b_demographic"),
        context_score(i("context"), e("context"), rules=rules).alias("b_context"), synonym_score(i("short"), i("long"), e("short"), e("long"), rules).alias("b_synonym"),
        biopsy_score(i("organ" if one else "organ2"), e("key")).alias("b_biopsy"), generic_anatomy(c("in_anatomy"), c("cat_anatomy"), rules).alias("b_generic"),
        specificity_sum(i("words"), e("weighted" if one else "weighted2")).alias("b_specificity"), F.when(i("exact") == e("exact"), rules["exact"]).otherwise(0.0).alias("b_exact"),
        F.when(i("angiography"), e("vessel")).otherwise(0.0).alias("b_vessel"), level_sum(i("levels"), e("levels"), rules).alias("b_level"),
    ).drop("in_f", "cat_f")
    s = {n: c(f"s_{n}") for n in ("anatomy", "modality", "laterality", "contrast", "technique")}
    bonus = c("b_interventional") + c("b_specificity") + c("b_demographic")
    bonus += c("b_context") + c("b_synonym") + c("b_biopsy") + c("b_generic") + c("b_exact") if one else c("b_synonym") + c("b_biopsy") + c("b_generic") + c("b_vessel") + c("b_level") + c("b_exact")
    blocked = (c("p_diagnostic") < -1) | (c("p_hybrid") < -1) | (c("p_technique") < -1) | (c("s_anatomy") < -1)
    base = base.withColumn("violation", threshold_violation(s, rules, profile))
    whole = lambda x: F.when(blocked | c("violation").isNotNull(), 0.0).otherwise(x)
    base = base.withColumn("component", whole(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted(s, rules) + bonus))))
    if one:
        return base
    parts = F.struct(weighted(s, rules).alias("base_score"), bonus.alias("bonuses_penalties"), *[v.alias(k) for k, v in s.items()])
    reason = F.when(blocked, "blocking").otherwise(c("violation"))
    return base.withColumn("breakdown", F.struct(reason.alias("violation"), F.when(reason.isNull(), parts).alias("parts")))


#: Models that are prompted; they take no position bonus.
PROMPTED = ("gpt-4o-mini", "claude-3-haiku", "gemini-2.5-flash-lite")


def contrast_veto() -> Column:
    """Both sides name a contrast, none in common, and the components fail."""
    return (F.size("in_contrast") > 0) & (F.size("cat_contrast") > 0) & ~F.arrays_overlap("in_contrast", "cat_contrast") & (F.col("component") == 0)


def model_weights(model: Column, rules: dict = RULES) -> Column:
    """A model's weights (the general ones for unknown models), and whether it takes the position bonus."""
    weights = F.create_map(*[x for name, (a, b) in rules["final"].items() for x in (F.lit(name), F.struct(F.lit(a).alias("c"), F.lit(b).alias("r")))])
    w = F.coalesce(weights[model], weights[F.lit("general")])
    return F.struct(w["c"].alias("c"), w["r"].alias("r"), (~model.isin(*PROMPTED)).alias("placed"))


def final_of(component: Column, rerank: Column, veto: Column, simple: Column, cand_pos: Column, weights: Column, rules: dict = RULES) -> Column:
    """Contrast veto, weights of `model_weights`, and for simple inputs (of several candidates) the position bonus."""
    top, step = rules["position"]
    position = F.when(simple & weights["placed"], F.greatest(F.lit(0.0), top - step * cand_pos)).otherwise(0.0)
    return F.when(veto, 0.0).otherwise(weights["r"] * rerank + weights["c"] * component + position)


def final_score(cands: DataFrame, model: Column, rules: dict = RULES) -> DataFrame:
    """`final` from `component` and `rerank`, for a row per candidate."""
    several = F.count(F.lit(1)).over(Window.partitionBy("row_id")) > 1
    return cands.withColumn("final", final_of(F.col("component"), F.col("rerank"), contrast_veto(), F.col("in_simple") & several, F.col("cand_pos"), model_weights(model, rules), rules))


def gathered(cands: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row per input, named by `keys`: `found`, its candidates by position, as entry_id, cand_pos and `columns`. There are at most the retriever's k."""
    item = F.struct("cand_pos", "entry_id", *columns)
    return cands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("entry_id").isNotNull(), item))).alias("found"))


def best_first(found: Column, score) -> Column:
    """The candidates of `gathered` (entry_id, cand_pos, score) by a function of each, best first; of ties the earliest."""
    items = F.array_sort(F.transform(found, lambda x: F.struct((-score(x)).alias("o"), x["cand_pos"].alias("cand_pos"), x["entry_id"].alias("entry_id"))))
    return F.transform(items, lambda x: F.struct(x["entry_id"].alias("entry_id"), x["cand_pos"].alias("cand_pos"), (-x["o"]).alias("score")))


def final_consolidated(component: Column, rerank: Column, fit: Column, rules: dict = RULES) -> Column:
    """The general weights of component and reranking, the latter times how well the complexities fit, within 0 and 1."""
    w = rules["final"]["general"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w[0] * component + w[1] * (rerank * fit)))


def rerank_guard(cands: DataFrame) -> DataFrame:
    """Missing scores are a neutral 0.5; `invalid` where all scores of a row are 0."""
    filled = cands.withColumn("rerank", F.coalesce("rerank", F.lit(0.5)))
    return filled.withColumn("invalid", F.max("rerank").over(Window.partitionBy("row_id")) == 0)


def pick_best(cands: DataFrame, score: str = "final") -> DataFrame:
    """The highest score of each row; of ties the earliest candidate."""
    w = Window.partitionBy("row_id").orderBy(F.col(score).desc(), "cand_pos")
    return cands.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def candidate_list(cands: DataFrame, score: str = "final") -> DataFrame:
    """All candidates of a row, best first, with scores rounded for display."""
    item = F.struct((-F.col(score)).alias("o"), F.col("cand_pos").alias("p"), F.col("entry_id").alias("e"), F.round(score, 2).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["e"].alias("entry_id"), x["s"].alias("score")))
    return cands.groupBy("row_id").agg(listed.alias("candidates"))


def best_and_list(cands: DataFrame, columns: list[str], score: str = "final") -> DataFrame:
    """`pick_best` and `candidate_list` at once, by one grouping: row_id, `columns` of the best, and the candidates, best first.

    A row has at most the retriever's k candidates, so the list is short.
    """
    item = F.struct((-F.col(score)).alias("o"), F.col("cand_pos").alias("p"), F.col("entry_id").alias("e"), F.round(score, 2).alias("s"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = cands.groupBy("row_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    listed = F.transform("c", lambda x: F.struct(x["e"].alias("entry_id"), x["s"].alias("score")))
    return rows.select("row_id", *[F.col("c")[0][f"_{c}"].alias(c) for c in columns], listed.alias("candidates"))


def modality_filter(cands: DataFrame) -> DataFrame:
    """Candidates without a modality, or with the input's first."""
    first = F.upper(F.get("in_modality", F.lit(0)))
    return cands.filter(first.isNull() | (F.size("cat_modality") == 0) | F.exists("cat_modality", lambda m: F.upper(m) == first))


def complexity_reorder(cands: DataFrame, similar: Column) -> DataFrame:
    """For simple inputs: close names, then simple ones, then complex ones; stable."""
    bucket = F.when(~F.col("in_simple"), 0).when(similar > 0.7, 0).when(~F.col("cat_complex"), 1).otherwise(2)
    w = Window.partitionBy("row_id").orderBy("_b", "cand_pos")
    return cands.withColumn("_b", bucket).withColumn("new_pos", F.row_number().over(w) - 1).drop("_b")


def laterality_ambiguous(entry_side: Column, parsed_side: Column, input_side: Column) -> Column:
    """The input names no side, and the entry does (by its coded side, or where that is missing by its name)."""
    return F.coalesce(input_side.isNull() & F.coalesce(entry_side, parsed_side).isin("left", "right", "bilateral"), F.lit(False))


def needs_peer(entry_side: Column, parsed_side: Column, input_side: Column) -> Column:
    """Whether the bilateral peer stands for the match: its side is ambiguous, or the input asks for both and the entry isn't coded so."""
    return laterality_ambiguous(entry_side, parsed_side, input_side) | F.coalesce((input_side == "bilateral") & ~entry_side.eqNullSafe(F.lit("bilateral")), F.lit(False))


def signature(*sets: Column) -> Column:
    """A canonical text of component sets, for equi-joins between peers."""
    return F.concat_ws("|", *[F.array_join(F.array_sort(s), ",") for s in sets])


def peers(best: DataFrame, others: DataFrame) -> DataFrame:
    """For one-sided matches: the first bilateral or unsided entry of the catalogue with equal components."""
    o = others.filter(F.col("laterality").isNull() | (F.col("laterality") == "bilateral")).select(F.col("entry_id").alias("peer_id"), F.col("sig").alias("_s"))
    first = o.groupBy("_s").agg(F.min("peer_id").alias("peer_id"))
    found = best.filter(F.col("laterality").isin("left", "right")).join(first, F.col("sig") == F.col("_s"))
    return found.select("entry_id", "peer_id")


def peers_in_candidates(best: DataFrame, cands: DataFrame) -> DataFrame:
    """For each best match, the first candidate of its row (by position) with the same concept and components that is bilateral.

    `cands` has row_id, entry_id, concept_id, sig, entry_side (coded, may be null), laterality (of the name) and cand_pos; the coded side goes first.
    """
    both = F.when(F.col("entry_side").isNotNull(), F.col("entry_side") == "bilateral").otherwise(F.coalesce(F.col("laterality"), F.lit("bilateral")) == "bilateral")
    o = cands.filter(both).select("row_id", "concept_id", "sig", F.col("entry_id").alias("peer_id"), "cand_pos")
    first = o.groupBy("row_id", "concept_id", "sig").agg(F.min_by("peer_id", "cand_pos").alias("peer_id"))
    return best.select("row_id", "entry_id", "concept_id", "sig").join(first, ["row_id", "concept_id", "sig"]).select("row_id", "entry_id", "peer_id")


def biopsy_ambiguous(text: Column) -> Column:
    """A biopsy without an explicit modality."""
    low = F.lower(text)
    return (low.contains("biopsy") | low.contains("bx")) & ~has_any(low, EXPLICIT)


def safeguard(df: DataFrame, similarity: Column, limit: float = 0.3, cap: float = 0.2) -> DataFrame:
    """A result unlike its input is ambiguous, with a capped confidence and an audit trail."""
    low = similarity < limit
    return (
        df.withColumn("audit", F.when(low, F.struct(similarity.alias("similarity"), F.col("confidence").alias("was"))))
        .withColumn("ambiguous", F.col("ambiguous") | low)
        .withColumn("confidence", F.when(low, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")))
    )


def assemble(best: DataFrame, entry_side: Column, similarity: Column) -> DataFrame:
    """The result row of each best match: contexts come from the input, components from the match, nested under `components`.

    `best` has in_text, in_gender, in_age, in_contrast, in_laterality, the match's cat_ columns, confidence and candidates.
    """
    c = F.col
    sides = (entry_side, c("cat_laterality"), c("in_laterality"))
    strip = needs_peer(*sides)
    df = best.withColumn("ambiguous", strip | F.coalesce(biopsy_ambiguous(c("in_text")), F.lit(False)))
    df = safeguard(df, similarity)
    parts = [c(f"cat_{n}").alias(n) for n in ("anatomy", "laterality", "contrast", "technique", "modality")]
    diagnostic = ~F.exists("cat_technique", lambda t: t.contains("Interventional"))
    return df.select(
        "row_id", "entry_id", rewrite_name(c("cat_text"), F.array_contains("in_contrast", "with"), strip).alias("clean_name"), diagnostic.alias("is_diagnostic"), (~diagnostic).alias("is_interventional"),
        "ambiguous", laterality_ambiguous(*sides).alias("side_ambiguous"), "confidence", "audit", "candidates",
        F.struct(*parts, c("confidence").alias("confidence"), c("in_gender").alias("gender"), c("in_age").alias("age")).alias("components"),
    )


def consensus(responses: DataFrame, order: str | None = None) -> DataFrame:
    """Vote of models per row: most votes, then highest mean confidence, then the smallest choice.

    Equal means of doubles differ in their last digits by the order in which they are added up, and ties and limits with them. With `order`, a column, a
    choice's confidences are added up in that order, wherever the rows lie.
    """
    valid = responses.filter(F.col("choice").isNotNull())
    if order is None:
        per = valid.groupBy("row_id", "choice").agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("mean"))
    else:
        so_far = Window.partitionBy("row_id", "choice").orderBy(order, "confidence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = F.struct(F.count(F.lit(1)).over(so_far).alias("votes"), (F.sum("confidence").over(so_far) / F.count("confidence").over(so_far)).alias("mean"))
        last = valid.select("row_id", "choice", x.alias("_x")).groupBy("row_id", "choice").agg(F.max_by("_x", "_x.votes").alias("_x"))
        per = last.select("row_id", "choice", "_x.votes", "_x.mean")
    total = F.sum("votes").over(Window.partitionBy("row_id"))
    w = Window.partitionBy("row_id").orderBy(F.desc("votes"), F.desc("mean"), "choice")
    ranked = per.withColumn("valid", total).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return ranked.select("row_id", "choice", F.col("mean").alias("confidence"), (F.col("votes") / F.col("valid")).alias("agreement"), "votes", "valid")


def named_consensus(responses: DataFrame, cands: DataFrame, order: str | None = None) -> DataFrame:
    """The winner of `consensus` with its name and full name from the row's candidates, and the models that agree on it.

    `responses` has row_id, model, choice, confidence (a model is named by what follows its last slash), `cands` row_id, choice, name, fsn. A
    choice that isn't among the candidates is an "Unknown Procedure".
    """
    won = consensus(responses, order)
    known = cands.groupBy("row_id", "choice").agg(F.min(F.struct("name", "fsn")).alias("_c"))
    short = F.element_at(F.split("model", "/"), -1)
    agreeing = responses.filter(F.col("choice").isNotNull()).groupBy("row_id", "choice").agg(F.array_sort(F.collect_list(short)).alias("models"))
    keys = ["row_id", "choice"]
    rows = joined(joined(won, known, keys, "left"), agreeing, keys)
    return rows.select(*won.columns, F.coalesce("_c.name", F.lit("Unknown Procedure")).alias("name"), F.col("_c.fsn").alias("fsn"), "models")


def improved(consensus_confidence: Column, original: Column) -> Column:
    return consensus_confidence > original
