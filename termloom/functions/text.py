"""Text cleaning as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entries that name no exam.
EXCLUSIONS = (
    r"\b(conference|conferences)\b", r"\b(mdm|multidisciplinary.?meeting)\b", r"\b(meeting|meetings)\b", r"\b(discussion|discussions)\b",
    r"\b(presentation|presentations)\b", r"\b(teaching|education|educational)\b", r"\b(review.?meeting|case.?review)\b", r"\b(journal.?club)\b",
    r"\b(admin|administrative)\b", r"\b(cancelled|canceled|no.?show)\b", r"\b(test.?patient|test.?case)\b",
)
#: Report suffixes, administrative words and modality spellings.
SUFFIXES = (" - NO REPORT", " -NO REPORT", "- NO REPORT", "NO REPORT")
ADMIN_PAREN = r"\s*\((non-acute|acute|mobile|portable|ward|stat|standard|single projection|gr|procedure|finding|qualifier value)\)\s*"
ADMIN_WORDS = r"\b(mobile|portable|ward|stat|opd|inpatient|outpatient|standard|imaging|scan)\b"
MODALITY_GROUPS = (
    (r"\bmr\b", r"\bmri\b", r"\bmagnetic resonance imaging\b"), (r"\bct\b", r"\bcomputed tomography\b"), (r"\bus\b", r"\bultrasound\b", r"\bsonogram\b"),
    (r"\bxr\b", r"\bx-ray\b", r"\bxray\b", r"\bradiograph\b"), (r"\bnm\b", r"\bnuclear medicine\b", r"\bspect\b"), (r"\bfl\b", r"\bfluoroscopy\b", r"\bfluoro\b"),
    (r"\bmg\b", r"\bmamm\b", r"\bmammography\b", r"\bmammogram\b"), (r"\bpet\b", r"\bpositron emission tomography\b"),
)
HYBRID = r"\b(pet|spect)[/\- ]ct\b|\bpet[/\- ]mri\b"
#: A small default dictionary; real ones come as a parameter.
ABBREVIATIONS = {"C+": "with contrast", "C-": "without contrast", "LSP": "lumbar spine", "KUB": "kidney ureter bladder", "Abdo": "abdomen", "Bx": "biopsy", "HRCT": "high resolution CT"}
SYNONYMS = {"lung": "chest", "renal": "kidney"}
SPECIAL = r"[.^$*+?{}\[\]\\|()/-]"


def escaped(term: str) -> str:
    """`term` as a literal pattern that Java and RE2 read alike."""
    return "".join("\\" + c if not c.isalnum() and c != " " and c != "_" else c for c in term)


def is_excluded(name: Column) -> Column:
    """Null, empty and non-clinical entries."""
    return F.coalesce(name == "", F.lit(True)) | F.coalesce(F.lower(name).rlike("|".join(EXCLUSIONS)), F.lit(True))


def strip_suffix(name: Column, suffixes=SUFFIXES) -> Column:
    """The first suffix that fits goes, in any case, and the rest is trimmed."""
    out = None
    for s in suffixes:
        hit, cut = F.upper(name).endswith(s), F.trim(F.substr(name, F.lit(1), F.length(name) - len(s)))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(name)


def strip_admin(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "(?i)" + ADMIN_PAREN, " "), "(?i)" + ADMIN_WORDS, " ")


def dictionary_rules(dictionary: dict[str, str], synonyms: dict[str, str]) -> list[tuple[str, str]]:
    """(pattern, replacement): dictionary entries longest first, then synonyms in order."""
    rules = []
    for key, value in sorted(dictionary.items(), key=lambda kv: -len(kv[0])):
        end = r"(?=\s|$)" if "+" in key or "-" in key else r"\b"
        rules.append((r"\b" + escaped(key) + end, value))
    return rules + [(r"\b" + escaped(k) + r"\b", v) for k, v in synonyms.items()]


def expand_terms(name: Column, dictionary=None, synonyms=None, most_rules: int = 50) -> Column:
    """Sequential expansion: later rules see earlier output.

    Few rules fold into built-in replacements; a longer dictionary runs as one
    Arrow function, as generated code for hundreds of nested replacements is too large to compile.
    """
    rules = dictionary_rules(ABBREVIATIONS if dictionary is None else dictionary, SYNONYMS if synonyms is None else synonyms)
    if len(rules) <= most_rules:
        for pattern, value in rules:
            name = F.regexp_replace(name, "(?i)" + pattern, value.replace("\\", r"\\").replace("$", r"\$"))
        return name

    @F.pandas_udf("string")
    def expand(names: pd.Series) -> pd.Series:
        for pattern, value in rules:
            names = names.str.replace(pattern, lambda _, v=value: v, case=False, regex=True)
        return names

    return expand(name)


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once per row and appears once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dedupe_modality(name: Column) -> Column:
    """Of several spellings of a modality the longest pattern stays; hybrid scans are left alone."""

    def without_shorter(group: tuple[str, ...]):
        ranked = sorted(group, key=lambda p: -len(p))

        def body(text: Column) -> Column:
            new = text
            for place, pattern in enumerate(ranked[1:], 1):
                longer = text.rlike("(?i)" + "|".join(ranked[:place]))
                new = F.when(longer, F.regexp_replace(new, "(?i)" + pattern, "")).otherwise(new)
            return new

        return body

    def deduped(original: Column) -> Column:
        out = original
        for group in MODALITY_GROUPS:
            out = let(out, without_shorter(group))
        return F.when(F.lower(original).rlike(HYBRID), original).otherwise(out)

    return squeeze(let(name, deduped))


def ordinals(name: Column) -> Column:
    for short, word in (("1st", "First"), ("2nd", "Second"), ("3rd", "Third")):
        name = F.regexp_replace(name, rf"(?i)\b{short}\b", word)
    return name


def clean_special(name: Column) -> Column:
    name = F.regexp_replace(name, r"[\[\]()/]", " ")
    name = F.replace(F.replace(name, F.lit("&"), F.lit(" and ")), F.lit(","), F.lit(" "))
    for pattern, value in ((r"\s+and\s+", " "), (r"\s*-\s*$", ""), (r"^\s*-\s*", ""), (r"\s+-\s+", " ")):
        name = F.regexp_replace(name, pattern, value)
    return name


def squeeze(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def expanded(name: Column, dictionary=None, synonyms=None) -> Column:
    return expand_terms(strip_admin(strip_suffix(name)), dictionary, synonyms)


def finish(name: Column) -> Column:
    return squeeze(ordinals(clean_special(dedupe_modality(name))))


def preprocess(name: Column, dictionary=None, synonyms=None) -> Column:
    """The whole cleaner in its fixed order; null gives the empty string."""
    return F.coalesce(finish(expanded(name, dictionary, synonyms)), F.lit(""))


def strip_fsn(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\s*\((procedure|qualifier value|finding)\)$", "")


#: Fixed values of the title case.
UPPER = ("ct", "mri", "mr", "us", "xr", "pet", "nm", "dexa", "dxa", "mg", "ir", "picc", "hrct", "mrcp", "cta", "mra")
SMALL = (
    "and", "or", "of", "in", "on", "at", "to", "for", "with", "without", "by", "from", "up", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "among", "a", "an", "the",
)
SIDES = {"rt": "Right", "lt": "Left", "both": "Both", "bilateral": "Both"}


def title_case(name: Column) -> Column:
    """Modalities upper case, sides spelled out, small words (but the first) lower case; punctuation doesn't count in the look-up."""

    def one(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(F.lower(w), r"(?U)[^\w]", "")
        side = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
        plain = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2), F.length(w))))
        return F.when(bare.isin(*UPPER), F.upper(w)).when(bare.isin(*SIDES), side[bare]).when(bare.isin(*SMALL) & (i > 0), F.lower(w)).otherwise(plain)

    return F.array_join(F.transform(F.split(squeeze(name), " "), one), " ")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def norm_field(value: Column, unicode: bool = False) -> Column:
    """A key field: null is empty, trimmed, white space collapsed, lower case; `unicode` adds NFC for non-ASCII rows."""
    value = F.coalesce(value, F.lit(""))
    if unicode:
        value = F.when(value.rlike(r"[^\x00-\x7F]"), nfc(value)).otherwise(value)
    return F.lower(squeeze(value))


def preimage(ds: Column, ec: Column, en: Column, mc: Column, lat: Column | None = None) -> Column:
    field = lambda c: F.replace(norm_field(c), F.lit("|"), F.lit("%7C"))
    parts = [F.lit("v1" if lat is None else "v2"), F.lit("|ds:"), field(ds), F.lit("|ec:"), field(ec), F.lit("|en:"), field(en), F.lit("|mc:"), field(mc)]
    return F.concat(*parts, *([] if lat is None else [F.lit("|lat:"), field(lat)]))


def request_key(ds: Column, ec: Column, en: Column, mc: Column, lat: Column | None = None) -> Column:
    return F.sha2(preimage(ds, ec, en, mc, lat), 256)


def legacy_key(kind: str, ds: Column, ec: Column, en: Column, mc: Column | None = None, clean: Column | None = None) -> Column:
    """Keys of older writers: `api` (4 fields), `engine` (3) and `ui` (4)."""
    fields = {"api": (ds, ec, en, mc), "engine": (ec, en, ds), "ui": (ec, en, ds, clean)}[kind]
    return F.sha2(F.concat_ws("|", *[norm_field(c) for c in fields]), 256)


def input_key(fields: dict[str, Column]) -> Column:
    """MD5 of the fields as JSON with sorted keys, a blank after each colon and comma; nulls are written as such."""
    value = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    parts = [F.concat(F.lit(f'"{k}": '), value(fields[k])) for k in sorted(fields)]
    return F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def comparison_key(names: Column) -> Column:
    """MD5 of the sorted list."""
    return F.md5(F.array_join(F.array_sort(names), "|"))


def poly_hash(text: Column, signed: bool = False) -> Column:
    """h * 31 + code over the code points, in 32 bits, in base 36; the absolute value where `signed`."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % F.lit(1 << 32))
    if signed:
        h = F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def parse_money(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(F.trim(text).isin("-", ""), None).otherwise(digits.try_cast("decimal(10,2)"))


def display_name(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], value)


def rewrite_name(name: Column, wants_contrast: Column, strip: Column | None = None) -> Column:
    """The name without its side (where `strip` holds; always without it), and with the contrast that the input asks for."""
    base = F.trim(F.regexp_replace(name, r"(?i)\s+(lt|rt|left|right|both|bilateral)$", ""))
    base = base if strip is None else F.when(strip, base).otherwise(name)
    return F.when(wants_contrast & ~F.lower(base).contains("with contrast"), F.concat(base, F.lit(" with contrast"))).otherwise(base)


def first_object(text: Column) -> Column:
    """The text from the first `{` up to the brace that closes it; quoted braces don't count. Null without one."""
    body = F.regexp_extract(text, r"(?s)\{.*", 0)
    # one mark per string, brace or other stretch; the running depth ends the object
    marks = F.regexp_extract_all(body, F.lit(r"""(?s)("(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|")"""), F.lit(1))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("done"))

    def step(a: Column, m: Column) -> Column:
        depth = a["depth"] + F.when(m == "{", 1).when(m == "}", -1).otherwise(0)
        return F.when(a["done"], a).otherwise(F.struct(F.concat(a["out"], m).alias("out"), depth.alias("depth"), (depth == 0).alias("done")))

    return F.aggregate(marks, start, step, lambda a: F.when(a["done"], a["out"]))


def parse_choice(text: Column) -> Column:
    """(choice, confidence) from the first complete JSON object inside messy text; null and 0 where missing."""
    parsed = F.from_json(first_object(text), "choice string, confidence double")
    return F.struct(parsed["choice"].alias("choice"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"))
