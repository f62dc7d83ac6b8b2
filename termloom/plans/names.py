"""Queries over exam names: cleaning (B), components (C), complexity (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import complexity as cx
from ..functions import components as cp
from ..functions import text as tx
from ..operators.distinct import once_each
from ..sources import readers as rd
from . import derive
from .registry import query

FEED = derive.duck(derive.FEED)
CAT = derive.duck(derive.CATALOGUE)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, value: str) -> str:
    """Oracle: case-insensitive replacement of all matches."""
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(value)}, 'gi')"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def tag_list(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(t)} END" for t, c in pairs) + "], lambda x: x IS NOT NULL)"


SUFFIX = "CASE " + " ".join(f"WHEN ends_with(upper(exam_name), {lit(s)}) THEN trim(left(exam_name, length(exam_name) - {len(s)}))" for s in tx.SUFFIXES) + " ELSE exam_name END"


def admin_sql(e: str) -> str:
    return sub(sub(e, tx.ADMIN_PAREN, " "), tx.ADMIN_WORDS, " ")


def expand_sql(e: str) -> str:
    for pattern, value in tx.dictionary_rules(tx.ABBREVIATIONS, tx.SYNONYMS):
        if "(?=" in pattern:  # no lookahead in the oracle's patterns: the following space is put back
            e = sub(e, pattern.replace(r"(?=\s|$)", r"(\s|$)"), value + r"\1")
        else:
            e = sub(e, pattern, value)
    return e


def special_sql(e: str) -> str:
    e = f"replace(replace(regexp_replace({e}, '[\\[\\]()/]', ' ', 'g'), '&', ' and '), ',', ' ')"
    for pattern, value in ((r"\s+and\s+", " "), (r"\s*-\s*$", ""), (r"^\s*-\s*", ""), (r"\s+-\s+", " ")):
        e = f"regexp_replace({e}, {lit(pattern)}, {lit(value)}, 'g')"
    return e


def squeeze_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def ordinal_sql(e: str) -> str:
    for short, word in (("1st", "First"), ("2nd", "Second"), ("3rd", "Third")):
        e = sub(e, rf"\b{short}\b", word)
    return e


def dedupe_ctes(source: str, column: str) -> str:
    """Oracle: one CTE per group, each over the one before."""
    out, at = [], source
    for n, group in enumerate(tx.MODALITY_GROUPS):
        ranked = sorted(group, key=lambda p: -len(p))
        e, seen = column, []
        for p in ranked:
            if seen:
                e = f"CASE WHEN {' OR '.join(has(f'lower({column})', s) for s in seen)} THEN {sub(e, p, '')} ELSE {e} END"
            seen.append(p)
        out.append(f"g{n} AS (SELECT * REPLACE ({e} AS {column}) FROM {at})")
        at = f"g{n}"
    return ", ".join(out)


PREPARED = f"""feed AS ({FEED}), a AS (SELECT *, {SUFFIX} AS s FROM feed), b AS (SELECT *, {admin_sql('s')} AS ad FROM a),
  c AS (SELECT *, {expand_sql('ad')} AS ex FROM b), c1 AS (SELECT *, ex AS dd FROM c), {dedupe_ctes('c1', 'dd')},
  d AS (SELECT * REPLACE ({squeeze_sql(f"CASE WHEN {has('lower(ex)', tx.HYBRID)} THEN ex ELSE dd END")} AS dd) FROM g7),
  cleaned AS (SELECT *, {squeeze_sql(ordinal_sql(special_sql('dd')))} AS clean_name FROM d)"""


@query("b1_exclude", f"SELECT row_id, exam_name, CAST(exam_name = '' OR {has('lower(exam_name)', '|'.join(tx.EXCLUSIONS))} AS INTEGER) AS excluded FROM ({FEED})")
def b1(spark, sf):
    return derive.feed(spark, sf).select("row_id", "exam_name", tx.is_excluded(F.col("exam_name")).cast("int").alias("excluded"))


@query("b2_b9_preprocess", f"WITH {PREPARED} SELECT row_id, s AS no_suffix, ad AS no_admin, ex AS expanded, dd AS deduped, {ordinal_sql('s')} AS ordinals, {special_sql('s')} AS special, {squeeze_sql('exam_name')} AS squeezed, clean_name FROM cleaned")
def b9(spark, sf):
    n = F.col("exam_name")
    s = tx.strip_suffix(n)
    return derive.feed(spark, sf).select(
        "row_id", s.alias("no_suffix"), tx.strip_admin(s).alias("no_admin"), tx.expanded(n).alias("expanded"), tx.dedupe_modality(tx.expanded(n)).alias("deduped"),
        tx.ordinals(s).alias("ordinals"), tx.clean_special(s).alias("special"), tx.squeeze(n).alias("squeezed"), tx.preprocess(n).alias("clean_name"),
    )


def qualifier_sql(e: str) -> str:
    count = lambda x, p: f"len(regexp_extract_all({x}, {lit(p)}))"
    low = f"lower({e})"
    sep = " + ".join(count(low, p) for p in (*cx.SEPARATORS, cx.LAST_AND))
    num = " + ".join(f"CAST({has(low, p)} AS INTEGER)" for p in cx.NUMERIC)
    words = f"greatest({count(e, r'[^\s]+')}, 1)"
    return f"""least(least(({sep}) * 0.25::DOUBLE, 0.5) + least({count(e, r'\b[A-Z]{2,}\b')} / {words}::DOUBLE * 0.3, 0.25) + least(({num}) * 0.2::DOUBLE, 0.3) + least({count(low, r'\([^)]+\)')} * 0.15::DOUBLE, 0.2), 1.0)"""


@query("b9_preprocess_with_complexity", f"WITH {PREPARED} SELECT row_id, clean_name, CAST({qualifier_sql('ex')} < 0.3 AS INTEGER) AS is_simple FROM cleaned")
def b9c(spark, sf):
    n = F.col("exam_name")
    return derive.feed(spark, sf).select("row_id", tx.preprocess(n).alias("clean_name"), (cx.qualifier(tx.expanded(n)) < cx.SIMPLE_INPUT).cast("int").alias("is_simple"))


_BARE = "regexp_replace(lower(w), '[^a-z0-9_]', '', 'g')"


@query("b10_b18_names", f"""
    SELECT entry_id, regexp_replace(fsn, '\\s*\\((procedure|qualifier value|finding)\\)$', '', 'i') AS bare,
      array_to_string(list_transform(string_split({squeeze_sql('primary_name')}, ' '), lambda w, i: CASE WHEN {_BARE} IN {tx.UPPER} THEN upper(w)
        WHEN {_BARE} IN ('rt', 'lt', 'both', 'bilateral') THEN CASE {_BARE} WHEN 'lt' THEN 'Left' WHEN 'rt' THEN 'Right' ELSE 'Both' END
        WHEN {_BARE} IN {tx.SMALL} AND i > 1 THEN lower(w) ELSE concat(upper(left(w, 1)), lower(substr(w, 2))) END), ' ') AS titled,
      CASE WHEN entry_id % 3 = 0 AND NOT contains(lower(regexp_replace(primary_name, '\\s+(lt|rt|left|right|both|bilateral)$', '', 'i')), 'with contrast')
        THEN regexp_replace(primary_name, '\\s+(lt|rt|left|right|both|bilateral)$', '', 'i') || ' with contrast' ELSE regexp_replace(primary_name, '\\s+(lt|rt|left|right|both|bilateral)$', '', 'i') END AS rewritten
    FROM ({CAT})""")  # fmt: skip
def b10(spark, sf):
    n = F.col("primary_name")
    return derive.catalogue(spark, sf).select("entry_id", tx.strip_fsn(F.col("fsn")).alias("bare"), tx.title_case(n).alias("titled"), tx.rewrite_name(n, F.col("entry_id") % 3 == 0).alias("rewritten"))


def norm_sql(e: str) -> str:
    return f"lower({squeeze_sql(f'coalesce({e}, {lit("")})')})"


_F = {c: f"replace({norm_sql(c)}, '|', '%7C')" for c in ("data_source", "exam_code", "exam_name", "modality_code")}
_PRE = f"'v1|ds:' || {_F['data_source']} || '|ec:' || {_F['exam_code']} || '|en:' || {_F['exam_name']} || '|mc:' || {_F['modality_code']}"


@query("b12_b14_keys", f"""SELECT row_id, {_PRE} AS preimage, sha256({_PRE}) AS key_v1, sha256('v2' || substr({_PRE}, 3) || '|lat:' || CASE WHEN row_id % 2 = 0 THEN 'left' ELSE '' END) AS key_v2,
    sha256(concat_ws('|', {', '.join(norm_sql(c) for c in ('data_source', 'exam_code', 'exam_name', 'modality_code'))})) AS key_api,
    sha256(concat_ws('|', {', '.join(norm_sql(c) for c in ('exam_code', 'exam_name', 'data_source'))})) AS key_engine,
    sha256(concat_ws('|', {', '.join(norm_sql(c) for c in ('exam_code', 'exam_name', 'data_source', 'exam_name'))})) AS key_ui,
    md5(array_to_string(list_sort([exam_name, exam_code, data_source]), '|')) AS key_list FROM ({FEED})""")  # fmt: skip
def b13(spark, sf):
    ds, ec, en, mc = (F.col(c) for c in ("data_source", "exam_code", "exam_name", "modality_code"))
    side = F.when(F.col("row_id") % 2 == 0, "Left ").otherwise(None)
    return derive.feed(spark, sf).select(
        "row_id", tx.preimage(ds, ec, en, mc).alias("preimage"), tx.request_key(ds, ec, en, mc).alias("key_v1"), tx.request_key(ds, ec, en, mc, side).alias("key_v2"),
        tx.legacy_key("api", ds, ec, en, mc).alias("key_api"), tx.legacy_key("engine", ds, ec, en).alias("key_engine"), tx.legacy_key("ui", ds, ec, en, clean=en).alias("key_ui"),
        tx.comparison_key(F.array(en, ec, ds)).alias("key_list"),
    )


@query("b15_poly_hash")
def b15(spark, sf):
    n = F.col("exam_name")
    return derive.feed(spark, sf).select("row_id", tx.poly_hash(n).alias("unsigned"), tx.poly_hash(n, signed=True).alias("absolute"))


@query("b16_parse_money", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(round(o_totalprice, 2) AS DECIMAL(10, 2)) END AS amount FROM orders""")
def b16(spark, sf):
    text = F.when(F.col("o_orderkey") % 9 == 0, "-").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", tx.parse_money(text).alias("amount"))


@query("b17_display_name", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE o_orderstatus END AS status FROM orders""")
def b17(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", tx.display_name(F.col("o_orderstatus"), {"O": "Open", "F": "Filled"}).alias("status"))


@query("b19_parse_choice", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS choice, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 0.0 ELSE round(value / 1000, 6) END AS confidence FROM events""")
def b19(spark, sf):
    k, c = F.col("event_id"), F.round(F.col("value") / 1000, 6)
    note = F.struct(F.lit(1).alias("k"), F.lit('a "quoted" } {').alias("why"))
    body = F.when(k % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("choice")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("choice"), note.alias("m"), c.alias("confidence"))))
    text = F.when(k % 5 == 0, "no answer").otherwise(F.concat(F.lit("Sure, here it is: "), body, F.lit(" done {")))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", tx.parse_choice(text).alias("p")).select("event_id", "p.choice", "p.confidence")


_VOC = {k.lower(): v for k, v in cp.VOCABULARY.items()}
_VOC_PATTERN = r"\b(" + "|".join(sorted(_VOC, key=lambda k: -len(k))) + r")\b"
_VOC_CASE = "CASE t " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in _VOC.items()) + " END"


def anatomy_sql(e: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(lower({e}), {lit(_VOC_PATTERN)}, 1), lambda t: {_VOC_CASE})))"


def modality_sql(e: str, code: str) -> str:
    known = f"CASE upper({code}) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in cp.MODALITY_CODES.items()) + " END"
    found = f"list_sort(list_distinct({tag_list((m, has(f'lower({e})', p)) for m, p in cp.MODALITY_PATTERNS)}))"
    return f"CASE WHEN upper({code}) <> 'OTHER' AND {known} IS NOT NULL THEN [{known}] ELSE {found} END"


def side_sql(e: str) -> str:
    left, right = has(f"lower({e})", r"\bleft\b"), has(f"lower({e})", r"\bright\b")
    return f"CASE WHEN {has(f'lower({e})', r'\bbilateral\b')} OR ({left} AND {right}) THEN 'bilateral' WHEN {left} THEN 'left' WHEN {right} THEN 'right' END"


def contrast_sql(e: str) -> str:
    return tag_list((("with", has(f"lower({e})", r"\bwith contrast\b")), ("without", has(f"lower({e})", r"\bwithout contrast\b"))))


def technique_sql(e: str) -> str:
    low, pairs = f"lower({e})", []
    for label, patterns in cp.TECHNIQUES.items():
        plain = [p for p in patterns if "(?!" not in p]
        test = has(low, "|".join(plain))
        if len(plain) < len(patterns):  # a negative lookahead, as two tests
            test = f"({test} OR ({has(low, r'\b(insertion|insert)\b')} AND NOT {has(low, r'\b(insertion|insert)\b.*\b(picc|line|catheter)\b')}))"
        pairs.append((label, test))
    return f"list_sort({tag_list(pairs)})"


PARSED = f"""{PREPARED}, parsed AS (SELECT row_id, exam_name, data_source, exam_code, modality_code, clean_name, {modality_sql('clean_name', 'modality_code')} AS modality, {anatomy_sql('clean_name')} AS anatomy,
    {side_sql('clean_name')} AS laterality, {contrast_sql('clean_name')} AS contrast, {technique_sql('clean_name')} AS technique FROM cleaned)"""


@query("c1_c6_components", f"""WITH {PARSED} SELECT row_id, array_to_string(modality, ',') AS modality, array_to_string(anatomy, ',') AS anatomy, laterality, array_to_string(contrast, ',') AS contrast, array_to_string(technique, ',') AS technique,
    concat_ws(' ', CASE WHEN len(modality) > 0 THEN array_to_string(modality, '+') ELSE 'Unknown' END, CASE WHEN list_contains(technique, 'Diagnostic Angiography') THEN 'Angiogram' END,
      CASE WHEN len(anatomy) > 0 THEN array_to_string(anatomy, ' ') END, CASE laterality WHEN 'left' THEN 'Lt' WHEN 'right' THEN 'Rt' WHEN 'bilateral' THEN 'Both' END) AS built FROM parsed""")  # fmt: skip
def c1(spark, sf):
    f = derive.feed(spark, sf).select("row_id", "modality_code", tx.preprocess(F.col("exam_name")).alias("clean_name"))
    f = f.select("row_id", cp.components(F.col("clean_name"), F.col("modality_code")).alias("c")).select("row_id", "c.*")
    built = cp.build_name(F.col("modality"), F.col("technique"), F.col("anatomy"), F.col("laterality"))
    return f.select("row_id", *[F.array_join(c, ",").alias(c) for c in ("modality", "anatomy")], "laterality", *[F.array_join(c, ",").alias(c) for c in ("contrast", "technique")], built.alias("built"))


def terms_sql(e: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({e}), {lit(t)}) OR list_contains({anatomy_sql(e)}, {lit(t)})" for t in terms) + ")"


@query("c7_c8_contexts", f"""SELECT row_id, CASE WHEN {has('lower(exam_name)', cp.PREGNANCY)} THEN 'pregnancy' WHEN {terms_sql('exam_name', cp.FEMALE_TERMS)} OR {has('lower(exam_name)', cp.FEMALE)} THEN 'female'
      WHEN {terms_sql('exam_name', cp.MALE_TERMS)} OR {has('lower(exam_name)', cp.MALE)} THEN 'male' END AS gender, CASE WHEN {has('lower(exam_name)', cp.PAEDIATRIC)} THEN 'paediatric' WHEN {has('lower(exam_name)', cp.ADULT)} THEN 'adult' END AS age,
      array_to_string({tag_list((c, has('lower(exam_name)', p)) for c, p in cp.CLINICAL.items())}, ',') AS clinical, array_to_string({tag_list((t, f"contains(lower(exam_name), {lit(t)})") for t in cp.INTERVENTIONS)}, ',') AS interventions FROM ({FEED})""")  # fmt: skip
def c7(spark, sf):
    n = F.col("exam_name")
    return derive.feed(spark, sf).select(
        "row_id", cp.gender_context(n, cp.extract_vocab(n)).alias("gender"), cp.age_context(n).alias("age"), F.array_join(cp.clinical_context(n), ",").alias("clinical"), F.array_join(cp.intervention_terms(n), ",").alias("interventions")
    )


_low = "lower(primary_name)"
_WEAK = ", ".join(
    ["CASE " + " ".join(f"WHEN starts_with(primary_name, {lit(k)}) THEN {lit('Modality:' + v)}" for k, v in cp.LABEL_MODALITIES.items()) + " END"]
    + [f"CASE WHEN contains({_low}, {lit(a.lower())}) THEN {lit('Anatomy:' + a)} END" for a in cp.LABEL_ANATOMY]
    + [f"CASE WHEN contains({_low}, 'contrast') THEN CASE WHEN contains({_low}, 'without') THEN 'Contrast:Without' WHEN contains({_low}, 'with and without') THEN 'Contrast:WithAndWithout' ELSE 'Contrast:With' END END"]
    + [f"CASE WHEN contains({_low}, 'left') THEN 'Laterality:Left' WHEN contains({_low}, 'right') THEN 'Laterality:Right' WHEN contains({_low}, 'bilateral') OR contains({_low}, 'both') THEN 'Laterality:Bilateral' END"]
    + ["CASE WHEN contains(lower(fsn), 'male') OR contains(lower(fsn), 'prostate') THEN 'Gender:Male' WHEN contains(lower(fsn), 'pregnancy') OR contains(lower(fsn), 'uterus') OR contains(lower(fsn), 'ovary') THEN 'Gender:Female' END"]
)


@query("c9_weak_tags", f"SELECT entry_id, array_to_string(list_filter([{_WEAK}], lambda x: x IS NOT NULL), ',') AS tags FROM ({CAT})")
def c9(spark, sf):
    return derive.catalogue(spark, sf).select("entry_id", F.array_join(cp.weak_tags(F.col("fsn"), F.col("primary_name")), ",").alias("tags"))


def structural_sql(e: str) -> str:
    low = f"lower({e})"
    words = f"greatest(len(regexp_extract_all({low}, '[^\\s]+')), 1)::DOUBLE"
    prep = " + ".join(f"CAST(contains(' ' || {low} || ' ', ' {p} ') AS INTEGER)" for p in cx.PREPOSITIONS)
    conj = " + ".join(f"CAST(contains({low}, {lit(c)}) AS INTEGER)" for c in cx.CONJUNCTIONS)
    adj = " + ".join(f"len(regexp_extract_all({low}, {lit(p)}))" for p in cx.ADJECTIVES)
    return f"least(least(({prep}) / {words} * 2.0, 0.3) + least(({conj}) * 0.15::DOUBLE, 0.3) + least(({adj}) / {words} * 0.4, 0.25), 1.0)"


def terminology_sql(e: str) -> str:
    low = f"lower({e})"
    words = f"regexp_extract_all({low}, '[^\\s]+')"
    roots = " + ".join(f"CAST(contains({low}, {lit(c)}) AS INTEGER)" for c in cx.CLASSICAL)
    hyph = f"len(regexp_extract_all({low}, {lit(r'\b\w+-\w+\b')}))"
    long = f"len(list_filter({words}, lambda w: length(w) > 8 AND regexp_full_match(w, '\\p{{L}}+')))"
    return f"least(least({hyph} * 0.2::DOUBLE, 0.4) + least({long} / greatest(len({words}), 1)::DOUBLE * 0.5, 0.3) + least(({roots}) * 0.15::DOUBLE, 0.3), 1.0)"


_D = f"""SELECT entry_id, {structural_sql('fsn')} AS structural, {terminology_sql('fsn')} AS terminology, {qualifier_sql('primary_name')} AS qualifier, {structural_sql('primary_name')} + {terminology_sql('primary_name')} AS p FROM ({CAT})"""
_DT = f"SELECT *, least(structural + terminology, 1.0) AS total, least(p, 1.0) AS primary_total FROM ({_D})"


@query("d1_d5_complexity", f"""SELECT entry_id, round(structural, 6) AS structural, round(terminology, 6) AS terminology, round(qualifier, 6) AS qualifier, round(total, 6) AS total, CAST(total > 0.67 AS INTEGER) AS is_complex,
    round(CASE WHEN qualifier < 0.3 THEN CASE WHEN greatest(0, total - primary_total) >= 0.2 THEN greatest(0.2, 1 - greatest(0, total - primary_total) * 2) ELSE 1.0 END
      WHEN qualifier > 0.5 THEN least(1.0, 0.7 + greatest(0, total - primary_total) * 0.5) ELSE greatest(0.3, 1 - abs(total - qualifier)) END, 6) AS appropriate FROM ({_DT})""")  # fmt: skip
def d1(spark, sf):
    c = derive.catalogue(spark, sf)
    f, p = F.col("fsn"), F.col("primary_name")
    m = c.select("entry_id", cx.structural(f).alias("structural"), cx.terminology(f).alias("terminology"), cx.qualifier(p).alias("qualifier"), cx.total_complexity(f).alias("total"), cx.total_complexity(p).alias("primary_total"))
    return m.select("entry_id", *[F.round(x, 6).alias(x) for x in ("structural", "terminology", "qualifier", "total")], (F.col("total") > cx.COMPLEX_NAME).cast("int").alias("is_complex"), F.round(cx.appropriateness(F.col("qualifier"), F.col("total"), F.col("primary_total")), 6).alias("appropriate"))


_D6 = f"""WITH t AS (SELECT entry_id, total, CASE WHEN total < 0.3 THEN 'simple' WHEN total <= 0.67 THEN 'moderate' ELSE 'complex' END AS bucket FROM ({_DT})),
    e AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY entry_id) AS r FROM t)
    SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 6) AS share, round(avg(total), 6) AS mean, round(median(total), 6) AS median, round(stddev_samp(total), 6) AS stdev,
      round(min(total), 6) AS low, round(max(total), 6) AS high, round(max(total) - min(total), 6) AS span, string_agg(CASE WHEN r <= 5 THEN CAST(entry_id AS VARCHAR) END, ',' ORDER BY entry_id) AS examples FROM e GROUP BY bucket"""


@query("d6_complexity_profile", _D6)
def d6(spark, sf):
    from ..operators.reports import complexity_profile

    c = derive.run(spark, sf, derive.CATALOGUE, "part").select("entry_id", "fsn")
    c = once_each(c, ["fsn"], lambda names: names.withColumn("total", cx.total_complexity(F.col("fsn")))).select("entry_id", "total")
    return complexity_profile(rd.checkpointed(c))  # medians read the totals again and again
