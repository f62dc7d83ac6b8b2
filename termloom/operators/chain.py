"""The whole standardisation as one plan: branches that leave early are columns, so candidates are made and scored once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval, scoring
from ..sources.readers import shared_path
from .distinct import joined, spread

#: Why a row has no match, in the order of the checks.
REJECTED = "All candidates were previously rejected by human validation."
NO_MODALITY = "No candidates found after modality filtering."
NOT_CLINICAL = "EXCLUDED_NON_CLINICAL"


@dataclass
class Decisions:
    """What reviewers decided before: approved (key, approved_name), rejected (key, concept_id), approved_results (result_key, approved_name), rejected_results (result_key)."""

    approved: DataFrame
    rejected: DataFrame
    approved_results: DataFrame
    rejected_results: DataFrame


def word_cosine(a: Column, b: Column) -> Column:
    """The cosine of two texts as vectors over the words of either."""
    wa, wb = retrieval.tokens(a), retrieval.tokens(b)
    vector = lambda ws, all_words: F.transform(all_words, lambda t: F.array_contains(ws, t).cast("double"))
    every = F.array_union(wa, wb)
    return retrieval.cosine(vector(wa, every), vector(wb, every))


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: the least of the others, so equal decisions don't multiply rows."""
    rest = [c for c in df.columns if c != key]
    least = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_v")) if rest else df.filter(F.col(key).isNotNull()).distinct()
    return least.select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


#: What of a candidate is in the result.
ENTRY = ("entry_id", "concept_id", "entry_side", "cat_text", "cat_fsn", "cat_anatomy", "cat_modality", "cat_technique", "cat_contrast", "cat_laterality")


def exam_candidates(exams: DataFrame, catalogue: DataFrame, dictionary: dict[str, str], like: Callable, alike: Callable, k: int) -> DataFrame:
    """The candidates of each exam with all that doesn't depend on the row: scores, sides, and both names a result may have.

    `fits`: of the exam's modality. `bucket`: for simple inputs names like the input go first, then simple entries, then complex ones.
    """
    c = F.col
    cands = retrieval.blocked_candidates(scoring.input_features(exams, dictionary), scoring.entry_features(catalogue, dictionary), k, "left")
    cands = cands.repartition(2 * cands.sparkSession.sparkContext.defaultParallelism, "exam_id")  # few bytes with much work on each, which would all go to one task
    first = F.upper(F.get("in_modality", F.lit(0)))
    fits = first.isNull() | (F.size("cat_modality") == 0) | F.exists("cat_modality", lambda m: F.upper(m) == first)
    close = F.coalesce(like(F.lower(F.trim("in_text")), F.lower(F.trim("cat_text"))), F.lit(0.0))
    cands = scoring.scored(cands.withColumns({"fits": F.coalesce(fits, F.lit(False)), "close": close}), dictionary)
    wants = F.coalesce(F.get("in_contrast", F.lit(0)) == "with", F.lit(False))
    sides = (c("entry_side"), c("cat_laterality"), c("in_laterality"))
    cands = cands.withColumns({
        "bucket": F.when(~c("in_simple"), 0).when(c("close") > 0.7, 0).when(~c("cat_complex"), 1).otherwise(2), "veto": F.coalesce(scoring.contrast_veto(), F.lit(False)),
        "strip": scoring.needs_peer(*sides), "side_ambiguous": scoring.laterality_ambiguous(*sides),
        "both": F.when(c("entry_side").isNotNull(), c("entry_side") == "bilateral").otherwise(F.coalesce(c("cat_laterality"), F.lit("bilateral")) == "bilateral"),
        "sig": scoring.signature(c("cat_modality"), c("cat_anatomy"), c("cat_contrast"), c("cat_technique")),
        "name": F.trim(scoring.rewrite_name(c("cat_text"), wants, F.lit(False))), "bare": F.trim(scoring.rewrite_name(c("cat_text"), wants, F.lit(True))),
    })
    return cands.withColumns({"alike_name": alike(c("in_text"), c("name")), "alike_bare": alike(c("in_text"), c("bare"))})


def gathered(cands: DataFrame, inputs: list[str]) -> DataFrame:
    """A row per exam: `found`, its candidates in the order of their buckets, as rows choose among them, and `details` of each, at the same place.

    `peers` of a candidate are the places of those that may stand in for it: of its concept and components, and for both sides.
    """
    item = F.struct("bucket", "cand_pos", *ENTRY, "fits", "component", "veto", "strip", "side_ambiguous", "both", "sig", "name", "bare", "alike_name", "alike_bare")
    rows = cands.groupBy("exam_id", *inputs).agg(F.array_sort(F.collect_list(F.when(F.col("entry_id").isNotNull(), item))).alias("c"))
    places = F.transform("c", lambda x, i: F.struct(i.alias("at"), x["both"].alias("both"), x["concept_id"].alias("concept_id"), x["sig"].alias("sig")))
    rows = rows.withColumn("places", places)
    peers = lambda x: F.transform(F.filter("places", lambda y: y["both"] & y["concept_id"].eqNullSafe(x["concept_id"]) & (y["sig"] == x["sig"])), lambda y: y["at"])
    pick = lambda x, names: [x[n].alias(n) for n in names]
    found = F.transform("c", lambda x, i: F.struct(i.alias("at"), *pick(x, ("entry_id", "concept_id", "fits", "component", "veto", "strip")), peers(x).alias("peers")))
    details = F.transform("c", lambda x: F.struct(*pick(x, (*ENTRY, "side_ambiguous", "name", "bare", "alike_name", "alike_bare"))))
    return rows.select("exam_id", *inputs, found.alias("found"), details.alias("details"))


def rejections(rows: DataFrame, cands: DataFrame, rejected: DataFrame) -> DataFrame:
    """(key, exam_id, rejected): of the candidates' concepts, those that reviewers rejected for the key; there are at most the retriever's k."""
    no = rejected.select("key", "concept_id").filter("key is not null and concept_id is not null").distinct()
    asked = rows.select("key", "exam_id").join(no.select("key").distinct(), "key", "left_semi").distinct()
    concepts = cands.filter("concept_id is not null").select("exam_id", "concept_id").distinct()
    return asked.join(concepts, "exam_id").join(no, ["key", "concept_id"]).groupBy("key", "exam_id").agg(F.collect_set("concept_id").alias("rejected"))


def choose(rows: DataFrame, rerank: Callable[[Column], Column], rules: dict = scoring.RULES) -> DataFrame:
    """`rows` with `found` and `rejected`: error or null, the places of the best candidate and of the match, the confidence and all live candidates, best first.

    Where the side of the best is in doubt (`scoring.needs_peer`), the first live candidate of the same concept and components that stands for both sides
    takes its place, if there is one. `rerank` gives the score of a candidate of `found`.
    """
    c = F.col
    component, weight = rules["final"]["general"]
    rows = rows.withColumn("kept", F.filter("found", lambda x: ~F.coalesce(F.array_contains("rejected", x["concept_id"]), F.lit(False))))
    live = F.transform(F.filter("kept", lambda x: x["fits"]), lambda x: F.struct(x.alias("x"), rerank(x).alias("rerank")))
    rows = rows.withColumn("live", live)
    top, step = rules["position"]
    placed = c("in_simple") & (F.size("live") > 1)
    position = lambda i: F.when(placed, F.greatest(F.lit(0.0), top - step * i)).otherwise(0.0)
    final = lambda x, i: F.round(F.when(x["x"]["veto"], 0.0).otherwise(weight * x["rerank"] + component * x["x"]["component"] + position(i)), 9)
    rows = rows.withColumn("c", F.array_sort(F.transform("live", lambda x, i: F.struct((-final(x, i)).alias("o"), i.alias("p"), x["x"]["at"].alias("at")))))
    error = F.when((F.size("found") > 0) & (F.size("kept") == 0), REJECTED).when(F.size("live") == 0, NO_MODALITY).when(F.forall("live", lambda x: x["rerank"] == 0), NOT_CLINICAL)
    rows = rows.withColumn("error", error).withColumn("best", F.when(c("error").isNull(), F.get("found", F.get("c", F.lit(0))["at"])))
    alive = lambda at: F.exists("live", lambda x: x["x"]["at"] == at)
    rows = rows.withColumn("peer", F.when(c("best.strip"), F.get(F.filter("best.peers", alive), F.lit(0))))
    listed = F.transform("c", lambda x: F.struct(F.get("details", x["at"])["entry_id"].alias("entry_id"), F.get("details", x["at"])["concept_id"].alias("concept_id"), F.get("details", x["at"])["cat_text"].alias("name"), F.round(-x["o"], 2).alias("confidence")))
    return rows.select(
        *[n for n in rows.columns if n not in ("kept", "live", "c", "peer", "best", "found", "rejected", "details")], c("best.at").alias("best_at"), F.coalesce("best.strip", F.lit(False)).alias("strip"), c("peer").isNotNull().alias("by_peer"),
        F.when(c("error").isNull(), -F.get("c", F.lit(0))["o"]).alias("confidence"), F.get("details", F.coalesce("peer", "best.at")).alias("match"), F.get("details", c("best.at"))["side_ambiguous"].alias("side_ambiguous"),
        F.when(c("error").isNull(), listed).alias("candidates"),
    )


def assemble(rows: DataFrame, limit: float = 0.3, cap: float = 0.2) -> DataFrame:
    """The nested result: contexts of the input, components and codes of the match, and the check that the result is like its input."""
    c = F.col
    m, found = lambda n: c(f"match.{n}"), c("error").isNull()
    rows = rows.withColumn("clean_name", F.when(found, F.when(c("strip"), m("bare")).otherwise(m("name"))))
    rows = rows.withColumn("similarity", F.when(found, F.when(c("strip"), m("alike_bare")).otherwise(m("alike_name"))))
    low = found & (c("similarity") < limit)
    diagnostic = ~F.exists(m("cat_technique"), lambda t: t.contains("Interventional"))
    confidence = F.when(~found, 0.0).when(low, F.least("confidence", F.lit(cap))).otherwise(c("confidence"))
    parts = [m(f"cat_{n}").alias(n) for n in ("anatomy", "laterality", "contrast", "technique", "modality")]
    contexts = [c("in_gender").alias("gender_context"), c("in_age").alias("age_context"), c("in_clinical").alias("clinical_context")]
    return rows.select(
        "row_id", "key", "error", "clean_name", confidence.alias("confidence"), F.when(found, diagnostic).alias("is_diagnostic"),
        F.when(found, c("side_ambiguous") | c("strip") | F.coalesce(c("biopsy_ambiguous"), F.lit(False)) | low).alias("ambiguous"), "by_peer",
        F.when(low, F.struct(c("similarity"), c("confidence").alias("was"))).alias("audit"),
        F.when(found, F.struct(m("concept_id"), m("entry_id"), m("cat_fsn").alias("fsn"), m("entry_side").alias("laterality"))).alias("snomed"),
        F.when(found, F.struct(*parts, c("confidence").alias("confidence"), *contexts)).alias("components"), "candidates",
    )


def overridden(rows: DataFrame, decisions: Decisions) -> DataFrame:
    """Decisions on the result itself: an approved one replaces it, a rejected one is marked. `status` says which."""
    yes = once(decisions.approved_results.select("result_key", "approved_name"), "result_key")
    no = decisions.rejected_results.select("result_key").distinct().withColumn("_no", F.lit(True))
    rows = rows.withColumn("result_key", F.when(F.col("error").isNull(), F.concat_ws("|", "key", "clean_name")))
    # failed rows have no result; they are dealt by row, not all to one task
    alone = F.lit(None).cast("long")
    rows = rows.withColumn("_alone", F.when(F.col("result_key").isNull(), F.xxhash64("row_id")))
    for d in (yes, no):
        rows = rows.alias("l").join(d.withColumn("_alone", alone).alias("r"), (F.col("l.result_key") == F.col("r.result_key")) & F.col("l._alone").eqNullSafe(F.col("r._alone")), "left").select("l.*", *[f"r.{n}" for n in d.columns if n != "result_key"])
    approved = F.col("approved_name").isNotNull()
    status = F.when(F.col("error").isNotNull(), "failed").when(approved, "approved_by_human").when(F.col("_no"), "rejected_by_human").otherwise("pending")
    rows = rows.withColumn("status", status).withColumn("original_confidence", F.when(approved, F.col("confidence")))
    rows = rows.withColumn("confidence", F.when(approved, 1.0).otherwise(F.col("confidence"))).withColumn("clean_name", F.coalesce("approved_name", "clean_name"))
    return rows.drop("approved_name", "_no", "result_key", "_alone").withColumn("early", F.lit(False))


def standardise(
    inputs: DataFrame, catalogue: DataFrame, decisions: Decisions, dictionary: dict[str, str], rerank: Callable[[DataFrame], DataFrame] | Callable[[Column], Column],
    like: Callable[[Column, Column], Column] = retrieval.fuzzy_ratio, alike: Callable[[Column, Column], Column] = word_cosine, k: int = 15, by_expression: bool = False,
) -> DataFrame:
    """One result per input, by the whole chain.

    An input approved before leaves at once. For the others: candidates, less those rejected for this input, less those of another
    modality; a new order for simple inputs; scores; the best, or the peer for both sides in its place; the nested result,
    checked against its input; decisions on the result. Rows that lose all candidates stay, with their `error`.

    `inputs`: row_id, key, in_ columns (with in_simple, in_gender, in_age, in_clinical); `catalogue`: concept_id, entry_id, entry_side, cat_ columns (with
    cat_complex); both sides get their features for the rules here. `rerank` adds `rerank` to a table of candidates, a row for each input and candidate; with `by_expression` it
    makes a column from a candidate (entry_id, concept_id) and the input's row_id, and no such table is made. Missing scores are neutral. A null key has no decisions.

    Inputs with equal in_ columns are one exam, named by its least row_id. Candidates are made and scored once for each exam; what depends on the row is found in arrays.
    """
    c, ins = F.col, [n for n in inputs.columns if n.startswith("in_")]
    known = once(decisions.approved.select("key", "approved_name"), "key")
    inputs = inputs.select("row_id", "key", F.struct(*ins).alias("exam")).join(known, "key", "left")
    late = inputs.filter("approved_name is null").drop("approved_name")
    exams = late.groupBy("exam").agg(F.min("row_id").alias("exam_id"))
    cands = exam_candidates(spread(exams, ["exam_id", "exam"]).select("exam_id", "exam.*"), catalogue, dictionary, like, alike, k)
    # kept in a table: it is read three times, and a plan that holds its making as often takes much of the driver's memory
    spark = inputs.sparkSession
    at = f"{shared_path(spark)}/found"
    gathered(cands, ins).withColumn("biopsy_ambiguous", scoring.biopsy_ambiguous(c("in_text"))).write.parquet(at)
    found = spark.read.parquet(at)
    rows = joined(late, found.select(F.struct(*ins).alias("exam"), "exam_id"), ["exam"]).drop("exam")
    concepts = found.select("exam_id", F.explode("found.concept_id").alias("concept_id"))
    scores = rerank
    if not by_expression:
        each = rerank(joined(rows, cands.filter("entry_id is not null"), ["exam_id"])).filter("rerank is not null").groupBy("row_id").agg(F.collect_list(F.struct("entry_id", "rerank")).alias("reranked"))
        rows = rows.join(each, "row_id", "left")
        scores = lambda x: F.get(F.filter("reranked", lambda y: y["entry_id"] == x["entry_id"]), F.lit(0))["rerank"]
    rows = rows.join(rejections(rows, concepts, decisions.rejected), ["key", "exam_id"], "left")
    rows = choose(joined(rows, found, ["exam_id"]), lambda x: F.coalesce(scores(x), F.lit(0.5)))
    rows = overridden(assemble(rows), decisions)
    early = inputs.filter("approved_name is not null").select("row_id", "key", c("approved_name").alias("clean_name"), F.lit(1.0).alias("confidence"), F.lit("approved_by_human").alias("status"), F.lit(True).alias("early"))
    return rows.unionByName(early, allowMissingColumns=True)
