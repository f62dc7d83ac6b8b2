"""Decisions: preflight, overrides, review state and its transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest `order` of each key, by a map-side maximum."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v"), F.max(order).alias(order))
    return best.select(key, order, *[F.col(f"_v.{c}").alias(c) for c in rest])


def preflight(df: DataFrame, approved: DataFrame, rejected: DataFrame, key: str = "key") -> DataFrame:
    """`df` with cache_type and cached_skip: rejected wins, then approved, else the row is to be processed."""
    a = approved.select(F.col(key).alias("_ka")).distinct()
    r = rejected.select(F.col(key).alias("_kr")).distinct()
    joined = df.join(r, F.col(key) == F.col("_kr"), "left").join(a, F.col(key) == F.col("_ka"), "left")
    kind = F.when(F.col("_kr").isNotNull(), "rejected").when(F.col("_ka").isNotNull(), "approved").otherwise("process")
    return joined.withColumn("cache_type", kind).withColumn("cached_skip", kind != "process").drop("_ka", "_kr")


def early_approval(df: DataFrame, approved: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(approved rows with confidence 1, the rows left to process)."""
    done = df.join(approved, key, "left_semi").withColumn("confidence", F.lit(1.0)).withColumn("approved_by_human", F.lit(True))
    return done, df.join(approved, key, "left_anti")


def drop_rejected(cands: DataFrame, rejected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates without rejected ones, inputs that lost all)."""
    left = cands.join(rejected, keys, "left_anti")
    lost = cands.select(keys[0]).distinct().join(left.select(keys[0]).distinct(), keys[0], "left_anti")
    return left, lost.withColumn("error", F.lit("all candidates were rejected"))


def override(df: DataFrame, approved: DataFrame, rejected: DataFrame, key: str = "key") -> DataFrame:
    """Approved results replace the match and keep its confidence as `original_confidence`; rejected ones are marked."""
    a = approved.select(F.col(key).alias("_ka"), F.col("result").alias("_result"))
    r = rejected.select(F.col(key).alias("_kr")).distinct()
    j = df.join(a, F.col(key) == F.col("_ka"), "left").join(r, F.col(key) == F.col("_kr"), "left")
    yes, no = F.col("_ka").isNotNull(), F.col("_kr").isNotNull()
    return (
        j.withColumn("original_confidence", F.when(yes, F.col("confidence")))
        .withColumn("result", F.coalesce("_result", "result"))
        .withColumn("confidence", F.when(yes, 1.0).otherwise(F.col("confidence")))
        .withColumn("status", F.when(yes, "approved").when(no, "rejected").otherwise("pending"))
        .drop("_ka", "_kr", "_result")
    )


def needs_second_opinion(ambiguous: Column, confidence: Column, safeguarded: Column, limit: float = 0.8) -> Column:
    return ambiguous | (confidence < limit) | safeguarded


def merge_improved(df: DataFrame, improved: DataFrame, key: str = "row_id") -> DataFrame:
    """Better results by row id; every row stays."""
    new = improved.select(F.col(key).alias("_k"), F.col("result").alias("_result"), F.col("confidence").alias("_confidence"))
    j = df.join(new, F.col(key) == F.col("_k"), "left")
    return j.withColumn("second_opinion", F.col("_k").isNotNull()).withColumn("was", F.col("confidence")).withColumn("result", F.coalesce("_result", "result")).withColumn("confidence", F.coalesce("_confidence", "confidence")).drop("_k", "_result", "_confidence")


def init_review(df: DataFrame, approved: DataFrame, rejected: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """One row per key (the last wins), with its status from earlier decisions."""
    return preflight(last_wins(df, key, order), approved, rejected, key).withColumn("status", F.when(F.col("cache_type") == "process", "pending").otherwise(F.col("cache_type"))).drop("cache_type", "cached_skip")


STATUS = {"approve": "approved", "reject": "rejected", "modify": "modified", "unapprove": "pending", "skip": "skipped", "unreject": "pending", "unskip": "pending", "reviewed": "reviewed"}


def apply_decisions(state: DataFrame, decisions: DataFrame, key: str = "mapping_id") -> tuple[DataFrame, DataFrame]:
    """(new state, errors): later decisions win; unknown ids, unknown words and corrections without a value are errors."""
    known = decisions.join(state.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left")
    why = (
        F.when(F.col("_k").isNull(), "unknown mapping")
        .when(~F.coalesce(F.col("decision").isin("approve", "reject", "modify"), F.lit(False)), "unknown decision")
        .when((F.col("decision") == "modify") & F.col("correction").isNull(), "no correction")
    )
    judged = known.withColumn("error", why).drop("_k")
    last = last_wins(judged.filter("error is null").select(key, "seq", "decision", "correction"), key, "seq")
    new = state.join(last, key, "left")
    words = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    new = new.withColumn("status", F.coalesce(words[F.col("decision")], "status")).withColumn("value", F.coalesce(F.when(F.col("decision") == "modify", F.col("correction")), "value"))
    return new.drop("correction", "seq"), judged.filter("error is not null")


def batch_decisions(decisions: DataFrame, store: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(approved store, rejected, counters): a decision's key is explicit or falls back to its original; unapprove removes."""
    d = decisions.withColumn(key, F.coalesce(key, "original_key"))
    last = last_wins(d.select(key, "seq", "decision"), key, "seq")
    approved = last.filter("decision = 'approve'").select(key)
    kept = store.select(key).unionByName(approved).distinct().join(last.filter("decision in ('unapprove', 'reject')"), key, "left_anti")
    counts = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return kept, last.filter("decision = 'reject'").select(key), counts


def transition(state: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The status after the last event of each mapping."""
    words = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    last = last_wins(events.select(key, "seq", "event"), key, "seq")
    return state.join(last, key, "left").withColumn("status", F.coalesce(words[F.col("event")], "status")).drop("seq", "event")


def decision_counts(state: DataFrame) -> DataFrame:
    """Counters by status and of flagged rows; `committable` if anything is decided."""
    s = F.col("status")
    counts = state.agg(*[F.count_if(s == v).alias(v) for v in ("approved", "rejected", "skipped", "pending")], F.count_if("flagged").alias("flagged"))
    return counts.withColumn("committable", (F.col("approved") + F.col("rejected") + F.col("skipped") > 0).cast("int"))


def flag_mappings(state: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Manual flags merged into the state; a flag creates the state where there is none."""
    return state.join(flags, key, "full_outer").withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("flagged", F.col("reason").isNotNull())


def final_export(approved: DataFrame, boost: float = 0.1, most: float = 0.98) -> DataFrame:
    """Approved rows with a boosted confidence and their validation record."""
    return approved.withColumn("final_confidence", F.least(F.lit(most), F.col("confidence") + boost)).withColumn("validated", F.struct(F.lit(True).alias("ok"), F.col("confidence").alias("was")))


def singletons(df: DataFrame, name: str) -> DataFrame:
    """`df` with `is_singleton`: its name occurs once. Counts are pre-aggregated, so a common name is no hot window."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts.withColumnRenamed(name, "_name"), F.col(name).eqNullSafe(F.col("_name"))).withColumn("is_singleton", F.col("_n") == 1).drop("_name", "_n")


def attention_flags(ruleset: str, confidence: Column, ambiguous: Column, found: Column, components: Column, second: Column, scores: Column, singleton: Column) -> Column:
    """Why a mapping needs a reviewer, under the `offline` or the `online` rules."""
    best = F.array_sort(scores, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    gap = F.get(best, F.lit(0)) - F.get(best, F.lit(1)) > 0.15
    rules = {
        "offline": (("low_confidence", confidence < 0.85), ("ambiguous", ambiguous), ("snomed_not_found", ~found), ("missing_components", ~components), ("secondary_pipeline_used", second), ("multiple_high_confidence", F.size(F.filter(scores, lambda x: x > 0.8)) > 1), ("singleton_mapping", singleton)),
        "online": (("low_confidence", confidence < 0.85), ("ambiguous", ambiguous), ("singleton_mapping", F.size(scores) == 1), ("high_confidence_gap", gap), ("secondary_pipeline", second)),
    }[ruleset]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def priority(flags: Column, status: Column) -> Column:
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(status != "pending", "completed")
        .when((F.size(flags) >= 3) | has("snomed_not_found") | (has("low_confidence") & has("ambiguous")), "high")
        .when(has("low_confidence") | has("ambiguous") | has("multiple_high_confidence"), "medium")
        .when(F.size(flags) > 0, "low")
        .otherwise("ready")
    )


ORDER = ("high", "medium", "low", "ready", "completed")


def review_queue(state: DataFrame, n: int = 50) -> DataFrame:
    """The first n to review: by category, then confidence; a top-n, not a full sort."""
    place = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("category"))
    conf = F.when(F.col("category").isin("high", "medium", "low"), F.col("confidence")).otherwise(0.0)
    top = state.withColumn("_p", place).withColumn("_c", conf).orderBy("_p", "_c", "mapping_id").limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy("_p", "_c", "mapping_id"))).drop("_p", "_c")


def progress(state: DataFrame) -> DataFrame:
    """One row of review progress."""
    c, done = F.col("confidence"), F.col("status") != "pending"
    bands = {"below_50": c < 0.5, "50_to_80": (c >= 0.5) & (c < 0.8), "80_to_90": (c >= 0.8) & (c < 0.9), "above_90": c >= 0.9}
    return state.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.round(F.avg(c), 6).alias("mean"), *[F.count_if(t).alias(n) for n, t in bands.items()],
        F.round(100 * F.count_if(done) / F.count(F.lit(1)), 4).alias("completion"), F.count_if(F.size("flags") > 0).alias("flagged"),
    ).withColumn("advice", F.when(F.col("completion") < 50, "keep reviewing").when(F.col("mean") < 0.8, "improve the dictionary").otherwise("ready to export"))


def flag_counts(state: DataFrame) -> DataFrame:
    return state.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def flag_matrix(state: DataFrame) -> DataFrame:
    """Decisions per flag."""
    s = F.col("status")
    return state.select("status", F.explode("flags").alias("flag")).groupBy("flag").agg(*[F.count_if(s == v).alias(v) for v in ("approved", "rejected", "pending")])


def export_partition(state: DataFrame) -> DataFrame:
    """Rows by decision with the completion rate."""
    total = F.sum("n").over(Window.partitionBy())
    open_ = F.sum(F.when(F.col("status") == "pending", F.col("n")).otherwise(0)).over(Window.partitionBy())
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("completion", F.round(1 - open_ / total, 6))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
