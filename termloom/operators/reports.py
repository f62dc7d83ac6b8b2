"""Summaries and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complexity_profile(scores: DataFrame, key: str = "entry_id", score: str = "total", examples: int = 5) -> DataFrame:
    """Statistics, share and first examples of each complexity bucket. Medians come from counts by bins, so no bucket is held in one place."""
    from .ranks import medians

    s = F.col(score)
    t = scores.withColumn("bucket", F.when(s < 0.3, "simple").when(s <= 0.67, "moderate").otherwise("complex"))
    stats = t.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_samp(s), 6).alias("stdev"),
        F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"), F.round(F.max(s) - F.min(s), 6).alias("span"),
    )
    stats = with_medians(stats, medians(t, "bucket", score), "bucket")
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).filter(F.col("r") <= examples)
    listed = first.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    total = F.sum("n").over(Window.partitionBy())
    return stats.withColumn("share", F.round(F.col("n") / total, 6)).join(listed, "bucket")


def with_medians(stats: DataFrame, found: dict, group: str) -> DataFrame:
    """`stats` (a row per group) with `median`."""
    table = stats.sparkSession.createDataFrame(list(found.items()), f"{group} string, _m double")
    return stats.join(F.broadcast(table), group, "left").withColumn("median", F.round("_m", 6)).drop("_m")


#: Limits of the verdicts: the deviation, span and mean difference that carry a ranking by complexity.
SPREAD, SPAN, GAIN = (("good", 0.15), ("moderate", 0.10)), (("wide", 0.5), ("moderate", 0.3)), 0.1


def complexity_report(scores: DataFrame, full: str = "full", short: str = "short") -> DataFrame:
    """The three series (complexity of the full and of the short name, and what the full one has more), their statistics, and what they say.

    A row per series; the counts by range and the verdicts are those of the full name's series, and of the difference's for `gain`.
    """
    from .ranks import medians

    more = F.greatest(F.lit(0.0), F.col(full) - F.col(short))
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(n).alias("series"), v.alias("v")) for n, v in (("full", F.col(full)), ("short", F.col(short)), ("difference", more))])).alias("s")).select("s.*")
    v = F.col("v")
    stats = long.groupBy("series").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.count_if(v < 0.3).alias("simple"), F.count_if((v >= 0.3) & (v < 0.6)).alias("moderate"), F.count_if(v >= 0.6).alias("complex"),
    )
    stats = with_medians(stats, medians(long, "series", "v"), "series")
    span, is_full = F.col("high") - F.col("low"), F.col("series") == "full"
    grade = lambda x, steps, rest: F.when(x > steps[0][1], steps[0][0]).when(x > steps[1][1], steps[1][0]).otherwise(rest)
    r = lambda x: F.round(x, 6)
    return stats.select(
        "series", "n", r("mean").alias("mean"), "median", r("stdev").alias("stdev"), r("low").alias("low"), r("high").alias("high"), r(span).alias("span"),
        *[F.when(is_full, F.col(c)).alias(c) for c in ("simple", "moderate", "complex")], F.when(is_full, r(F.when(F.col("mean") > 0, F.col("stdev") / F.col("mean")).otherwise(0.0))).alias("variation"),
        F.when(is_full, grade(F.col("stdev"), SPREAD, "poor")).alias("spread"), F.when(is_full, grade(span, SPAN, "narrow")).alias("range"),
        F.when(F.col("series") == "difference", F.when(F.col("mean") > GAIN, "significant").otherwise("limited")).alias("gain"),
    )


def review_groups(state: DataFrame, name: str) -> DataFrame:
    """Mappings by name: members, flag union, mean confidence, sources, decisions. Flags and sources are reduced before they are listed."""
    total = state.groupBy(name).agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("confidence"), 6).alias("mean"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_if(F.col("status") == "approved").alias("approved"))
    listed = lambda values, out: state.select(F.col(name).alias("_n"), values.alias("v")).distinct().groupBy("_n").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias(out))
    flags, sources = listed(F.explode_outer("flags"), "flags"), listed(F.col("source"), "sources").withColumnRenamed("_n", "_m")
    joined = total.join(flags, total[name] == flags["_n"]).join(sources, total[name] == sources["_m"]).drop("_n", "_m")
    return joined.withColumnRenamed(name, "group_name")


def ranked(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by `order`, numbered; a top-n."""
    return df.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))


#: Orders of review groups and of results.
GROUP_ORDERS = {"flagged": ("-flagged", "-members"), "size": ("-members",), "confidence": ("mean",), "name": ("group_name",)}
RESULT_ORDERS = {"name": ("clean_name",), "confidence": ("-confidence",), "source": ("source", "clean_name")}


def order_by(names: tuple[str, ...], *ties: str) -> list[Column]:
    """Columns to sort by; a minus means descending."""
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in (*names, *ties)]


def sort_results(by: str, pending_first: bool = True, key: str = "row_id") -> list[Column]:
    """The order of results: those without a decision first, then by name, confidence or source, then as they came."""
    return [*([F.col("status").isNotNull().asc()] if pending_first else []), *order_by(RESULT_ORDERS[by], key)]


def filter_groups(groups: DataFrame, members: DataFrame, flagged: bool = False, approved: bool = False, singleton: bool = False, search: str = "") -> DataFrame:
    """Groups that pass every filter that is on; the search looks into the group's name, and names and sources of its members.

    `groups` has group_name, members, flagged and approved (counts), `members` has group_name, name, source.
    """
    if flagged:
        groups = groups.filter(F.col("flagged") > 0)
    if approved:
        groups = groups.filter(F.col("approved") > 0)
    if singleton:
        groups = groups.filter(F.col("members") == 1)
    return search_groups(groups, members, search, ["name", "source"]) if search else groups


def search_groups(groups: DataFrame, members: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Groups whose name, or a member's column, holds the text, whatever the case. Hits of members are made distinct before they meet the groups."""
    holds = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower())
    hit = members.filter(reduce(lambda a, b: a | b, [holds(c) for c in columns])).select("group_name").distinct().withColumn("_hit", F.lit(True))
    return groups.join(hit, "group_name", "left").filter(holds("group_name") | F.col("_hit").isNotNull()).drop("_hit")


def consolidate(df: DataFrame) -> DataFrame:
    """Results by clean name: count, mean confidence and its band, sources, and how many went through the second stage."""
    mean = F.avg("confidence")
    band = F.when(mean >= 0.8, "high").when(mean >= 0.6, "medium").otherwise("low")
    return df.groupBy("clean_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean"), band.alias("band"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_if("second").alias("second")
    )


#: Orders of the consolidated view.
CONSOLIDATED_ORDERS = {"count": ("-n",), "name": ("clean_name",), "confidence": ("-mean",)}


def filter_pathways(df: DataFrame, status: str | None = None, text: str = "", published: bool = False) -> DataFrame:
    """Pathways of a status whose title or description holds the text, whatever the case; `published` keeps those for readers."""
    if published:
        df = df.filter(F.col("status") == "published")
    if status:
        df = df.filter(F.col("status") == status)
    return df.filter(F.lower("title").contains(text.lower()) | F.lower(F.coalesce("description", F.lit(""))).contains(text.lower())) if text else df


def modality_counts(df: DataFrame, column: str = "modality") -> DataFrame:
    """Each modality with its count and share, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), column)


def other_names(df: DataFrame, known: list[str], column: str = "modality", name: str = "name") -> DataFrame:
    """The names behind modalities that aren't known, with counts."""
    return df.filter(~F.col(column).isin(known) | F.col(column).isNull()).groupBy(column, name).agg(F.count(F.lit(1)).alias("n"))


def validation_summary(state: DataFrame, log: DataFrame) -> DataFrame:
    """One row: totals, completion and approval rates in percent, decisions, corrected mappings and advice.

    `state` has status and modified, `log` has decision.
    """
    count = lambda c, n: F.count_if(c).alias(n)
    s = state.agg(F.count(F.lit(1)).alias("total"), count(F.col("status") == "approved", "approved"), count(F.col("status") == "rejected", "rejected"), count((F.col("status") == "approved") & F.col("modified"), "corrected"))
    d = log.agg(*[count(F.col("decision") == x, x) for x in ("approve", "reject", "modify")])
    done = F.col("approved") + F.col("rejected")
    rate = lambda a, b: F.when(b > 0, 100 * a / b).otherwise(0.0)
    s = s.crossJoin(d).withColumns({"pending": F.col("total") - done, "completion": rate(done, F.col("total")), "approval": rate(F.col("approved"), done)})
    advice = F.filter(
        F.array(
            F.when(F.col("approval") < 70, "low approval rate: improve the matching"),
            F.when(F.col("completion") < 100, F.concat(F.col("pending").cast("string"), F.lit(" mappings still need review"))),
            F.when(F.col("corrected") > 0, "look for patterns in corrected mappings"),
        ),
        lambda x: x.isNotNull(),
    )
    return s.withColumns({"advice": F.array_join(advice, "; "), "completion": F.round("completion", 1), "approval": F.round("approval", 1)})


def analytics_summary(df: DataFrame) -> DataFrame:
    """Totals and distinct clean names (ERROR left out), their ratio, mean confidence in percent."""
    names = F.countDistinct(F.when(~F.col("clean_name").startswith("ERROR"), F.col("clean_name")))
    return df.agg(F.count(F.lit(1)).alias("total"), names.alias("names"), F.round(F.avg("confidence") * 100, 4).alias("confidence")).withColumn("ratio", F.round(F.col("total") / F.col("names"), 6))


def page(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    """A page of at most 500 rows with the total, page number and number of pages; `order` is made of `ranks.By`."""
    from .ranks import page_rows

    limit = max(1, min(limit, 500))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = page_rows(df, list(order), offset, limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("page", F.lit(offset // limit + 1)).withColumn("pages", F.ceil(F.col("total") / limit))


def distinct_sources(df: DataFrame, source: str, order: str) -> DataFrame:
    """Each source with where it is seen first, in that order."""
    return df.groupBy(source).agg(F.min(order).alias("first")).orderBy("first", source)


def batch_stats(df: DataFrame) -> DataFrame:
    """Successes, errors, cache hits, rejects and approvals of a batch, hit rate, and seconds from its first to its last row."""
    count = lambda c, n: F.count_if(c).alias(n)
    stats = df.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "success", "ok"), count(F.col("status") == "error", "errors"), count(F.col("cached"), "hits"),
        count(F.col("cached") & (F.col("cache_type") == "rejected"), "rejects"), count(F.col("cached") & (F.col("cache_type") == "approved"), "approvals"),
        (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("elapsed"),
    )
    return stats.withColumn("hit_rate", F.round(F.try_divide("hits", "total"), 6))


def review_batch_stats(df: DataFrame, low: float = 0.99) -> DataFrame:
    """Rows, rows of low confidence and mean confidence; a missing confidence is 1."""
    c = F.coalesce("confidence", F.lit(1.0))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(c < low).alias("low"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mean"))


def recent_metrics(df: DataFrame, hours: int, endpoint: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows of the last hours, of one endpoint if given, newest first."""
    rows = recent(df, hours, ts)
    return (rows.filter(F.col("endpoint") == endpoint) if endpoint else rows).orderBy(F.desc(ts))


def equivalence_groups(df: DataFrame) -> DataFrame:
    """The last row of each group id, members parsed, surest first. `df` has group_id, members (JSON), confidence, at."""
    last = df.groupBy("group_id").agg(F.max_by(F.struct("members", "confidence"), "at").alias("g")).select("group_id", "g.*")
    return last.withColumn("members", F.from_json("members", "array<string>")).orderBy(F.desc("confidence"), "group_id")


def improvement_report(df: DataFrame) -> DataFrame:
    """Rate of improvement, means before and after, agreement of two thirds or more."""
    return df.agg(
        F.round(F.avg((F.col("after") > F.col("before")).cast("int")), 6).alias("improved"), F.round(F.avg("before"), 6).alias("before"), F.round(F.avg("after"), 6).alias("after"),
        F.round(F.avg(F.col("after") - F.col("before")), 6).alias("delta"), F.round(F.avg((F.col("agreement") >= 0.67).cast("int")), 6).alias("agreed"),
    )


def inconsistent_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ids with more than one name; names are made distinct before they are listed."""
    return df.select(key, name).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(name)), "|").alias("names")).filter("n > 1")


def multi_variant_ids(df: DataFrame, key: str, side: str) -> DataFrame:
    counts = df.groupBy(key, side).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.sum("_n").alias("variants"), F.array_join(F.array_sort(F.collect_list(F.coalesce(side, F.lit("-")))), ",").alias("sides")).filter("variants > 1")


def recent(df: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Rows of the last hours before the newest row."""
    newest = df.agg(F.max(ts).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).filter(F.col(ts) > F.col("_newest") - F.expr(f"INTERVAL {hours} HOURS")).drop("_newest")


def access_stats(df: DataFrame, days: int) -> DataFrame:
    """Use of each entry, and whether its last use is older than the retention."""
    use = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.max("ts").alias("last"))
    newest = df.agg(F.max("ts").alias("_newest"))
    return use.crossJoin(F.broadcast(newest)).withColumn("stale", (F.col("last") < F.col("_newest") - F.expr(f"INTERVAL {days} DAYS")).cast("int")).drop("_newest", "last")


#: Display names of modalities (others in capitals), and the key roles.
MODALITY_NAMES = {"ultrasound": "Ultrasound", "mammography": "Mammography"}
KEY_ROLES = {"radiologist": "Radiologist", "mit": "MIT", "radiology_healthcare_assistant": "RA/HCA"}


def equipment_counts(machines: DataFrame) -> DataFrame:
    """Machines of each site by the modality's display name, those with any; `machines` has site, modality and machines."""
    m = F.col("modality")
    shown = F.upper(m)
    for key, name in MODALITY_NAMES.items():
        shown = F.when(m == key, name).otherwise(shown)
    return machines.filter("machines > 0").select("site", shown.alias("modality"), "machines")


def key_fill_rates(staff: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """`fill_rates` of the key roles alone, by their labels; `staff` has role, fte and vacant."""
    roles = roles or KEY_ROLES
    labels = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return fill_rates(staff.filter(F.col("role").isin(*roles)).withColumn("role", labels[F.col("role")]))


def pending_feedback(mappings: DataFrame, general: DataFrame, status: str = "pending") -> tuple[DataFrame, DataFrame]:
    """Both feedback queues in a status, newest first: mapping corrections with their two mappings parsed, and general suggestions."""
    parsed = lambda c: F.from_json(c, "struct<clean_name: string, snomed_id: string, confidence: double>").alias(c)
    first = mappings.filter(F.col("status") == status)
    others = [c for c in mappings.columns if c not in ("original_mapping", "corrected_mapping")]
    order = [F.desc("created_at"), F.asc("id")]
    return first.select(*others, parsed("original_mapping"), parsed("corrected_mapping")).orderBy(*order), general.filter(F.col("status") == status).orderBy(*order)


def fill_rates(staff: DataFrame) -> DataFrame:
    rate = F.round(100 * (F.col("fte") - F.col("vacant")) / F.col("fte"), 4)
    return staff.filter("fte > 0").withColumn("rate", rate).withColumn("band", F.when(rate >= 80, "good").when(rate >= 60, "fair").otherwise("poor"))


def complete_categories(sites: DataFrame, categories: DataFrame, staff: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every site with every category, 0 where nothing is known. The categories are a fixed short list."""
    return sites.crossJoin(F.broadcast(categories)).join(staff, keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def rate_impact(df: DataFrame, ids: list[str], regions: list[str], national: str) -> DataFrame:
    """Long regional rates with the difference to the national rate and its band."""
    long = df.unpivot([*ids, national], regions, "region", "rate")
    diff = F.round(F.col(national) - F.col("rate"), 2)
    band = F.when(diff.isNull(), "unknown").when(diff > 50, "large gain").when(diff > 0, "gain").when(diff == 0, "same").when(diff >= -50, "loss").otherwise("large loss")
    return long.withColumn("difference", diff).withColumn("impact", band)


def changelog(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Added, removed and modified rows of two snapshots."""
    o = old.select(*keys, F.struct(*values).alias("_old"))
    n = new.select(*keys, F.struct(*values).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return o.join(n, keys, "full_outer").select(*keys, kind.alias("change")).filter("change is not null")


def changelog_totals(changes: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of added, removed and modified rows at each level of a hierarchy and over all: one grouping by sets, with `depth` levels named.

    `changes` has the levels (from the outermost in) and `change`.
    """
    sets = [[F.col(c) for c in levels[:k]] for k in range(len(levels), -1, -1)]
    counts = {k: F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "modified")}
    ids = [(1 - F.grouping(c)).cast("int") for c in levels]
    total = changes.groupingSets(sets, *levels).agg(F.count(F.lit(1)).alias("changes"), *counts.values(), reduce(lambda a, b: a + b, ids).alias("depth"))
    return total.select(*levels, "depth", "changes", *counts)


def stamped(sections: DataFrame, changes: DataFrame, section: str, stamp: str) -> DataFrame:
    """`sections` with `last_updated` set to `stamp` where something in them changed."""
    touched = changes.select(section).distinct().withColumn("_t", F.lit(stamp))
    return sections.join(touched, section, "left").withColumn("last_updated", F.coalesce("_t", "last_updated")).drop("_t")


def reshape_scenarios(df: DataFrame, ids: list[str], archetypes: DataFrame) -> DataFrame:
    """Yearly measures in long form, `<measure>_y<k>`, joined to their sites."""
    wide = [c for c in df.columns if "_y" in c and c.rsplit("_y", 1)[1].isdigit()]
    long = df.unpivot(ids, wide, "_c", "value")
    long = long.withColumn("measure", F.regexp_replace("_c", r"_y\d+$", "")).withColumn("year", F.regexp_extract("_c", r"_y(\d+)$", 1).cast("int"))
    return long.drop("_c").join(archetypes, "archetype", "left")


def flatten_results(df: DataFrame) -> DataFrame:
    """One mapping row per nested result; the input's fields come first, failures are named as such, and cache marks become the review status.

    `df` has row_id, input and output structs, status, error, and cached_skip and cache_type, which approvals carry in the output, rejections beside it.
    """
    ok = F.col("status") == "success"
    pick = lambda n: F.coalesce(f"input.{n}", f"output.{n}", F.lit("")).alias(n)
    name = F.when(ok, F.col("output.clean_name")).otherwise(F.concat(F.lit("ERROR: "), F.coalesce("error", F.lit("unknown"))))
    approved = ok & F.col("output.cached_skip") & (F.col("output.cache_type") == "approved")
    rejected = F.col("cached_skip") & (F.col("cache_type") == "rejected")
    review = F.when(approved, "approved").when(rejected, "rejected")
    return df.select(
        "row_id", *[pick(n) for n in ("data_source", "modality_code", "exam_code", "exam_name")], F.coalesce(name, F.lit("")).alias("clean_name"), F.coalesce(F.when(ok, F.col("output.confidence")), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.when(ok, F.col("output.ambiguous")), F.lit(False)).alias("ambiguous"), review.alias("validation_status"), F.when(review.isNotNull(), F.concat(F.lit("Previously "), review, F.lit(" (cached)"))).alias("validation_notes"),
    )
