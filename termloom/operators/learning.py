"""Learned mappings, feedback, tuning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def org_mapping(df: DataFrame, maps: DataFrame, keys: list[str], min_verified: int = 2) -> DataFrame:
    """The best verified mapping of each key: by confidence, then verifications."""
    ok = maps.filter(F.col("verified") >= min_verified)
    best = ok.groupBy(*keys).agg(F.max(F.struct("confidence", "verified", "target")).alias("b"))
    return df.join(best.select(*keys, F.col("b.target").alias("mapped"), F.col("b.confidence").alias("mapped_confidence")), keys, "left")


def grams(text: Column, n: int = 3) -> Column:
    """All stretches of n letters or less, each once."""
    at = lambda i: F.transform(F.sequence(F.lit(1), F.length(text) - (i - 1)), lambda k: F.substr(text, k, F.lit(i)))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(text) >= i, at(i)).otherwise(F.array().cast("array<string>")) for i in range(1, n + 1)])))


def learned_patterns(df: DataFrame, patterns: DataFrame, limit: float = 0.7, most: int = 5) -> DataFrame:
    """Exact patterns, and up to `most` that contain the name (whatever the case), for each distinct name: surest first, then by feedback.

    Not every pattern is compared with every name: a pattern is found through its stretches of up to
    three letters, of which each name asks for the one that the fewest patterns have. Empty names are contained in nothing.
    """
    active = patterns.filter("active")
    names = df.select("name").filter("name <> ''").distinct()
    order = [F.desc("confidence"), F.desc("feedback_count"), F.col("pattern")]
    exact = names.join(active.filter(F.col("confidence") >= limit), F.col("name") == F.col("pattern")).select("name", "pattern", "target", "confidence", F.lit("exact").alias("kind"))
    near = active.filter(F.col("confidence") >= limit - 0.2).withColumn("g", F.explode(grams(F.lower("pattern"))))
    counts = near.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = names.withColumn("g", F.explode(grams(F.lower("name")))).filter(F.length("g") == F.least(F.length("name"), F.lit(3)))
    rarest = asked.join(counts, "g", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).select("name", F.col("r.g").alias("g"))
    found = rarest.join(near, "g").filter(F.lower("pattern").contains(F.lower("name")))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter(F.col("_r") <= most)
    return exact.unionByName(found.select("name", "pattern", "target", "confidence", F.lit("contained").alias("kind")))


def resolve_precedence(mapped: Column, pattern: Column, pattern_confidence: Column, base: Column) -> Column:
    """Organisation mapping, then a pattern above 0.8, then the base result."""
    kind = F.when(mapped.isNotNull(), "organisation").when(pattern_confidence > 0.8, "pattern").otherwise("base")
    return F.struct(F.coalesce(mapped, F.when(pattern_confidence > 0.8, pattern), base).alias("value"), kind.alias("source"))


def sample_by_source(df: DataFrame, source: str, sources: list[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """A repeatable sample of the rows of some sources (of all, if none is named)."""
    return hash_sample(df.filter(F.col(source).isin(*sources)) if sources else df, key, n, seed)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 7, most: int = 1000) -> DataFrame:
    """A repeatable sample of n rows (1 to `most`): the n smallest hashes."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(max(1, min(n, most)))


def feedback_stats(fb: DataFrame, days: int = 30) -> DataFrame:
    """Feedback by type in the last days before the newest row; accuracy is null without a verdict."""
    newest = fb.agg(F.max("ts").alias("_newest"))
    recent = fb.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("_newest") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("org").alias("orgs"), F.round(F.avg("correct"), 6).alias("accuracy"))


def learn(fb: DataFrame, maps: DataFrame, least: float = 0.8) -> DataFrame:
    """Sure corrections merged into the mappings: counts add up, the surest target wins."""
    new = fb.filter(F.col("confidence") >= least).groupBy("org", "name").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("confidence", "target")).alias("b"))
    j = maps.join(new, ["org", "name"], "full_outer")
    return j.select("org", "name", F.coalesce("b.target", "target").alias("target"), (F.coalesce("verified", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("verified"))


def learn_patterns(fb: DataFrame, patterns: DataFrame, least: float = 0.8) -> DataFrame:
    """Sure corrections merged into the learned patterns, one for each (pattern, target): feedback adds up, the newest confidence (by `moment`) stays."""
    new = fb.filter(F.col("confidence") >= least).groupBy(F.col("name").alias("pattern"), "target").agg(F.count(F.lit(1)).alias("n"), F.max_by("confidence", "moment").alias("c"))
    j = patterns.join(new, ["pattern", "target"], "full_outer")
    return j.select("pattern", "target", F.coalesce("c", "confidence").alias("confidence"), (F.coalesce("feedback_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("feedback_count"), F.coalesce("active", F.lit(True)).alias("active"))


def retrain(patterns: DataFrame, performance: DataFrame, least: float = 0.3, enough: int = 5) -> DataFrame:
    """Success rates from the log; patterns that fail often enough are switched off."""
    seen = performance.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.avg("success").alias("rate"))
    j = patterns.join(seen, "pattern_id", "left")
    return j.withColumn("active", F.col("active") & ~F.coalesce((F.col("rate") < least) & (F.col("n") >= enough), F.lit(False)))


def evaluate(results: DataFrame, chunk: str) -> DataFrame:
    """Chunk figures merged by weight: successes, failures, mean confidence."""
    ok = F.col("name").isNotNull() & (F.col("confidence") > 0.5)
    per = results.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.avg("confidence").alias("mean"))
    return per.agg(F.sum("n").alias("cases"), F.sum("ok").alias("ok"), (F.sum("n") - F.sum("ok")).alias("failed"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("confidence"), F.round(F.sum("ok") / F.sum("n"), 6).alias("success"))


def param_grid(lists: dict[str, DataFrame], parts: list[str], cap: float, n: int) -> DataFrame:
    """All combinations whose `parts` sum to `cap` or less, thinned by a stride to n. Each list is a few rows."""
    grid = reduce(DataFrame.crossJoin, lists.values())
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    kept = grid.filter(F.round(total, 9) <= cap)
    numbered = kept.withColumn("config_id", F.row_number().over(Window.orderBy(*lists)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.filter(F.col("config_id") % F.greatest(F.lit(1), F.ceil(F.col("_n") / n)) == 0).drop("_n")


def random_params(lists: dict[str, list[float]], parts: list[str], cap: float, n: int, spark, seed: int = 7) -> DataFrame:
    """Random search: n draws of one of all combinations each, with those whose `parts` sum to `cap` or less.

    A draw is an ordinal in the grid, from a hash of the seed and the draw's number, and its values are the ordinal's digits in the mixed radix of
    the lists' lengths; the grid itself, which may be far larger than n, is never made. The same seed draws the same.
    """
    total = math.prod(map(len, lists.values()))
    text = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    rows = spark.range(n).withColumn("o", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % total)
    rest, values = F.col("o"), {}
    for name, choices in reversed(lists.items()):
        values[name] = F.get(F.array(*map(F.lit, choices)), (rest % len(choices)).cast("int"))
        rest = F.floor(rest / len(choices)).cast("long") if len(choices) > 1 else rest
    drawn = rows.select(F.col("id").alias("draw"), *[values[name].alias(name) for name in lists])
    return drawn.filter(F.round(reduce(lambda a, b: a + b, [F.col(p) for p in parts]), 9) <= cap)


def complete_config(total: Column) -> tuple[Column, Column]:
    """(laterality, technique): what is left of 1, 60 to 40."""
    return F.round((1 - total) * 0.6, 6), F.round((1 - total) * 0.4, 6)


def rounded(x: np.ndarray, places: int = 9) -> np.ndarray:
    """Half away from zero, in units of the last place."""
    x = x * 10.0**places
    whole = np.trunc(x)
    return whole + np.trunc((x - whole) * 2)


def changes(ids: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    a, b = ids.slice(1), ids.slice(0, max(0, len(ids) - 1))
    return pc.and_not(pc.fill_null(pc.not_equal(a, b), True), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def counted_hits(weights: np.ndarray, chunk: int = 16_384):
    """A function over batches (row_id, hit, parts), sorted by row and then from the candidate that wins a tie: for each configuration its place, hits and rows.

    A row's best score and its hit are kept for each configuration, so a row may go over any number of batches.
    """
    n = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, rows, last = np.zeros(n, np.int64), 0, None
        top, won = np.full(n, -np.inf), np.zeros(n, np.int64)  # of the row that isn't done
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                ids, hit = part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                values = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in part.columns[2:]])
                missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in part.columns[2:]])
                score = sum(weights[:, i, None] * x[None, :] for i, x in enumerate(values))  # a line per configuration
                score = rounded(score)
                if not np.isfinite(score).all():  # not a number stands above all, null below
                    score = np.nan_to_num(score, nan=np.inf, posinf=np.finfo(float).max, neginf=-np.finfo(float).max)
                    score[:, missing] = -np.inf
                new = np.concatenate([[last is None or changes(pa.concat_arrays([last, ids.slice(0, 1)]))[0]], changes(ids)])
                starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
                best = np.maximum.reduceat(score, starts, axis=1)
                group = np.cumsum(np.concatenate([[0], new[1:].astype(np.int64)]))
                place = np.where(score == best[:, group], np.arange(len(ids)), len(ids))
                found = hit[np.minimum.reduceat(place, starts, axis=1)]
                if new[0]:
                    hits, rows = hits + (won if last is not None else 0), rows + (last is not None)
                else:  # the first row began before
                    older = top >= best[:, 0]
                    best[older, 0], found[older, 0] = top[older], won[older]
                hits, rows = hits + found[:, :-1].sum(axis=1), rows + len(starts) - 1
                top, won, last = best[:, -1].copy(), found[:, -1].copy(), ids.slice(len(ids) - 1, 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(hits + won), pa.array(np.full(n, rows + 1, np.int64))], ["place", "hits", "rows"])

    return run


def grid_search(cands: DataFrame, params: DataFrame, parts: list[str], truth: Column, stop_at: float | None = None) -> DataFrame:
    """Accuracy of every configuration over every row; with `stop_at`, up to the first that reaches it.

    A row's best candidate has the highest score of nine places; of ties the smallest `cand_pos`, then a true one. Candidates are dealt and sorted by row once, and
    each task scores all configurations against them as matrices, so neither the shuffle nor the rows grow with the grid. The grid is a few rows (its
    builder thins it).
    """
    grid = params.select("config_id", *[f"w_{p}" for p in parts]).orderBy("config_id").collect()
    if not grid:
        return params.select("config_id", F.lit(None).cast("double").alias("accuracy"), F.lit(0).cast("long").alias("rows")).limit(0)
    weights = np.array([[float(r[f"w_{p}"]) for p in parts] for r in grid])
    hit = F.coalesce(truth.cast("int"), F.lit(0)).alias("_hit")
    dealt = cands.select("row_id", hit, *parts, "cand_pos").repartition("row_id").sortWithinPartitions("row_id", F.asc_nulls_last("cand_pos"), F.desc("_hit"))
    counted = dealt.select("row_id", "_hit", *parts).mapInArrow(counted_hits(weights), "place long, hits long, rows long")
    ids = F.array(*[F.lit(r["config_id"]) for r in grid])
    found = counted.groupBy("place").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))
    found = found.select(F.get(ids, F.col("place").cast("int")).alias("config_id"), F.round(F.col("hits") / F.col("rows"), 6).alias("accuracy"), "rows")
    if stop_at is None:
        return found
    reached = found.filter(F.col("accuracy") >= stop_at).agg(F.min("config_id").alias("_last"))
    return found.crossJoin(F.broadcast(reached)).filter(F.col("_last").isNull() | (F.col("config_id") <= F.col("_last"))).drop("_last")


def experiments(runs: DataFrame) -> DataFrame:
    """A row per experiment: success rate and speed (cases a second); 0 where nothing ran, as for one with an error."""
    ok = F.coalesce(F.col("cases"), F.lit(0)) > 0
    rate = F.when(ok, F.col("successes") / F.col("cases")).otherwise(0.0)
    speed = F.when(ok & (F.col("seconds") > 0), F.col("cases") / F.col("seconds")).otherwise(0.0)
    return runs.select("experiment_id", "cases", F.round(rate, 6).alias("success_rate"), F.round(speed, 6).alias("speed"), "error")


def param_importance(experiments: DataFrame, params: list[str], target: str, least: int = 10) -> DataFrame:
    """Absolute Pearson correlation of each parameter with the target; constants and small samples are left out."""
    long = experiments.unpivot([target], [F.col(p).cast("double").alias(p) for p in params], "parameter", "value")
    stats = long.groupBy("parameter").agg(F.count("value").alias("n"), F.covar_pop("value", target).alias("_c"), (F.stddev_pop("value") * F.stddev_pop(target)).alias("_s"))
    kept = stats.filter((F.col("n") >= least) & (F.col("_s") > 0))
    return kept.select("parameter", "n", F.round(F.abs(F.try_divide("_c", "_s")), 6).alias("importance"))
