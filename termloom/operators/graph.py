"""Pathways as graphs: manifests, checks, reachability and evaluation of answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import checkpointed


def manifest(pathways: DataFrame) -> DataFrame:
    """Step and guide counts, with a default description."""
    n, g = F.coalesce(F.size(F.map_keys("steps")), F.lit(0)), F.coalesce(F.size("guides"), F.lit(0))
    several = lambda k, one: F.concat(k.cast("string"), F.lit(f" {one}"), F.when(k == 1, "").otherwise("s"))
    text = F.concat(F.lit("A clinical decision support pathway with "), several(n, "decision step"), F.when(g > 0, F.concat(F.lit(" and "), several(g, "protocol guide"))).otherwise(""), F.lit("."))
    description = F.when(F.coalesce("description", F.lit("")) == "", text).otherwise(F.col("description"))
    return pathways.select("id", "title", n.alias("step_count"), g.alias("guide_count"), description.alias("description"), F.coalesce("status", F.lit("draft")).alias("status"))


#: Orders of a manifest: by title whatever the case, or the last changed first.
MANIFEST_ORDERS = {"title": lambda: (F.lower("title"), F.col("title"), F.col("id")), "modified": lambda: (F.col("modified").desc(), F.col("id"))}


def manifest_files(files: DataFrame, by: str = "title") -> DataFrame:
    """The manifest of files in order: `files` has id, title, description, status, steps, guides, modified and raw (the document's text, whose length is the size)."""
    extra = files.select("id", F.concat("id", F.lit(".json")).alias("filename"), "modified", F.octet_length("raw").alias("size"))
    return manifest(files).join(extra, "id").orderBy(*MANIFEST_ORDERS[by]())


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


#: The checks of a pathway and of a step: what is wrong where, by the field that must be there.
PATHWAY_CHECKS = {"title": "Title is required", "id": "ID is required", "start": "Start step must be specified"}
STEP_CHECKS = {"title": "missing title", "type": "missing type"}
NO_START, NO_TARGET = "Start step does not exist in steps", "references non-existent step"


def failing(checks: dict[str, str], place: Column, key: Column) -> Column:
    """The checks whose field is null or empty, as structs of id, step, field and problem."""
    each = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.struct(key.alias("id"), place.alias("step"), F.lit(c).alias("field"), F.lit(p).alias("problem"))) for c, p in checks.items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def reference_checks(pathways: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything that is wrong with the pathways: id, step, field, problem; targets are named in `field`.

    `pathways` has key, id, title, start; `nodes` key, step, title, type; `edges` key, src, option, dst. `key` is the place a pathway is kept by, as its id may be missing. One
    pass over each table finds the missing fields; start steps and targets are looked up by one join each.
    """
    nowhere = F.lit(None).cast(nodes.schema["step"].dataType)
    missing = pathways.select(F.explode(failing(PATHWAY_CHECKS, nowhere, F.col("key"))).alias("x")).select("x.*")
    steps = nodes.select(F.explode(failing(STEP_CHECKS, F.col("step"), F.col("key"))).alias("x")).select("x.*")
    known = nodes.select("key", F.col("step").alias("_s"))
    start = pathways.filter("start is not null").join(known.withColumnRenamed("_s", "start"), ["key", "start"], "left_anti")
    start = start.select(F.col("key").alias("id"), F.col("start").alias("step"), F.lit("start").alias("field"), F.lit(NO_START).alias("problem"))
    lost = edges.filter("dst is not null").join(known.withColumnRenamed("_s", "dst"), ["key", "dst"], "left_anti")
    lost = lost.select(F.col("key").alias("id"), F.col("src").alias("step"), F.concat(F.lit("option "), F.col("option").cast("string"), F.lit(" to "), F.col("dst").cast("string")).alias("field"), F.lit(NO_TARGET).alias("problem"))
    return missing.unionByName(steps).unionByName(start).unionByName(lost)


#: Steps taken before a round's new ones are written.
HOPS = 4


def reachable(starts: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, step) reachable from the starts, all graphs at once. Each round takes `hops` steps and writes only what it reaches anew; a round without any ends it."""
    fronts = [checkpointed(starts.select("id", "step").distinct())]
    moves = edges.select("id", F.col("src").alias("step"), "dst").distinct()
    while True:
        reached = [fronts[-1]]
        for _ in range(hops):
            reached.append(reached[-1].join(moves, ["id", "step"]).select("id", F.col("dst").alias("step")).distinct())
        step = reduce(DataFrame.unionByName, reached[1:]).distinct()
        new = checkpointed(step.join(reduce(DataFrame.unionByName, fronts), ["id", "step"], "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, fronts)
        fronts.append(new)
        if len(fronts) > 16:  # few tables to read, each step rewritten once in sixteen rounds at most
            fronts = [checkpointed(reduce(DataFrame.unionByName, fronts[:-1])), fronts[-1]]


def unreachable(nodes: DataFrame, starts: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(reachable(starts, edges), ["id", "step"], "left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges without those that lie on no cycle because their beginning has no edge in, or their end none out, over and over."""
    n = edges.count()
    while n:
        ins = edges.select("id", F.col("dst").alias("src")).distinct()
        outs = edges.select("id", F.col("src").alias("dst")).distinct()
        edges = checkpointed(edges.join(ins, ["id", "src"], "left_semi").join(outs, ["id", "dst"], "left_semi").select("id", "src", "dst"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def spread_least(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, step, label): the smallest label that reaches each step along the edges."""
    while True:
        passed = edges.join(labels.withColumnRenamed("step", "src"), ["id", "src"]).select("id", F.col("dst").alias("step"), "label")
        new = labels.unionByName(passed).groupBy("id", "step").agg(F.min("label").alias("label"))
        new = checkpointed(new)
        moved = new.join(labels.withColumnRenamed("label", "_l"), ["id", "step"]).filter("label < _l").count()
        labels = new
        if not moved:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(id, src, dst) of the edges inside a strongly connected component.

    Forward-backward: the smallest step that reaches a step is its colour; the steps of a colour that
    reach back to it are a component. What is left is trimmed and coloured again. Tables are as
    large as the edges, never pairs of steps.
    """
    found, rest = [], trimmed(edges)
    while not rest.isEmpty():
        nodes = rest.select("id", F.col("src").alias("step")).unionByName(rest.select("id", F.col("dst").alias("step"))).distinct()
        colour = spread_least(rest, nodes.withColumn("label", F.col("step")))
        of = lambda c: colour.select("id", F.col("step").alias(c), F.col("label").alias(f"{c}_colour"))  # noqa: B023, E731
        same = checkpointed(rest.join(of("src"), ["id", "src"]).join(of("dst"), ["id", "dst"]).filter("src_colour = dst_colour").select("id", "src", "dst", F.col("src_colour").alias("colour")))
        back = reachable(colour.filter("step = label").select("id", "step"), same.select("id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        ends = [back.withColumnRenamed("step", c) for c in ("src", "dst")]
        inside = checkpointed(same.join(ends[0], ["id", "src"], "left_semi").join(ends[1], ["id", "dst"], "left_semi").select("id", "src", "dst"))
        found.append(inside)
        rest = rest.join(ends[0], ["id", "src"], "left_anti").join(ends[1], ["id", "dst"], "left_anti").select("id", "src", "dst")
        rest = trimmed(checkpointed(rest))
    return reduce(DataFrame.unionByName, found) if found else rest


def cyclic_edges(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges whose end leads back to their beginning; an edge back to the start is allowed, a loop on one step isn't."""
    inner = edges.join(starts.select("id", F.col("step").alias("dst")), ["id", "dst"], "left_anti").select("id", "src", "dst").distinct()
    loops = edges.filter("src = dst").select("id", "src", "dst")
    return components(checkpointed(inner)).unionByName(loops).distinct()


def evaluate_pathways(answers: DataFrame | Callable[[DataFrame], DataFrame], edges: DataFrame, starts: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Follow each case's answers from its start: (case, step, status), all cases at once.

    `answers` has (case, id, step, option), `edges` (id, src, option, dst). A case ends at a
    step without edges (recommended), without an answer (unanswered), at an answer that leads nowhere (broken),
    or where its way returns to a step it has been at (cyclic; the step is the one met again). Each round writes only the steps it reaches and the answers given there.
    Answers that are derived, and far more than the steps on the ways, may come as a function: it gives those at some (case, id, step); `cases` (case, id) are then all with an answer.
    """
    key = ["case", "id", "step"]
    at_steps = answers if callable(answers) else lambda front: answers.join(front, key, "left_semi")
    cases = answers.select("case", "id").distinct() if cases is None else cases
    leaves = edges.select("id", F.col("src").alias("step")).distinct()
    seen = checkpointed(cases.join(starts, "id").select(*key))
    fronts, met, jumps = [seen], [], []
    while True:
        # the step that each answered step leads to; one answer counts for a step
        told = at_steps(fronts[-1].distinct()).groupBy(*key).agg(F.min("option").alias("option")).join(leaves, ["id", "step"], "left_semi")
        jump = told.join(edges.withColumnRenamed("src", "step"), ["id", "step", "option"], "left").select(*key, "dst")
        jumps.append(checkpointed(jump))
        step = fronts[-1].join(jumps[-1].filter("dst is not null"), key).select("case", "id", F.col("dst").alias("step"))
        every = reduce(DataFrame.unionByName, fronts)
        met.append(checkpointed(step.join(every, key, "left_semi")))
        new = checkpointed(step.join(every, key, "left_anti"))
        if new.isEmpty():
            break
        fronts.append(new)
        if len(fronts) > 16:
            fronts = [checkpointed(reduce(DataFrame.unionByName, fronts[:-1])), fronts[-1]]
            met, jumps = [checkpointed(reduce(DataFrame.unionByName, met))], [checkpointed(reduce(DataFrame.unionByName, jumps))]
    seen, jump = reduce(DataFrame.unionByName, fronts), reduce(DataFrame.unionByName, jumps)
    cyclic = reduce(DataFrame.unionByName, met).select("case", "step", F.lit("cyclic").alias("status"))
    ended = seen.join(jump.filter("dst is not null").select(*key), key, "left_anti")
    lost = jump.filter("dst is null").select(*key).withColumn("_b", F.lit(True))
    at = ended.join(lost, key, "left").join(leaves.withColumn("_l", F.lit(True)), ["id", "step"], "left")
    status = F.when(F.col("_b"), "broken").when(F.col("_l"), "unanswered").otherwise("recommended")
    return at.select("case", "step", status.alias("status")).unionByName(cyclic)
