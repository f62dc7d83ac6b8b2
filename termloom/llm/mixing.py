"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each row gets a hash-random key. Within a source, rows are ordered by key;
the key's leading digits split every source into ranges, so a hot source is
spread over many tasks. Sums per range give each range its offset, and an exact
prefix sum is needed only inside the one range per source that holds the cut.
A budget above a source's size is met by whole epochs plus one cut.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share
the total size; a target stops at `max_epochs` times its source's size, and the
excess is shared anew by weight among the rest until none is above.

Defined results: null or empty texts have size 0 and take 0; a null source is a
source of its own; rows that tie on the key at the cut share what is left in
proportion to their size (rounded down); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_folder, text_or_empty

#: Columns of the result; columns of these names in the documents give way in `mix`.
OWN = ("size", "source_size", "target", "taken", "epochs", "rest", "cut_key", "left", "tied", "_source", "_key", "_words")
ROWS_IN_RANGE = 200_000  # about, of one range of the key, at most


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def key_of(seed: int) -> Column:
    """32 hex digits; a null id has the key of the empty string."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))


def targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, target: `sizes` has one row per source.

    Water-filling: a source is capped when its weighted share of what the capped
    ones leave is above its cap. Each round is one small aggregate; the rounds
    end when no source changes. Only four numbers a round reach the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        x = t.agg(
            F.sum("source_size").alias("total"),
            F.count_if(above).alias("capped"),
            F.sum(F.when(above, F.col("cap"))).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if not x["total"] or x["capped"] == capped or not x["weight"]:
            break
        capped, level = x["capped"], (x["total"] - (x["held"] or 0)) / x["weight"]
    target = F.when(F.col("cap") < F.col("weight") * F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return t.select("source", "source_size", target.alias("target"))


def range_digits(rows: int) -> int:
    """Hex digits of the key that name a range: 4,096 ranges of each source, and 16 times as many while one could hold over `ROWS_IN_RANGE` rows."""
    digits = 3
    while rows > ROWS_IN_RANGE * 16**digits:
        digits += 1
    return digits


def cuts(docs: DataFrame, seed: int = 1, weights=(1, 2, 3), max_epochs: int = 3, folder: str | None = None) -> DataFrame:
    """One row per source: its target, whole epochs, and the key where the last, partial epoch stops.

    Rows with a smaller key are taken once more; rows at the key share `left` of `tied` words.
    """
    folder = folder or shared_folder(docs.sparkSession)
    sized = docs.select("source", "doc_id", size_of(text_or_empty()).alias("size"))
    rows = materialise(sized.withColumn("key", key_of(seed)), folder, "sizes")
    rows = rows.withColumn("range", F.substring("key", 1, range_digits(rows.count())))
    ranges = materialise(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), folder, "ranges")
    per_source = materialise(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), folder, "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = per_source.withColumn("epochs", whole.cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    # the range that holds the cut: the first whose running sum passes the rest
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = ranges.withColumn("before", before).join(F.broadcast(plan) if is_small(plan) else plan, ranges["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    hit = located.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    hit = materialise(hit.select("source", "range", "before", "rest"), folder, "hits")
    # only these ranges' rows need an exact prefix sum
    spot = F.broadcast(hit) if is_small(hit) else hit
    near = rows.join(spot, rows["source"].eqNullSafe(hit["source"]) & (rows["range"] == hit["range"])).select(rows["source"], "key", "size", "before", "rest")
    tied = near.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("tied"))
    start = F.col("before") + F.coalesce(F.sum("tied").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = tied.withColumn("left", F.col("rest") - start).filter((F.col("left") >= 0) & (F.col("left") < F.col("tied")))
    at = at.select(F.col("source").alias("_s"), F.col("key").alias("cut_key"), "left", "tied")
    return materialise(plan.join(at, plan["source"].eqNullSafe(F.col("_s")), "left").drop("_s"), folder, "cuts")


def is_small(df: DataFrame, rows: int = 50_000) -> bool:
    """Whether a table of one row per source may be broadcast: its rows are counted, up to the bound."""
    return df.limit(rows + 1).count() <= rows


def mix(docs: DataFrame, seed: int = 1, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The documents with size, source_size, target and taken (words, repeats counted)."""
    docs = docs.drop(*OWN)
    at = cuts(docs, seed, weights, max_epochs).withColumnRenamed("source", "_source")
    sized = docs.withColumn("size", size_of(text_or_empty())).withColumn("_key", key_of(seed))
    at = F.broadcast(at) if is_small(at) else at
    joined = sized.join(at, F.col("source").eqNullSafe(F.col("_source")))
    extra = (
        F.when(F.col("_key") < F.col("cut_key"), F.col("size"))
        .when(F.col("_key") == F.col("cut_key"), F.floor(F.col("size") * F.col("left") / F.col("tied")))
        .otherwise(F.lit(0))
    )
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return joined.withColumn("taken", taken).drop("_source", "_key", "epochs", "rest", "cut_key", "left", "tied")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each whole copy, and one cut after its last taken word."""
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in OWN}
    names = [aside.get(c, c) for c in docs.columns]
    m = mix(docs.withColumnsRenamed(aside), **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.col("taken") - copies * F.col("size")
    parts = F.concat(F.array_repeat(F.lit(None).cast("long"), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    m = m.withColumn("_words", F.explode(parts))
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(words, 1, F.coalesce(F.col("_words"), F.lit(0)).cast("int")), "")
    m = m.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in names:
        m = m.withColumn("n_chars", F.length("text").cast("long"))
    return m.select(*names).withColumnsRenamed({v: k for k, v in aside.items()})
