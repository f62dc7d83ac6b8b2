"""Set-similarity and prefix joins: candidate pairs of texts without pairing up what shares a frequent word."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words that are counted and ordered as frequent; all others come before them. The table of these is broadcast.
FREQUENT = 100_000


def frequent_words(*sides: DataFrame, column: str = "words", most: int = FREQUENT) -> DataFrame:
    """The `most` most frequent words of all sides: word, n."""
    words = None
    for side in sides:
        own = side.select(F.explode(column).alias("word"))
        words = own if words is None else words.unionByName(own)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)


def by_rarity(side: DataFrame, keys: list[str], frequent: DataFrame, column: str = "words") -> DataFrame:
    """`side` (one row per `keys`) with `column` in the global order: words outside the table first, by themselves, then by count."""
    words = side.select(*keys, F.explode(column).alias("word")).join(F.broadcast(frequent), "word", "left")
    ordered = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("_o"))
    return side.drop(column).join(ordered.select(*keys, F.transform("_o", lambda x: x["word"]).alias(column)), keys)


def prefix_size(n: Column, least: Column) -> Column:
    """How many of its rarest words a set of n must offer so that each set of Jaccard similarity `least` shares one."""
    return n - F.ceil(least * n - 1e-9) + 1


def renamed(side: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return side.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c not in keys])


def similar_sets(left: DataFrame, right: DataFrame, keys: list[str], most: int = FREQUENT) -> DataFrame:
    """Pairs of sets at or above their similarity `least`: keys, each side's columns with `left_` or `right_` before their names, `jaccard`.

    Both sides have (id, *keys, least, words) and may have more: sets of distinct words, one for each (id, keys), none empty,
    compared within equal keys, which also fix `least` (above 0). Words stand in one global order, rarest first, and
    a set is found by its first few alone, so a frequent word is a key only of sets that hold hardly anything else.
    Pairs are left out by their sizes and by the places of the word they meet at before the sets are
    intersected, and each pair counts at its first common word only.
    """
    frequent = frequent_words(left, right, most=most)

    def offered(side: DataFrame, name: str) -> DataFrame:
        rows = by_rarity(side, ["id", *keys], frequent)
        rows = renamed(rows.withColumn("first", F.slice("words", F.lit(1), prefix_size(F.size("words"), F.col("least")).cast("int"))), name, keys)
        return rows.select("*", F.posexplode(f"{name}_first").alias(f"{name}_at", "word"))

    pairs = offered(left, "left").join(offered(right, "right"), [*keys, "word"])
    a, b, least = F.size("left_words"), F.size("right_words"), F.col("left_least")
    needed = F.ceil(least / (1 + least) * (a + b) - 1e-9)
    possible = (F.least(a, b) >= least * F.greatest(a, b) - 1e-9) & (F.least(a - F.col("left_at"), b - F.col("right_at")) >= needed)
    pairs = pairs.filter(possible & (F.col("word") == F.get(F.array_intersect("left_first", "right_first"), F.lit(0))))
    both = F.size(F.array_intersect("left_words", "right_words"))
    pairs = pairs.drop("left_first", "right_first", "left_at", "right_at", "word").select("*", F.explode(F.array(both / (a + b - both))).alias("jaccard"))
    return pairs.filter(F.col("jaccard") >= least - 1e-9)


def prefix_pairs(left: DataFrame, right: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Pairs where one `text` starts with the other, which has at least `ratio` of its length; columns as in `similar_sets`.

    Both sides have (id, *keys, text) and may have more. The shorter text offers its start of the largest power of two, the longer one all
    starts of such lengths that the shorter may have; starts are long, so no frequent word gathers rows.
    """
    power = lambda c: F.floor(F.log2(F.length(c) + F.lit(0.5))).cast("int")
    start = lambda p: F.struct(p.alias("p"), F.substr(F.col("text"), F.lit(1), F.pow(F.lit(2.0), p).cast("int")).alias("start"))
    low = F.greatest(power("text") - (math.ceil(-math.log2(ratio)) + 1), F.lit(0))

    def offered(side: DataFrame, name: str, starts: Column) -> DataFrame:
        rows = side.filter(F.length("text") > 0).withColumn("_key", F.explode(starts))
        return renamed(rows, name, [*keys, "_key"])

    shorter, longer = F.array(start(power("text"))), F.transform(F.sequence(low, power("text")), start)
    a, b = F.col("left_text"), F.col("right_text")
    inside = lambda x, y: y.startswith(x) & (F.length(x) >= ratio * F.length(y))
    first = offered(left, "left", shorter).join(offered(right, "right", longer), [*keys, "_key"]).filter(inside(a, b))
    second = offered(left, "left", longer).join(offered(right, "right", shorter), [*keys, "_key"]).filter(inside(b, a) & (F.length(b) < F.length(a)))
    return first.unionByName(second).drop("_key")


def least_prefix(needed: float) -> float:
    """The least length ratio r of a prefix pair with 0.4 s + 0.2 r >= needed, where no sequence ratio s is over 2 r / (1 + r)."""
    low, high = 0.0, 1.0
    for _ in range(60):
        r = (low + high) / 2
        low, high = (low, r) if 0.8 * r / (1 + r) + 0.2 * r >= needed else (r, high)
    return max(low - 1e-9, 1e-3)


#: The words of the comparison of scans with and without the pelvis, and what it adds.
SCANS, ORGAN, CUT, BOOST = ("ct", "mri", "mr"), "abdomen", "pelvis", 0.1


def comparisons(names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Each distinct name as left and as right side: (id, kind, text, words, least).

    A pair is compared as it is (`plain`), or, for a CT or MRI name and an abdomen on both sides, without the pelvis that one of
    them has (`left` or `right`), which adds BOOST. Kinds that apply to the same pair exclude each other.
    """
    from .retrieval import tokens

    whole = lambda c: F.array_contains(F.col("words"), c)
    scan = F.get(F.split("text", r"\s+"), F.lit(0)).isin(*SCANS) & whole(ORGAN)
    cut = F.trim(F.replace(F.col("text"), F.lit(CUT), F.lit("")))
    row = lambda kind, text, least: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(least).alias("least"))
    # a pair that isn't a prefix pair needs 0.4 jaccard >= threshold - 0.4 at least
    plain, boosted = (threshold - 0.4) / 0.4, (threshold - BOOST - 0.4) / 0.4
    as_left = F.array(row("plain", F.col("text"), plain), F.when(scan, F.when(whole(CUT), row("left", cut, boosted)).otherwise(row("right", F.col("text"), boosted))))
    as_right = F.array(row("plain", F.col("text"), plain), F.when(whole(ORGAN), F.when(whole(CUT), row("right", cut, boosted)).otherwise(row("left", F.col("text"), boosted))))
    named = names.withColumn("words", tokens(F.col("text"))).filter(F.size("words") > 0)

    def of(kinds: Column) -> DataFrame:
        rows = named.select("id", F.col("words").alias("own"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select("id", "own", "k.*")
        return rows.withColumn("words", tokens(F.col("text"))).filter(F.size("words") > 0)

    return of(as_left), of(as_right)


def score_pairs(names: DataFrame, entries: DataFrame, threshold: float, sequence) -> DataFrame:
    """(left_id, right_id, score) at or above `threshold`; both sides have (id, text), one row per id."""
    from .retrieval import prefix_ratio

    left, right = comparisons(names, threshold)[0], comparisons(entries, threshold)[1]
    near = similar_sets(left, right, ["kind"]).drop("jaccard")
    both = F.size(F.array_intersect("left_words", "right_words"))
    jaccard = both / (F.size("left_words") + F.size("right_words") - both)
    starts = prefix_pairs(left, right, ["kind"], least_prefix(threshold - BOOST - 0.4)).filter(jaccard < F.col("left_least") - 1e-9)
    pairs = near.unionByName(starts)
    # a pair that is compared without the pelvis isn't also compared as it is; names without a common word aren't compared
    scan = F.get(F.split("left_text", r"\s+"), F.lit(0)).isin(*SCANS) & F.array_contains("left_own", ORGAN) & F.array_contains("right_own", ORGAN)
    boosted = scan & (F.array_contains("left_own", CUT) != F.array_contains("right_own", CUT))
    pairs = pairs.filter(((F.col("kind") != "plain") | ~boosted) & F.arrays_overlap("left_own", "right_own"))
    more = F.when(F.col("kind") == "plain", 0.0).otherwise(BOOST)
    a, b = F.col("left_text"), F.col("right_text")
    parts = F.struct(jaccard.alias("words"), prefix_ratio(a, b).alias("prefix"), more.alias("more"))
    pairs = pairs.select("left_id", "right_id", "left_text", "right_text", F.explode(F.array(parts)).alias("s"))  # once, not again in the filter
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    total = lambda ratio: 0.4 * ratio + 0.4 * F.col("s.words") + 0.2 * F.col("s.prefix")
    pairs = pairs.filter(total(2 * shortest / (longest + shortest)) + F.col("s.more") >= threshold - 1e-9)
    pairs = pairs.withColumn("_ratio", sequence(a, b)).select("left_id", "right_id", F.explode(F.array(F.struct(total(F.col("_ratio")).alias("total"), F.col("s.more").alias("more")))).alias("s"))
    score = F.when(F.col("s.more") > 0, F.least(F.lit(1.0), F.col("s.total") + F.col("s.more"))).otherwise(F.col("s.total"))
    return pairs.select("left_id", "right_id", score.alias("score")).filter(F.col("score") >= threshold)
