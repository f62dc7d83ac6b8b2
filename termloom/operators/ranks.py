"""Order statistics without sorting a table: exact quantiles, and pages far into an order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Rows of the ranges that a page is sorted from, the bounds of each refinement, and sampled rows for each bound.
PAGE_ROWS, BOUNDS, SAMPLED = 50_000, 64, 16


def kth_values(df: DataFrame, group: str, value: str, ranks: dict[object, list[int]], bins: int = BINS) -> dict[object, list[float]]:
    """The values at the given ranks (from 0) of each group, exactly.

    Each round counts the rows of a few ranges by bins (a row per bin, with its least and greatest value), and goes on with the
    bin that holds the rank. The least and the greatest value of a range fall in different bins, so a range of different values always gets smaller; a bin of one
    value ends the search. Groups are a few; NaN and null values are left out.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    edges = {r.g: (r.low, r.high) for r in rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}  # a row per group
    open_ = [(g, k, *edges[g], 0) for g, ks in ranks.items() for k in ks]  # group, rank, range, rows below the range
    found: dict[tuple, float] = {}
    while open_:
        for g, k, low, high, _ in open_:
            if low == high:
                found[g, k] = low
        open_ = [x for x in open_ if x[2] < x[3]]
        if not open_:
            break
        spans = sorted({(x[0], x[2], x[3]) for x in open_}, key=repr)
        spread = df.sparkSession.createDataFrame([(g, i, low, high) for i, (g, low, high) in enumerate(spans)], rows.select("g").schema.add("span", "integer").add("low", "double").add("high", "double"))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        inside = rows.join(F.broadcast(spread), "g").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        at = F.when(F.col("v") == F.col("high"), bins - 1).otherwise(F.least(F.floor(share * (bins - 1)), F.lit(bins - 2)))
        counts = inside.groupBy("span", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # BINS rows for each range
        per: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r.span, r.bin)):
            per.setdefault(r.span, []).append(r)
        following = []
        for g, k, low, high, below in open_:
            for r in per[spans.index((g, low, high))]:
                if below + r.n > k:
                    following.append((g, k, r.low, r.high, below))
                    break
                below += r.n
        open_ = following
    return {g: [found[g, k] for k in ks] for g, ks in ranks.items()}


def medians(df: DataFrame, group: str, value: str, bins: int = BINS) -> dict[object, float]:
    """The median of each group: of an even number, the mean of the two in the middle."""
    sizes = {r.g: r.n for r in df.groupBy(F.col(group).alias("g")).agg(F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("n")).collect() if r.n}
    got = kth_values(df, group, value, {g: sorted({(n - 1) // 2, n // 2}) for g, n in sizes.items()}, bins)
    return {g: sum(v) / len(v) for g, v in got.items()}


@dataclass(frozen=True)
class By:
    """A column of an order; nulls come first, or last where it is descending, as in Spark."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc() if self.descending else F.col(self.column).asc()

    def before(self, bound: Column) -> Column:
        c = F.col(self.column)
        low = (c > bound) | (c.isNotNull() & bound.isNull()) if self.descending else (c < bound) | (c.isNull() & bound.isNotNull())
        return F.coalesce(low, F.lit(False))


def before(order: list[By], bound: Column) -> Column:
    """Whether a row comes before a bound, a struct of the order's columns."""
    tests, equal = [], F.lit(True)
    for by in order:
        tests.append(equal & by.before(bound[by.column]))
        equal = equal & F.col(by.column).eqNullSafe(bound[by.column])
    return reduce(lambda a, b: a | b, tests)


def page_rows(df: DataFrame, order: list[By], offset: int, limit: int, most: int = PAGE_ROWS) -> DataFrame:
    """Rows offset to offset + limit of an order, which a last column should make complete.

    Ranges between sampled bounds are counted (a row per range), and only the ranges that hold the page go on, to be cut again while
    they hold over `most` rows. What is sorted at last is bounded by that, wherever the page lies; rows that tie in all columns can't be parted.
    """
    names = [b.column for b in order]
    size = df.count()
    while size > max(most, limit) and offset < size:
        share = min(1.0, SAMPLED * BOUNDS / size)
        picked = df.filter(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(*names).orderBy(*[b.order() for b in order]).limit(4 * SAMPLED * BOUNDS)
        sample = picked.collect()  # a bounded sample
        cuts = list(dict.fromkeys(sample[i * len(sample) // BOUNDS] for i in range(1, BOUNDS))) if sample else []
        if not cuts:
            break
        bounds = df.sparkSession.createDataFrame([tuple(c) for c in cuts], df.select(*names).schema).agg(F.collect_list(F.struct(*names)).alias("_bounds"))
        # a row's range: the bounds that it doesn't come before; they are one row of BOUNDS structs
        ranged = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: ~before(order, b)))).drop("_bounds")
        counts = {r["_range"]: r.n for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per range
        first, below = 0, 0
        while below + counts.get(first, 0) <= offset:
            below, first = below + counts.get(first, 0), first + 1
        last, held = first, counts.get(first, 0)
        while below + held < offset + limit and last < len(cuts):
            last += 1
            held += counts.get(last, 0)
        if held == size:  # ties: no cut parts them
            break
        df, offset, size = ranged.filter(F.col("_range").between(first, last)).drop("_range"), offset - below, held
    return df.orderBy(*[b.order() for b in order]).offset(offset).limit(limit)
