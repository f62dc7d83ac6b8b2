"""Document fingerprints [native]: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its distinct non-empty lines. Lines longer than
`MAX_PARAGRAPH` code points are cut after sentence ends; what is still longer,
after words that end in one of a few letters (so the cuts depend on the content
alone), and at last into windows of `WINDOW`. Each paragraph has a 64-bit digest,
and each digest falls in three cells, one in each third of the sketch. A cell holds
a signed count, the XOR of its digests and the XOR of their check hashes.

Two versions are compared by subtracting their sketches: common paragraphs vanish. A
cell that holds one digest (count +1 or -1, check hash fitting) is peeled: the
digest is taken out of its three cells, until nothing is left. The digests
peeled are the differing paragraphs. If cells remain, the comparison is
repeated with sketches of four times the size.

`fingerprint` is the sketch of 3 x `BASE` cells that the first comparison
subtracts: the number of paragraphs, and in base64 its filled cells (place 1 byte,
count 2, XOR 8, check hash 4). Sketches add up, so the cells of a difference are
the sums of signed cells, made in one aggregate.

All of it is DataFrame expressions and aggregates. Cells are rows; the rows of
a document stay in the task that its key was shuffled to once, so subtracting
and peeling need no further shuffle.

Likeness is the Jaccard similarity of the paragraph sets, from the number of
digests that were peeled: (|A| + |B| - d) / (|A| + |B| + d); two texts without
paragraphs are alike (1.0).

Defined results: null texts are empty; rows with equal ids are ordered by text;
a null id comes last; a single document is its own neighbour; an empty table gives
an empty result; other columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, shared_folder, text_or_empty

BASE = 16  # cells in a third of the fingerprint
MAX_PARAGRAPH, WINDOW = 200, 100
SENTENCE_END = r"(?<=[.!?。！？])\x20?"
WORD_BREAK = r"(?<=[dgkoy]\x20)"
SWEEPS = 9
ROWS_IN_RANGE = 200_000  # about, of the ranges of ids
SAMPLED = 16  # ids for each range
OFFSET = -(2**63)  # the place of a null id


def cut_longer(parts: Column, pieces) -> Column:
    """`parts` with those over MAX_PARAGRAPH code points replaced by their `pieces`."""
    long = lambda x: F.length(x) > MAX_PARAGRAPH
    cut = lambda ps: F.flatten(F.transform(ps, lambda x: F.when(long(x), pieces(x)).otherwise(F.array(x))))
    return let(parts, lambda ps: F.when(F.exists(ps, long), cut(ps)).otherwise(ps))


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    parts = cut_longer(F.split(text, "\n"), lambda x: F.split(x, SENTENCE_END))
    parts = cut_longer(parts, lambda x: F.split(x, WORD_BREAK))
    parts = cut_longer(parts, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x)))


def check_of(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def cell_of(key: Column, third: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(key, third), size).cast("int")


def id_ranges(places: DataFrame, ranges: int, rows: int) -> DataFrame:
    """`places` (with `place`) with `range`, numbered from the highest ids down, of about equal numbers of rows.

    The bounds come from a bounded sample of ids, picked by hash. They are looked up
    by an equi-join: the span of the ids is a grid of steps, and each step knows the
    bounds inside it and how many lie above.
    """
    spark = places.sparkSession
    share = min(1.0, SAMPLED * ranges / max(rows, 1))
    some = places.select("place").filter((F.col("place") > OFFSET) & (F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    sample = sorted(x[0] for x in some.collect())
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else [0]
    low, step = bounds[0], max(1, -(-(bounds[-1] - bounds[0] + 1) // (4 * len(bounds))))
    inside: dict[int, list[int]] = {}
    for x in bounds:
        inside.setdefault((x - low) // step, []).append(x)
    last = (bounds[-1] - low) // step
    rows, above = [(last + 1, 0, [])], 0
    for g in range(last, -1, -1):
        rows.append((g, above, inside.get(g, [])))
        above += len(inside.get(g, []))
    rows.append((-1, above, []))
    grid = spark.createDataFrame(rows, "_g long, _above int, _inside array<long>")
    at = F.when(F.col("place") < low, -1).when(F.col("place") > bounds[-1], last + 1).otherwise(F.expr(f"(place - {low}L) div {step}L"))
    placed = places.withColumn("_g", at.cast("long")).join(F.broadcast(grid), "_g")
    return placed.withColumn("range", F.col("_above") + F.size(F.filter("_inside", lambda b: b > F.col("place")))).drop("_g", "_above", "_inside")


def with_next(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, text, next_text and range, with the digests a and x of both texts, by descending id; the last one's next is the first.

    Ids are cut into ranges of about equal numbers of rows; each range also gets
    the first row of the range after it, so the neighbour is found in one shuffle by range.
    """
    spark = docs.sparkSession
    total = docs.count()
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_IN_RANGE))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(OFFSET))  # a null id comes last
    rows = id_ranges(docs.select("doc_id", text_or_empty().alias("text"), place.alias("place")), ranges, total)
    firsts = id_ranges(docs.select(place.alias("place")), ranges, total).groupBy("range").agg(F.max("place").alias("first")).orderBy("range").collect()  # a row per range
    own = [x["range"] for x in firsts] or [0]
    # the first row of a range is a guest in the one before; the very first in the last one, behind all others
    homes = [(x["first"], own[i - 1], 2 if i == 0 else 1) for i, x in enumerate(firsts)]
    homes = spark.createDataFrame(homes, "place long, home int, guest int")
    rows = rows.join(F.broadcast(homes), "place", "left")
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    there = F.struct(F.col("home").alias("range"), F.col("guest").alias("guest"))
    copies = F.explode(F.when(F.col("home").isNull(), F.array(here)).otherwise(F.array(here, there)))
    spread = rows.select("doc_id", "text", "place", copies.alias("at")).select("doc_id", "text", paragraphs(F.col("text")).alias("a"), "place", "at.range", "at.guest")
    spread = spread.repartition(len(own), "range")
    order = Window.partitionBy("range").orderBy("guest", F.col("place").desc(), "text")
    found = spread.withColumn("next", F.lead(F.struct("text", "a")).over(order)).filter(F.col("guest") == 0)
    return found.select("doc_id", "text", F.coalesce("next.text", F.lit("")).alias("next_text"), "a", F.coalesce("next.a", F.array().cast("array<long>")).alias("x"), "range")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 3) code points replaced by the first as many of the next text."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(following, F.lit(1), cut))


def sketched(pairs: DataFrame, key_columns: list[str]) -> DataFrame:
    """Subtract and peel. `pairs` has the key columns, pair, size (cells in a third), a and b (digests).

    Gives the key columns with pair, peeled (digests recovered) and stuck (cells left).
    """
    signed = F.concat(  # the stand-in without a digest keeps pairs whose cells all vanish
        F.array(F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"))),
        F.transform("a", lambda k: F.struct(F.lit(1).alias("c"), k.alias("k"))),
        F.transform("b", lambda k: F.struct(F.lit(-1).alias("c"), k.alias("k"))),
    )
    by = [*key_columns, "pair", "size"]
    cells = pairs.select(*by, F.explode(signed).alias("x")).select(*by, F.col("x.c").cast("long").alias("c"), F.col("x.k").alias("k"))
    thirds = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    cells = cells.select(*by, "c", "k", F.when(F.col("c") == 0, F.lit(0).cast("long")).otherwise(check_of(F.col("k"))).alias("h"), thirds.alias("t"))
    cells = cells.withColumn("i", F.when(F.col("c") == 0, F.lit(-1)).otherwise(cell_of(F.col("k"), F.col("t"), F.col("size"))))
    for sweep in range(-1, SWEEPS):
        if sweep >= 0:
            cells = peeled(cells, by, sweep % 3)
        sums = cells.groupBy(*by, "t", "i").agg(F.sum("c").alias("c"), F.expr("bit_xor(k)").alias("k"), F.expr("bit_xor(h)").alias("h"))
        cells = sums.filter((F.col("c") != 0) | (F.col("k") != 0) | (F.col("h") != 0) | (F.col("i") < 0))
    return cells.groupBy(*key_columns, "pair").agg(
        F.coalesce(F.sum(F.when(F.col("t") == 3, F.col("c"))), F.lit(0)).alias("peeled"), F.count_if((F.col("t") < 3) & (F.col("i") >= 0)).alias("stuck")
    )


def peeled(cells: DataFrame, by: list[str], third: int) -> DataFrame:
    """One sweep: every pure cell of one third becomes the removal of its digest from the other thirds, and a count."""
    pure = (F.col("t") == third) & (F.col("i") >= 0) & (F.abs("c") == 1) & (F.col("h") == check_of(F.col("k")))
    cell = lambda t, i, c, k, h: F.struct(t.alias("t"), i.alias("i"), c.alias("c"), k.alias("k"), h.alias("h"))
    others = [cell(F.lit(t), cell_of(F.col("k"), F.lit(t), F.col("size")), -F.col("c"), F.col("k"), F.col("h")) for t in range(3) if t != third]
    counted = cell(F.lit(3), F.lit(-1), F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    same = cell(F.col("t"), F.col("i"), F.col("c"), F.col("k"), F.col("h"))
    return cells.select(*by, F.explode(F.when(pure, F.array(*others, counted)).otherwise(F.array(same))).alias("x")).select(*by, "x.*")


def likeness(a: Column, b: Column, d: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - d) / (a + b + d))


def packed(base: DataFrame) -> DataFrame:
    """row, fingerprint and edited_fingerprint from the digests `a` and `e`."""
    both = F.array(F.struct(F.lit("a").alias("w"), F.col("a").alias("keys")), F.struct(F.lit("e").alias("w"), F.col("e").alias("keys")))
    keys = base.select("row", F.explode(both).alias("v")).select("row", "v.w", F.size("v.keys").alias("n"), F.explode_outer("v.keys").alias("k"))
    cells = keys.select("row", "w", "n", "k", check_of(F.col("k")).alias("h"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t"))
    cells = cells.withColumn("i", F.col("t") * BASE + cell_of(F.col("k"), F.col("t"), F.lit(BASE)))
    sums = cells.groupBy("row", "w", "n", "i").agg(F.count("k").alias("c"), F.expr("bit_xor(k)").alias("k"), F.expr("bit_xor(h)").alias("h"))
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    cell = F.concat(digits(F.col("i"), 2), digits(F.col("c") % 65536, 4), digits(F.col("k"), 16), digits(F.col("h").bitwiseAND(0xFFFFFFFF), 8))
    text = F.concat_ws(".", F.col("n").cast("string"), F.base64(F.unhex(F.array_join(F.array_sort(F.collect_list(F.when(F.col("c") > 0, cell))), ""))))
    named = sums.groupBy("row", "w", "n").agg(text.alias("f"))
    of = lambda w: F.max(F.when(F.col("w") == w, F.col("f")))
    return named.groupBy("row").agg(of("a").alias("fingerprint"), of("e").alias("edited_fingerprint"))


def compare(texts: DataFrame, folder: str) -> DataFrame:
    """Fingerprints of `text` and its edited text, and the likeness to the edited and the next text.

    `texts` is the result of `with_next`.
    """
    spark = texts.sparkSession
    e = edited(F.col("text"), F.col("next_text"))
    keys = texts.select("range", "doc_id", F.length("text").cast("long").alias("n_chars"), e.alias("edited"), "a", "x")
    keys = keys.select("range", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", paragraphs(F.col("edited")).alias("e"), "x")
    base = materialise(keys.withColumn("row", F.monotonically_increasing_id()), folder, "digests")
    pairs = base.select("row", F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.col("a").alias("a"), F.col(b).alias("b")) for p, b in (("edited", "e"), ("next", "x"))])).alias("p"))
    pairs = pairs.select("row", "p.*").withColumn("size", F.lit(BASE).cast("long"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done, attempt = [], 0
    while True:
        result = materialise(sketched(pairs.repartition(tasks, "row"), ["row"]), folder, f"peeled-{attempt}")
        done.append(result.filter(F.col("stuck") == 0))
        failed = result.filter(F.col("stuck") > 0).select("row", "pair")
        if failed.isEmpty():
            break
        attempt += 1
        pairs = pairs.join(failed, ["row", "pair"], "left_semi").withColumn("size", F.col("size") * 4)
    of = lambda p: F.max(F.when(F.col("pair") == p, F.col("peeled")))
    peeled_all = reduce(DataFrame.unionByName, done).groupBy("row").agg(of("edited").alias("edited"), of("next").alias("next"))
    n = lambda c: F.size(c)
    sizes = base.select("row", "doc_id", "n_chars", "edited_sha256", n("a").alias("a"), n("e").alias("e"), n("x").alias("x"))
    joined = sizes.join(peeled_all, "row").join(packed(base.select("row", "a", "e").repartition(tasks, "row")), "row")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("a"), F.col("e"), F.col("edited")).alias("near_edited"),
        likeness(F.col("a"), F.col("x"), F.col("next")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or shared_folder(docs.sparkSession)
    return compare(with_next(docs, folder), folder)
