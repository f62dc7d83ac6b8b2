"""Benchmark decontamination [native]: winnowed fingerprints find every shared window.

A benchmark item gives its windows of `WIDTH` consecutive words, or all its words as one window
if it has fewer. Winnowing gives each window one fingerprint: the least hash of its
k-grams, of ties the first, with k = `GRAM` (all of a window with fewer words). A window and its copy in
a document have the same fingerprint at the same place, so no shared window is missed, however long or short the shared span; neighbouring windows
mostly share theirs, so few k-grams are ever looked up further.

One narrow pass over the documents hashes words and k-grams and keeps the k-grams whose hash may be a
fingerprint of the benchmark: a bitmap of fixed size, a literal of the plan, tells most others apart. Where such a k-gram is the
least of a window, it is extended to that window, and only these few windows are written. They are joined with the benchmark's by fingerprint and
words; the fingerprint alone would pair up all windows round a frequent phrase. Words compare exactly, so
hashes that collide add nothing.

Skew: up to `SMALL` distinct windows of the benchmark are broadcast, after a count; more are joined by a
shuffle in which each document window takes one of `SALTS` salts. Documents with the same set of
windows share one list of items, so a passage that a third of the documents and many items hold is listed once.

All of it is DataFrame expressions, joins and aggregates.

Defined results: null and empty texts have no words; rows of one item id are one item; an item without
an id marks words, but is neither counted nor listed; repeated documents are judged alike; an empty benchmark
hits nothing; an empty table gives an empty result; other columns are dropped by `contaminated`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, shared_folder, text_or_empty

WIDTH, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIGH, PLACE = -(1 << 32), (1 << 31) - 1  # a k-gram's hash is in the high half of a long, its place in the low
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 24, 64  # of a bitmap, as powers of two; bits for each fingerprint
SMALL, SALTS = 200_000, 16
WINDOWS = "array<struct<at: int, width: int, print: int, window: string>>"


def words_of(text: Column) -> Column:
    """Words with A to Z in lower case. Texts of ASCII alone take the fast way."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))

    def inner(w: Column) -> Column:  # a text that begins or ends with a separator has an empty word there
        first = (F.get(w, F.lit(0)) == "").cast("int")
        last = ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
        return F.when(first + last == 0, w).otherwise(F.slice(w, 1 + first, F.greatest(F.size(w) - first - last, F.lit(0))))

    return let(F.split(lowered, SEPARATORS), inner)


def grams_of(hashes: Column, gram: int) -> Column:
    """For each k-gram the upper half of its hash, with its place below. `hashes` are those of the words."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (gram - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, gram)]).bitwiseAND(F.lit(HIGH)).bitwiseOR(i.cast("long")))


def place(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(PLACE)).cast("int")


def windows_of(words: Column, width: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """The windows of `width` words, each with its fingerprint; only those whose fingerprint is `wanted`."""
    gram = min(GRAM, width)
    inside = width - gram + 1  # k-grams of a window

    def found(grams: Column) -> Column:
        last = F.size(grams) - inside  # the last window
        fingerprint = lambda j: F.least(*[F.get(grams, j + k) for k in range(inside)]) if inside > 1 else F.get(grams, j)
        around = lambda g: F.sequence(F.greatest(place(g) - (inside - 1), F.lit(0)), F.least(place(g), last))
        window = lambda g, j: F.struct(
            j.alias("at"), F.lit(width).alias("width"), F.shiftright(g, 32).cast("int").alias("print"), F.array_join(F.slice(words, j + 1, width), " ").alias("window"),
        )
        of = lambda g: F.transform(F.filter(around(g), lambda j: fingerprint(j) == g), lambda j: window(g, j))
        return F.when(last >= 0, F.flatten(F.transform(F.filter(grams, lambda g: wanted(g)) if wanted else grams, of)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(let(hashes, lambda h: let(grams_of(h, gram), found)), F.array().cast(WINDOWS))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id and every window of the benchmark (at, width, print, window)."""
    def of(w: Column) -> Column:  # by the number of words; WIDTH of them and more have windows of WIDTH
        return reduce(lambda other, n: F.when(F.size(w) == n, windows_of(w, n)).otherwise(other), range(1, WIDTH), windows_of(w, WIDTH))

    return items.select("item_id", let(words_of(text_or_empty()), of).alias("w")).select("item_id", F.inline("w"))


def bitmaps(windows: DataFrame) -> dict[int, Callable[[Column], Column]]:
    """For each width of the benchmark's windows, whether a k-gram may be one of their fingerprints. Gathers a fixed number of words of bits for each of at most WIDTH widths."""
    counts = {r.width: r.n for r in windows.groupBy("width").agg(F.count_distinct("print").alias("n")).collect()}  # a row per width
    tests = {}
    for width, n in counts.items():
        power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
        bit = F.shiftrightunsigned(F.col("print").cast("long").bitwiseAND(F.lit((1 << 32) - 1)), 32 - power)
        own = windows.filter(F.col("width") == width).select(F.shiftright(bit, 6).alias("k"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        bits = dict.fromkeys(range(1 << (power - 6)), 0)
        bits |= {r.k: r.bits for r in own.groupBy("k").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits")).collect()}
        literal = F.split(F.lit(",".join(map(str, bits.values()))), ",").cast("array<long>")  # folded to one literal

        def test(g: Column, literal: Column = literal, power: int = power) -> Column:
            at = F.shiftrightunsigned(g, 64 - power)
            return F.getbit(F.get(literal, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        tests[width] = test
    return tests


def hit_words(spans: Column) -> Column:
    """How many words lie in spans (at, width), sorted by `at`."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["width"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def matches(docs: DataFrame, items: DataFrame, folder: str, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, members): key, doc_id and n_words of each document; key, at, width and wid of each window of a document that an item has; wid and item_id."""
    listed = materialise(item_windows(items), folder, "item-windows")
    by_window = ["width", "print", "window"]
    windows = materialise(listed.select(*by_window).distinct().withColumn("wid", F.monotonically_increasing_id()), folder, "windows")
    members = listed.filter(F.col("item_id").isNotNull()).join(windows, by_window).select("wid", "item_id").distinct()
    tests = bitmaps(windows)
    found = lambda w: F.flatten(F.array(*[windows_of(w, width, test) for width, test in sorted(tests.items())])) if tests else F.array().cast(WINDOWS)
    scanned = docs.select("doc_id", let(words_of(text_or_empty()), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("found"))).alias("d"))
    scanned = scanned.select(F.monotonically_increasing_id().alias("key"), "doc_id", "d.n_words", "d.found")
    rows = materialise(scanned, folder, "rows")
    candidates = rows.filter(F.size("found") > 0).select("key", F.inline("found"))
    if windows.count() <= small:
        hits = candidates.join(F.broadcast(windows), by_window)
    else:
        salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = candidates.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, [*by_window, "salt"])
    return rows.select("key", "doc_id", "n_words"), hits.select("key", "at", "width", "wid"), members


def contaminated(docs: DataFrame, items: DataFrame, small: int = SMALL) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    folder = shared_folder(docs.sparkSession)
    rows, hits, members = matches(docs, items, folder, small)
    spans = F.array_sort(F.collect_set(F.struct("at", "width")))
    own = materialise(hits.groupBy("key").agg(hit_words(spans).alias("n_hit"), F.array_sort(F.collect_set("wid")).alias("wids")), folder, "hits")
    sets = materialise(own.select("wids").distinct().withColumn("set", F.monotonically_increasing_id()), folder, "sets")
    pairs = sets.select("set", F.explode("wids").alias("wid")).join(members, "wid").select("set", "item_id").distinct()
    ids = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    lists = pairs.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    listed = own.join(sets, "wids").join(lists, "set", "left").select("key", "n_hit", "n_items", "items_sha256")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(listed, "key", "left").select(
        "doc_id", "n_words", n("n_hit"), n("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark; all columns stay."""
    folder = shared_folder(docs.sparkSession)
    whole = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), folder, "documents")
    rows, hits, _ = matches(whole.select(F.col("_row").alias("doc_id"), "text"), items, folder)
    hit = materialise(hits.select("key").distinct(), folder, "hit")
    return whole.join(rows.join(hit, "key", "left_semi").select(F.col("doc_id").alias("_row")), "_row", "left_anti").drop("_row")
