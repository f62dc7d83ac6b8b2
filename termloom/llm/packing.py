"""Packing documents into sequences by cutting-stock column generation.

1. Tokenise: every text becomes ids (the tokenizer's, then `END`). A document
   is cut into full sequences and one remainder; each piece carries its CRC-32.
   Only these small rows leave the tokenising tasks.
2. Histogram: remainders are counted by length class (`step` ids wide). The
   histogram has `capacity / step` entries at any corpus size.
3. Column generation (driver, on the histogram alone): a linear program picks
   how often to use each cutting pattern; a knapsack by dynamic programming over
   the dual prices finds the next pattern, until none improves. Solutions are
   rounded down, and what is left (at most a few pieces per pattern) is packed
   best-fit into further patterns.
4. Assignment: within a class, pieces are ranked (hash ranges give the offsets,
   so a class with a third of all rows is spread); rank ranges map to patterns,
   and the place in the range gives the sequence. Offsets are prefix sums of the
   true lengths within a sequence.

A class is as long as its longest length, so a pattern never overfills; the
waste is under `step` ids a piece. A full sequence is one piece of `capacity`.

Defined results: a null or empty text is the one id `END`; repeated rows and
ids are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, shared_folder, small_batches

CAPACITY = 2048
END = 1
STEP = 8
MAX_WORDS = 50_000  # words in a generation of a worker's cache
LONG_WORD = 64  # longer words aren't kept
CHUNK = 1 << 20
BREAK = re.compile(r"[ \n]")
WORD_END = b"\xff"  # no byte of UTF-8
ROWS_IN_RANGE = 100_000  # about, of one length class
MAX_BROADCAST_RANGES = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Ids of pre-tokens as little-endian bytes, made on first use and kept by the Python worker.

    A text is normalised and cut as the tokenizer does it; each pre-token's ids are
    looked up, or merged by rank where they aren't known. Merging by rank (any two
    neighbours whose union is a token, the lowest id first) gives the tokenizer's
    own ids wherever ids grow in the order of the merges and each token is
    merged into itself. Texts that hold a special token go to the tokenizer.

    Two generations of at most `MAX_WORDS` words each bound the memory: words in
    use move on when a generation is full, the others are forgotten.
    """

    #: The tokenizer's pattern, for texts below U+0250 and for all others.
    narrow = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\x20\t-\r\x85\xa0a-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
    wide = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
    is_wide = re.compile("[^\0-\u024f]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}
        self.characters: set[str] = set()
        self.merge = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks(self.tokenizer.get_vocab(with_added_tokens=False)), special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.merge(word.encode(errors="surrogatepass") + WORD_END)).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= MAX_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def pre_tokens(self, text: str) -> list[str] | None:
        """The text cut as the tokenizer does; None if that isn't certain."""
        low = text.lower()
        if low.isascii() or not self.is_wide.search(low):
            return self.narrow.findall(low)
        if not self.characters.issuperset(here := set(text)):
            self.characters.update(c for c in here if unicodedata.category(c) != "Cn")
            if not self.characters.issuperset(here):  # newer than one of the libraries' Unicode tables
                return None
        return self.wide.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # σ: the tokenizer lowers letter by letter

    def of(self, text: str | None) -> bytes:
        """The ids of a text, `END` last."""
        text = text or ""
        if len(text) <= CHUNK:
            return self.encode(text) + END.to_bytes(4, "little")
        return b"".join([*map(self.encode, chunks(text)), END.to_bytes(4, "little")])

    def encode(self, text: str) -> bytes:
        words = None if any(x in text for x in self.special) else self.pre_tokens(text)
        if words is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, words))


def ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Token bytes to ids. Tokens are spelled in the printable alphabet of byte-level tokenizers; `</w>` becomes `WORD_END`."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    found = {}
    for token, i in vocabulary.items():
        word = token.removesuffix("</w>")
        found[bytes(byte[c] for c in word) + (WORD_END if word != token else b"")] = i
    return found | {WORD_END: max(found.values()) + 1}


def chunks(text: str) -> Iterator[str]:
    """A long text in stretches that end before a blank or line break, across which the tokenizer never joins."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + CHUNK)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


@lru_cache(1)
def word_ids(tokenizer: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    return WordIds(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: full sequences, then the remainder of the document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        ids = word_ids(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                buffer = ids.of(text)
                total = len(buffer) // 4
                for a in range(0, total, capacity):
                    b = min(a + capacity, total)
                    rows.append((doc, a, b - a, zlib.crc32(memoryview(buffer)[4 * a : 4 * b]), total))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    # ids travel as text: a null id would turn a batch of numbers into floats
    found = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, PIECES.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def knapsack(prices: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The pattern of highest price within `units`; prices[i] is of class i + 1, as long as i + 1 units."""
    best, choice = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    wide = np.arange(1, len(prices) + 1)
    for c in range(1, units + 1):
        fit = min(c, len(prices))
        worth = best[c - wide[:fit]] + prices[:fit]
        k = int(np.argmax(worth))
        if worth[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(prices)), units
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[units]), pattern


def solve(demand: np.ndarray, units: int, max_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts) of the linear program: fewest sequences that hold `demand`.

    Revised simplex over the classes in use; each round prices the duals by the knapsack.
    """
    use = np.flatnonzero(demand)
    n = len(use)
    if not n:
        return np.zeros((0, len(demand))), np.zeros(0)
    need = demand[use].astype(float)
    columns = np.diag(np.floor(units / (use + 1.0)))
    inverse = np.diag(1 / np.diag(columns))
    amounts = inverse @ need
    for turn in range(1, max_rounds + 1):
        if turn % 64 == 0:  # fresh inverse: rank-one updates lose digits
            inverse = np.linalg.inv(columns)
            amounts = np.maximum(inverse @ need, 0)
        duals = inverse.sum(axis=0)
        prices = np.zeros(len(demand))
        prices[use] = np.maximum(duals, 0)
        worth, pattern = knapsack(prices, units)
        if worth <= 1 + 1e-7:
            break
        enter = pattern[use]
        step = inverse @ enter
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        amounts = np.maximum(amounts - ratio[leave] * step, 0)
        amounts[leave] = ratio[leave]
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        columns[:, leave] = enter
    patterns = np.zeros((n, len(demand)))
    patterns[:, use] = columns.T
    return patterns, amounts


def best_fit(left: np.ndarray, units: int) -> list[np.ndarray]:
    """Patterns for the few pieces that rounding leaves: largest first, each filled best-fit downwards."""
    left, found = left.astype(int).copy(), []
    while left.any():
        room, pattern = units, np.zeros(len(left))
        while room > 0:
            fit = np.flatnonzero(left[:room])
            if not len(fit):
                break
            k = int(fit[-1])
            number = min(int(left[k]), room // (k + 1))
            pattern[k] += number
            left[k] -= number
            room -= number * (k + 1)
        found.append(pattern)
    return found


def plan(demand: np.ndarray, units: int) -> list[tuple[dict[int, int], int]]:
    """Whole cutting patterns ({class: pieces}, times) that hold exactly `demand`."""
    patterns, amounts = solve(demand, units)
    times = np.floor(amounts + 1e-6).astype(np.int64)
    left, found = demand.astype(np.int64).copy(), []
    for pattern, number in zip(patterns.astype(np.int64), times, strict=True):
        inside = pattern > 0
        number = int(min([number, *(left[inside] // pattern[inside])], default=0)) if inside.any() else 0
        if number > 0:
            left -= number * pattern
            found.append((pattern, number))
    found += [(p.astype(np.int64), 1) for p in best_fit(left, units)]
    return [({int(k) + 1: int(p[k]) for k in np.flatnonzero(p)}, n) for p, n in found]


def slot_table(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces in each sequence, first sequence, first slot) for every class of every pattern."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in patterns:
        slot = 0
        for kind, number in sorted(pattern.items(), reverse=True):
            a = ranks.get(kind, 0)
            ranks[kind] = b = a + number * times
            rows.append((kind, a, b, number, sequence, slot))
            slot += number
        sequence += times
    return rows


def ranges_of(rows: int) -> int:
    """Hash ranges for a class of so many rows: small ones at first, then about `ROWS_IN_RANGE` rows each."""
    return max(1, min(-(-rows // 500), 256), -(-rows // ROWS_IN_RANGE))


def row_rank(df: DataFrame, key: str, counts: dict[int, int], spread: Column, order: list[Column], folder: str, name: str) -> DataFrame:
    """`df` with `rank`, 0-based within `key`: the rows of each hash range of `spread` are counted, and give each range its offset.

    `counts` has the rows of each key; the number of ranges follows them.
    """
    ranges = {k: ranges_of(n) for k, n in counts.items() if n} or {0: 1}
    number = F.create_map(*[F.lit(x) for kv in ranges.items() for x in kv])[F.col(key)]
    split = df.withColumn("_range", F.pmod(spread, number.cast("long")))
    found = materialise(split.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")), folder, name)
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = found.select(key, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    ranked = split.withColumn("_within", within)
    offsets = F.broadcast(offsets) if sum(ranges.values()) <= MAX_BROADCAST_RANGES else offsets
    return ranked.join(offsets, [key, "_range"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_range", "_n", "_before", "_within")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, step: int = STEP, folder: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence_id and offset."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    with small_batches(spark):
        cut = materialise(pieces(docs, tokenizer, capacity), folder, "pieces")
    whole = cut.filter(F.col("length") == capacity)
    rest = cut.filter(F.col("length") < capacity).withColumn("kind", F.ceil(F.col("length") / step).cast("int"))
    units = capacity // step
    demand, full = np.zeros(units, np.int64), 0
    kinds = cut.groupBy(F.when(F.col("length") < capacity, F.ceil(F.col("length") / step).cast("int")).otherwise(0).alias("kind")).count()
    for r in kinds.collect():  # at most `units` + 1 rows
        if r["kind"]:
            demand[r["kind"] - 1] = r["count"]
        else:
            full = r["count"]
    slots = slot_table(plan(demand, units))
    ties = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    counts = {k + 1: int(n) for k, n in enumerate(demand)}
    ranked = row_rank(rest, "kind", counts, F.xxhash64("doc_id", "ids_crc32"), [F.xxhash64("doc_id"), *ties], folder, "class_ranges")
    plans: dict[int, list] = {}
    for kind, *row in slots:
        plans.setdefault(kind, []).append(row)
    table = spark.createDataFrame(
        [(k, v) for k, v in plans.items()],
        "kind int, ranges array<struct<first: long, last: long, number: int, sequence: long, slot: int>>",
    )
    # one row per class; the ranges of all classes together are bounded by the patterns
    placed = ranked.join(F.broadcast(table), "kind").withColumn("at", F.element_at(F.filter("ranges", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["last"])), 1))
    turn = F.col("rank") - F.col("at.first")
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("at.sequence") + F.floor(turn / F.col("at.number"))).alias("sequence_id"),
        (F.col("at.slot") + turn % F.col("at.number")).alias("slot"),
    )
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    mixed = placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).drop("slot")
    taken = sum(n for _, n in plan_sizes(slots))
    alone = row_rank(whole.withColumn("all", F.lit(0)), "all", {0: full}, F.xxhash64("doc_id", "start", "ids_crc32"), ties, folder, "whole_ranges")
    alone = alone.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + taken).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(alone)


def plan_sizes(slots: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int]]:
    """(first sequence, sequences) of each pattern."""
    found: dict[int, int] = {}
    for _, first, last, number, sequence, _ in slots:
        found[sequence] = (last - first) // number
    return sorted(found.items())
