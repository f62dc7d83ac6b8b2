"""Periodic run detection: Lyndon arrays of both orders, their roots extended into runs.

A run is a stretch of words with smallest period q, at least `min_length` words and
`min_exponent` periods long, that no neighbouring word extends. Each run has a root, one
period long, that is the longest Lyndon word at its place under one of two orders of the
words: some order, or the same turned round. So it's enough to look at one word for each place and order.

* The Lyndon words come from the grouping phase of Baier's suffix sorter (`lyndon_groups`): places
  are grouped by the Lyndon word found so far, groups are taken from the highest down, and each lengthens
  the words that end where its own begin. Linear, but for the union-find that finds those words' places;
  no suffix array is built, and the other order is the same on letters turned round.
* Places of one group have equal words, so a root that repeats is a chain of places of one group, each
  one word after the last, of two at least where the run has three periods. The chain is extended by the longest common
  extension of the text and itself one period on, which ends within a period on either side.

Before that, words that can't be in a run are left out. In a run of L >= 3q and L >= 24 words the 8 words at its start
stand again after q and 2q, and the stretches so found cover it. So only stretches
covered by 8-word windows that occur three times in their text are searched; windows are compared by hash,
where a collision only adds a stretch to search. Every run lies in one such stretch.

Defined results: a null or empty text has no words and no runs, and collapses to the empty text;
equal runs of both orders are one; repeated rows are judged alike; an empty table gives an empty
result; columns named like the operator's own are replaced, all others stay. A text is one row of one task, and is held whole with some 100 bytes
for each word of its periodic stretches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, let, text_or_empty

MIN_LENGTH, MIN_EXPONENT = 24, 3
BATCH_ROWS = 500
RUNS = "array<struct<start: long, length: long, period: long>>"


def lyndon_groups(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, a number for the longest Lyndon word that starts there (the same for equal words), and the word's length.

    `order` holds the places by group; a group is named by its first index there and
    ends before `end`. Highest groups are finished first. For each place of the finished
    group, the nearest place before it that isn't finished holds a word u that
    ends where this one's word v begins; met k times, it becomes u v^k and moves to a
    new group right behind its old one, those with greater k behind the others.
    """
    n = len(letters)
    by_letter = np.argsort(letters, kind="stable")
    edges = np.flatnonzero(np.diff(letters[by_letter], prepend=-1))
    firsts = np.repeat(edges, np.diff(edges, append=n))
    place_of = np.empty(n, np.int64)
    place_of[by_letter] = np.arange(n)
    order, at, group = by_letter.tolist(), place_of.tolist(), firsts[place_of].tolist()
    length, end = [1] * n, [0] * n
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n], strict=True):
        end[a] = b
    up = list(range(n + 1))  # of place i, at i + 1: itself, or a place before it once finished; 0 stands for the edge
    top = n
    while top:
        g = group[order[top - 1]]
        v = length[g]
        if top - g == 1:  # one place: most groups
            x = order[g] + 1
            up[x] = x - 1
            x -= 1
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            met = {1: [x - 1]} if x else {}
        else:
            counts: dict[int, int] = {}
            places = order[g:top]
            for i in places:
                up[i + 1] = i
            for x in places:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                counts[x] = counts.get(x, 0) + 1
            counts.pop(0, None)
            met = {}
            for x, k in counts.items():
                met.setdefault(k, []).append(x - 1)
        top = g
        for k in sorted(met, reverse=True) if len(met) > 1 else met:
            moved = met[k]
            for j in moved:  # to the end of its group
                g0 = group[j]
                e = end[g0] - 1
                last, was = order[e], at[j]
                order[was], at[last] = last, was
                order[e], at[j] = j, e
                end[g0] = e
            new = [(end[group[j]], length[group[j]] + k * v) for j in moved]
            for j, (start, size) in zip(reversed(moved), reversed(new), strict=True):  # the first one stands last in its new group
                group[j], length[start], end[start] = start, size, at[j] + 1
    of = np.array(group, np.int64)
    return of, np.array(length, np.int64)[of]


def stretches(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that hold every run."""
    width, n = max(1, min_length // min_exponent), len(ids)
    if n < min_length:
        return
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    windows = n - width + 1
    key = mixed[:windows].copy()
    for k in range(1, width):
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key += mixed[k : k + windows]
    ordered = np.sort(key)
    often = np.unique(ordered[min_exponent - 1 :][ordered[min_exponent - 1 :] == ordered[: windows - min_exponent + 1]])
    if not len(often):
        return
    near = np.minimum(np.searchsorted(often, key), len(often) - 1)
    steps = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(often[near] == key)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    edges = np.flatnonzero(np.diff(np.cumsum(steps[:n]) > 0, prepend=False, append=False))
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= min_length:
            yield a, b


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries agree."""
    other = np.flatnonzero(a != b)
    return int(other[0]) if len(other) else len(a)


def extended(ids: np.ndarray, first: int, last: int, p: int) -> tuple[int, int]:
    """Start and end of the stretch of period p round [first, last)."""
    low = max(0, first - p)
    start = first - common(ids[low:first][::-1], ids[low + p : first + p][::-1])
    high = min(len(ids), last + p)
    return start, last + common(ids[last:high], ids[last - p : high - p])


def find(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a row of numbers, by start, then period."""
    if min_exponent < 3:
        raise ValueError("a run of under three periods needn't hold two whole roots")
    found = set()
    for a, b in stretches(ids, min_length, min_exponent):
        own = ids[a:b]
        letters = np.unique(own, return_inverse=True)[1]
        for ordered in (letters, letters.max() - letters):
            group, size = lyndon_groups(ordered)
            places = np.arange(len(own))
            after, before = places + size, places - size
            again = (after < len(own)) & (group[np.minimum(after, len(own) - 1)] == group)
            head = again & ~((before >= 0) & (group[np.maximum(before, 0)] == group))
            for i in np.flatnonzero(head).tolist():
                p = int(size[i])
                last = i + p
                while again[last]:
                    last += p
                last += p
                least = max(min_length, min_exponent * p)
                if last - i + 2 * (p - 1) >= least:
                    start, end = extended(own, i, last, p)
                    if end - start >= least:
                        found.add((a + start, end - start, p))
    return sorted(found)


def kept(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # of bytes, at U+0020 and U+0009 to U+000D alone


def collapse(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """`docs` with `runs` (word numbers, by start, then period) and `collapsed`: the words of which no run says the same before, joined by one space."""
    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    taken = docs.select(*[F.col(f"`{c}`") for c in others], text_or_empty(f"`{text}`").alias("_text"))
    schema = T.StructType([f for f in taken.schema if f.name != "_text"]).add("runs", T._parse_datatype_string(RUNS)).add("collapsed", "string")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BATCH_ROWS) for i in range(0, whole.num_rows, BATCH_ROWS)):
                found, texts = [], []
                for t in batch.column(batch.num_columns - 1):
                    words = words_of(t.as_py())
                    ids = np.array(list(map({}.setdefault, words, range(len(words)))), np.int64)
                    runs = find(ids, min_length, min_exponent)
                    if runs:
                        stay = kept(len(words), runs)
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    found.append(runs)
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*others, "runs", "collapsed"])

    return taken.mapInArrow(search, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text the query searches: with crc32 of a tenth of the ids, the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, a + (i - a) % p)).otherwise(w)), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), let(words, repeated)).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of each document, from its runs and its collapsed text."""
    found = collapse(docs.select("doc_id", planted(text_or_empty(), F.col("doc_id")).alias("text")))
    better = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda best, x: F.when(better(x, best), x).otherwise(best))
    line = lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
