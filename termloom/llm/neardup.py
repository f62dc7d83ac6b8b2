"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts are collapsed by their MD5; one of each goes on.
2. Document frequencies of all five-word shingles are counted over the whole
   corpus in a hashed table of `TABLE` counters (fixed size at any scale, merged
   in two levels, broadcast as 4 MB). Copies count as one document: texts that share
   the least of their shingles under one of `KEYS` hashes are a group, counted in a first pass in a table of the
   same kind, and each text adds 1 / g, where g is the size of its `AGREE`-th largest group. Near copies share most of
   these hashes, so a large group of them doesn't make its own shingles common; unrelated texts with a common
   passage seldom share as many, so the passage's are.
   A shingle weighs log(1 + N / df) for each of its occurrences: the k-th occurrence is an
   element of its own, which gives min and max of term frequencies their exact part
   in the weighted Jaccard similarity of the TF-IDF vectors.
3. Each text is sampled with improved consistent weighted sampling; `BANDS` bands
   of `ROWS` samples are the buckets. A pair of similarity 0.8 shares a bucket
   with probability 0.9997.
4. Within a bucket, texts are compared exactly: the weighted intersections of
   up to `BLOCK` texts are one matrix product. A larger bucket is dealt into blocks. In a block, each text
   without a leader becomes one, and texts near it follow it; only leaders are compared
   between blocks. Two followers can only be near if their leaders' distance is within the radii of both leaders and
   the threshold together (the Jaccard distance is a metric), and only followers far enough from their leader;
   where that is so for different classes, these followers are compared exactly, in pairs of blocks of `BORDER`, so no link is lost.
   A group of n near copies costs n comparisons with a few leaders, and emits a spanning
   forest of its links, never its pairs. Buckets with equal members are compared
   once. A second round takes the remaining bands, for buckets that still span classes.
5. Links become classes by alternating large-star and small-star steps.

Each distinct text has a key of its own (`node`), by which texts are linked, so texts
without an id are compared like others. Each document gets `class_id`, the smallest id of its class.

Defined results: documents without a word (null and empty texts too) are alike only when equal,
and null is equal to empty; texts of under five words are one shingle; rows that share
an id are one document; rows with a null id are documents of their own, take part, but name no
class (`class_id` is null where all ids of a class are), and `keep_one` keeps one row of such a class;
an empty table gives an empty result; other columns are dropped by `classes`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_folder, small_batches, text_or_empty

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
FIRST_BANDS = 4
TABLE = 1 << 20
UNIT = 1 << 20  # a document in the counts
KEYS, AGREE = 8, 3  # hashes that name a document's groups, and how many must do so
BLOCK, BORDER = 256, 512
CHUNK_BYTES = 512 << 10
KEY_BITS = np.uint64(44)
KEY_MASK = np.uint64((1 << 44) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
MAX_BROADCAST_IDS = 1_000_000

LINK_MARGIN = 1e-6

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BLANK, WORD_AT = re.compile(r"[\x20\t-\r]"), re.compile(r"[^\x20\t-\r]+")


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segments(text: str) -> Iterator[str]:
    """A text in stretches of about CHUNK_BYTES characters that share WIDTH - 1 words, so that their shingles are the text's."""
    start, size = 0, CHUNK_BYTES
    while len(text) - start > 2 * size and (m := BLANK.search(text, start + size)):
        cut, width = m.start(), 1 << 12
        while len(words := list(WORD_AT.finditer(text, max(start, cut - width), cut))) < WIDTH and cut - width > start:
            width *= 2  # the first of the words found may be cut off itself
        if len(words) < WIDTH:  # too few words to share: a longer stretch
            size *= 2
            continue
        yield text[start:cut]
        start, size = words[-WIDTH + 1].start(), CHUNK_BYTES
    yield text[start:]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every window of words of up to 2 ** 20 texts."""
    found, batch, owners, size = [], [], [], 0
    for i, text in enumerate(texts):
        for part in segments(text):
            batch.append(part)
            owners.append(i)
            size += len(part)
            if size >= CHUNK_BYTES:
                at, shingle = hashed(batch)
                found.append((np.array(owners, np.int64)[at], shingle))
                batch, owners, size = [], [], 0
    at, shingle = hashed(batch)
    found.append((np.array(owners, np.int64)[at], shingle))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of texts of bounded size: words by a rolling hash of their bytes, shingles by one of their words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = powers(size)
    blank = SPACE[data]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[: len(data)])])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), starts, "right")
    weights = [np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1) for j in range(WIDTH)]
    n = max(0, len(words) - WIDTH + 1)
    whole = np.flatnonzero(doc[:n] == doc[WIDTH - 1 :][:n]) if n else np.zeros(0, np.int64)
    shingle = np.zeros(len(whole), np.uint64)
    for j, w in enumerate(weights):
        shingle += words[whole + j] * w
    at = doc[whole]
    counts = np.bincount(doc, minlength=len(texts))
    for d in np.flatnonzero((counts > 0) & (counts < WIDTH)):  # short texts are one shingle
        a = np.searchsorted(doc, d)
        value = sum((words[a + j : a + j + 1] * weights[j] for j in range(counts[d])), np.full(1, counts[d], np.uint64))
        shingle, at = np.append(shingle, value), np.append(at, d)
    return at, mix(shingle) >> np.uint64(20)


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, element) of up to 2 ** 20 texts, by document; all texts in full."""
    return elements_of(*shingles(texts))


def elements_of(at: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.sort(at.astype(np.uint64) << KEY_BITS | shingle)
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    place = np.arange(len(keys)) - np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
    at, shingle = (keys >> KEY_BITS).astype(np.int64), keys & KEY_MASK
    element = shingle.copy()
    again = place > 0
    element[again] = mix(shingle[again] + place[again].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(20)
    return at, shingle, element


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK_BYTES, and where each starts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def slot(shingle: np.ndarray) -> np.ndarray:
    """A shingle's counter."""
    return (shingle >> np.uint64(24)).astype(np.int64)


def first_of(at: np.ndarray) -> np.ndarray:
    """Where each document starts in a sorted column of documents."""
    return np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)


def counted(texts: DataFrame, count: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """`TABLE` sums over the whole corpus of what `count` gives for some texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(TABLE, np.int64)
        for batch in batches:
            for _, part in chunks(batch["text"].tolist()):
                total += count(part)
        if total.any():
            yield pd.DataFrame({"part": range(256), "counts": [x.astype("<i8").tobytes() for x in np.split(total, 256)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in rows["counts"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    schema = "part int, counts binary"
    parts = texts.select("text").mapInPandas(run, schema).withColumn("task", F.spark_partition_id() % 64)
    some = parts.groupBy("part", "task").applyInPandas(lambda x: add(x[["part", "counts"]]), schema)
    total = np.zeros(TABLE, np.int64)
    for r in some.groupBy("part").applyInPandas(add, schema).collect():  # 256 rows of 32 KB
        width = TABLE // 256
        total[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], "<i8")
    return total


def group_keys(at: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents with shingles, counters of their groups): copies share most of their least shingles under `KEYS` hashes."""
    if (at[1:] < at[:-1]).any():
        order = np.argsort(at, kind="stable")
        at, shingle = at[order], shingle[order]
    first = first_of(at)
    keys = np.empty((len(first), KEYS), np.int64)
    for k in range(KEYS if len(first) else 0):
        # the hashes are mixed already: an odd factor orders them anew (powers of one, as small multiples would order alike)
        least = np.minimum.reduceat(shingle * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) & KEY_MASK, first)
        keys[:, k] = slot(mix(least + np.uint64(k << 44)) >> np.uint64(20))
    return at[first], keys


def above_noise(counts: np.ndarray) -> np.ndarray:
    """Counters without what unrelated entries add to each."""
    return counts - np.floor(np.median(counts))


def group_sizes(texts: DataFrame) -> np.ndarray:
    """Documents of the group in each counter; 1 where a counter is within the noise of unrelated ones."""
    counts = counted(texts, lambda part: np.bincount(group_keys(*shingles(part))[1].ravel(), minlength=TABLE))
    sizes = above_noise(counts)
    return np.where(sizes > 6 * np.sqrt(np.median(counts)), np.maximum(sizes, 1), 1)


def frequencies(texts: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """Documents per counter over the whole corpus, a group of copies as about one."""
    share = texts.sparkSession.sparkContext.broadcast(np.maximum(UNIT // sizes, 1).astype(np.int64))

    def count(part: list[str]) -> np.ndarray:
        found = shingles(part)
        docs, groups = group_keys(*found)
        at, shingle, element = elements_of(*found)
        own = np.zeros(len(part), np.int64)
        own[docs] = np.partition(share.value[groups], AGREE - 1, axis=1)[:, AGREE - 1]
        once = shingle == element
        return np.bincount(slot(shingle[once]), own[at[once]], TABLE).astype(np.int64)

    return above_noise(counted(texts, count)) / UNIT


def weight_table(df: np.ndarray, documents: int) -> np.ndarray:
    """The weight of the shingles of each counter: log(1 + N / df)."""
    return np.log1p(documents / np.clip(df, 1, max(documents, 1))).astype(np.float32)


@lru_cache(1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), their logarithms, and of the uniform, at 65,536 places."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.linspace(0, 30, 1 << 20)
    gamma = np.interp(u, 1 - (1 + x) * np.exp(-x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), u.astype(np.float32)


def samples(at: np.ndarray, element: np.ndarray, weight: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with elements, their samples): sample k of a set is the element and level of the least a."""
    first = first_of(at)
    gamma, log_gamma, uniform = draws()
    log_weight = np.log(weight)
    out = np.empty((len(first), number), np.uint32)
    low = np.uint64(0xFFFF)
    for k in range(number):
        m = (element + np.uint64(1)) * np.uint64((k + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1 | 1)
        m ^= m >> np.uint64(29)
        m *= np.uint64(0x94D049BB133111EB)
        m ^= m >> np.uint64(32)
        r, beta = gamma[m & low], uniform[(m >> np.uint64(32)) & low]
        level = np.floor(log_weight / r + beta)
        a = log_gamma[(m >> np.uint64(16)) & low] - r * (level - beta + np.float32(1))
        bits = a.astype(np.float32).view(np.uint32)
        order = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        name = (m >> np.uint64(24) ^ level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(order << np.uint64(32) | name, first) & np.uint64(0xFFFFFFFF)
    return at[first], out


def signatures(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, md5, and the bucket of each band (none for texts without a word)."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            bands: list = [[] for _ in texts]
            for start, part in chunks(texts):
                at, shingle, element = elements(part)
                if not len(at):
                    continue
                docs, s = samples(at, element, shared.value[slot(shingle)], BANDS * ROWS)
                key = np.zeros((len(docs), BANDS), np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(31) + s[:, j::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                for d, k in zip(docs, key.view(np.int64), strict=True):
                    bands[start + d] = k
            yield pd.DataFrame({"doc_id": batch["doc_id"], "md5": batch["md5"], "bands": bands})

    return texts.select("doc_id", "md5", "text").mapInPandas(run, "doc_id long, md5 string, bands array<long>")


class Forest:
    """Union-find over a group's documents."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def similarities(left: list[int], right: list[int], sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """The exact weighted Jaccard similarity of the texts of `left` (rows) and `right` (columns), by matrix products."""
    sums = np.array([w.sum() for w in weights])
    both = np.zeros((len(left), len(right)))
    here = np.concatenate([sets[i] for i in left])
    there = np.concatenate([sets[i] for i in right])
    shared = np.intersect1d(here, there)
    # a column per shared element, a slice of columns at a time
    width = max(256, (8 << 20) // (len(left) + len(right)))
    for a in range(0, len(shared), width):
        vocabulary = shared[a : a + width]

        def rows(members: list[int], weighted: bool, vocabulary=vocabulary) -> np.ndarray:
            m = np.zeros((len(members), len(vocabulary)), np.float32)
            for n, i in enumerate(members):
                k = np.searchsorted(vocabulary, sets[i])
                k[k == len(vocabulary)] = 0
                ok = vocabulary[k] == sets[i]
                m[n, k[ok]] = weights[i][ok] if weighted else 1
            return m

        both += rows(left, True) @ rows(right, False).T
    return both / np.maximum(sums[left][:, None] + sums[right][None, :] - both, 1e-9) + LINK_MARGIN


def weighted_sets(texts: list[str], table: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sorted elements of each text, and their weights."""
    sets, weights = [], []
    for _, part in chunks(texts):
        at, shingle, element = elements(part)
        edges = np.searchsorted(at, np.arange(len(part) + 1))
        for i in range(len(part)):
            e = element[edges[i] : edges[i + 1]]
            o = np.argsort(e)
            sets.append(e[o])
            weights.append(table[slot(shingle[edges[i] : edges[i + 1]])][o])
    return sets, weights


LINK, LEADER, SUSPECT = 0, 1, 2
PAIRS = "what int, bucket long, a long, b long, far double, root long"


def compared(g: pd.DataFrame, table: np.ndarray, threshold: float, suspects: bool) -> list[tuple[int, int, int, int, float, int]]:
    """What one group (of one side, or of the two sides 0 and 1) tells.

    (LINK, bucket, a, b, 0, 0): classes that its links join, each linked to the smallest of those it is joined with;
    (LEADER, bucket, leader, follower, distance, class) where the bucket is split, the leader follows itself;
    (SUSPECT, bucket, leader, leader, least, 0) if asked: followers of this leader at a distance of `least` and more may be near
    followers of another class, by the leaders' distances and radii `far`.
    """
    ids, bucket = g["doc"].tolist(), int(g["bucket"].iloc[0])
    leaders = not suspects and int(g["blocks"].iloc[0]) > 1
    if len(ids) < 2:
        return [(LEADER, bucket, ids[0], ids[0], 0.0, int(g["class"].iloc[0]))] if leaders else []
    sets, weights = weighted_sets(g["text"].tolist(), table)
    sides = g["side"].to_numpy()
    left = np.flatnonzero(sides == sides.min())
    right = np.flatnonzero(sides != sides.min()) if (sides != sides.min()).any() else left
    near = similarities(left.tolist(), right.tolist(), sets, weights)
    forest, found = Forest(), []
    for a, b in zip(ids, g["class"].tolist(), strict=True):
        forest.join(a, b)
    before = {forest.root(x) for x in ids}
    for i, j in zip(*np.nonzero(near >= threshold), strict=True):
        forest.join(ids[left[i]], ids[right[j]])
    found += [(LINK, bucket, x, forest.root(x), 0.0, 0) for x in before if forest.root(x) != x]  # stars, which join in few rounds
    if leaders:
        free = np.ones(len(ids), bool)
        # texts with the most near ones lead first: few leaders, each with its followers close around it
        for i in np.argsort(-(near >= threshold).sum(axis=1), kind="stable"):
            if free[i]:
                own = (near[i] >= threshold) & free
                own[i] = True
                root = forest.root(ids[i])
                found += [(LEADER, bucket, ids[i], ids[j], 0.0 if j == i else max(0.0, 1.0 - float(near[i, j])), root) for j in np.flatnonzero(own)]
                free &= ~own
    if suspects:
        # the distance is a metric: followers can only be near if their leaders are within both radii and the threshold
        far, roots = g["far"].to_numpy(), np.array([forest.root(x) for x in ids])
        need = threshold - near - far[right][None, :]  # how far from its leader a follower on the left must be
        doubt = (near < threshold) & (need <= far[left][:, None]) & (roots[left][:, None] != roots[right][None, :])
        other = threshold - near - far[left][:, None]
        for rows, least in ((left, np.where(doubt, need, np.inf).min(axis=1)), (right, np.where(doubt, other, np.inf).min(axis=0))):
            found += [(SUSPECT, bucket, ids[i], ids[i], float(x), 0) for i, x in zip(rows, least, strict=True) if np.isfinite(x)]
    return found


def in_groups(members: DataFrame, keys: list[str], table: np.ndarray, threshold: float, folder: str, name: str, suspects: bool = False) -> DataFrame:
    """`compared` over each group of `members` (keys, bucket, blocks or far, side, doc, class, text)."""
    shared = members.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            edge = np.flatnonzero((rows[keys].diff() != 0).any(axis=1))
            rest = rows.iloc[edge[-1] :]
            yield told(rows, edge)
        if rest is not None:
            yield told(rest, [0, len(rest)])

    def told(rows: pd.DataFrame, edge) -> pd.DataFrame:
        found = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            found += compared(rows.iloc[a:b], shared.value, threshold, suspects)
        return pd.DataFrame(found, columns=["what", "bucket", "a", "b", "far", "root"])

    columns = list(dict.fromkeys([*keys, "bucket", "side", "doc", "class", "text", "far" if suspects else "blocks"]))
    ordered = members.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    with small_batches(members.sparkSession):
        return materialise(ordered.mapInPandas(run, PAIRS), folder, name)


def bucket_links(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], table: np.ndarray, threshold: float, folder: str, name: str, earlier: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a, b: links within the buckets of `members`; the classes that these and `earlier` links make).

    `members` has bucket, node, class, blocks and block; `texts_of` gives (doc, text) of some nodes.
    """

    def full(rows: DataFrame) -> DataFrame:
        needed = texts_of(rows.select("node"))
        return rows.join(needed, rows["node"] == needed["doc"])

    def linked(*told: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.filter(F.col("what") == LINK).select("a", "b") for x in told])

    told = in_groups(full(members.withColumn("side", F.lit(0))), ["bucket", "block"], table, threshold, folder, f"{name}-blocks")
    follows = told.filter(F.col("what") == LEADER).select("bucket", F.col("a").alias("leader"), F.col("b").alias("node"), "far", "root")
    links, doubt = linked(told), None
    if not follows.isEmpty():
        heads = follows.groupBy("bucket", F.col("leader").alias("node")).agg(F.max("far").alias("far"), F.min("root").alias("class"))
        blocks = heads.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        heads = materialise(heads.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")), folder, f"{name}-leaders")
        paired = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        paired = paired.select("bucket", "node", "class", "far", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"))
        between = in_groups(full(paired), ["bucket", "i", "j"], table, threshold, folder, f"{name}-between", suspects=True)
        links, doubt = linked(told, between), between.filter(F.col("what") == SUSPECT)
    known = components(reduce(DataFrame.unionByName, [*earlier, links]), folder, f"{name}-stars")
    if doubt is None or doubt.isEmpty():
        return links, known
    # only followers far enough out can be near one of another class: they are compared with each other, in pairs of blocks
    least = doubt.groupBy("bucket", F.col("a").alias("leader")).agg(F.min("far").alias("least"))
    border = follows.join(least, ["bucket", "leader"]).filter(F.col("far") >= F.col("least") - 1e-5).select("bucket", "node")
    border = border.join(known.select("node", "class"), "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    spans = border.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.ceil(F.count(F.lit(1)) / BORDER).cast("int").alias("n")).filter("lo < hi")
    border = border.join(spans.select("bucket", "n"), "bucket").withColumn("side", F.pmod(F.xxhash64("node", "bucket"), F.col("n")).cast("int"))
    both = border.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    both = both.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "class", F.lit(1).alias("blocks"))
    both = materialise(both, folder, f"{name}-border")
    if both.isEmpty():
        return links, known
    more = linked(in_groups(full(both), ["bucket", "i", "j"], table, threshold, folder, f"{name}-followers"))
    if more.isEmpty():
        return links, known
    links = links.unionByName(more)
    return links, components(reduce(DataFrame.unionByName, [*earlier, links]), folder, f"{name}-stars-again")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, class: the smallest node connected to it, for nodes with a link. Alternating star steps, a table each round."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before, turn = None, 0
    while True:
        e = materialise(e, folder, f"{name}-{turn}")
        state = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("class"))
        before, turn = state, turn + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def few(ids: DataFrame) -> bool:
    return ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS


def id_links(signed: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """a, b: links between the different texts of an id, if there are any."""
    again = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return None
    own = signed.select("doc_id", "md5").join(again, "doc_id", "left_semi").join(nodes.select("md5", "node"), "md5").select("doc_id", "node").distinct()
    return own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node != b").select(F.col("node").alias("a"), "b")


def labelled(docs: DataFrame, threshold: float, folder: str) -> DataFrame:
    """doc_id, md5 of the text, class_id and keeper (the md5 of one text of the class) for every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("md5", F.md5(F.col("text").cast("binary")))
    with small_batches(spark):
        table = weight_table(frequencies(texts, group_sizes(texts)), texts.count())
        signed = materialise(signatures(texts, table), folder, "signatures")
    nodes = signed.groupBy("md5").agg(F.min("doc_id").alias("doc"), F.min("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), folder, "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        need = nodes.select("node", F.col("md5").alias("_m"), "doc").join(wanted.distinct(), "node", "left_semi")
        need = F.broadcast(need) if few(need) else need
        own = (F.col("md5") == F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("doc"))  # of equal texts, those of the least id
        return texts.join(need, own).groupBy(F.col("node").alias("doc")).agg(F.min("text").alias("text"))

    links, known = [], None
    if (twins := id_links(signed, nodes)) is not None:
        links.append(materialise(twins, folder, "links-ids"))
        known = components(links[0], folder, "stars-ids")
    for turn, (a, b) in enumerate(((0, FIRST_BANDS), (FIRST_BANDS, BANDS))):
        part = nodes.select("node", F.explode(F.slice("bands", a + 1, b - a)).alias("bucket"))
        part = part.withColumn("class", F.col("node")) if known is None else part.join(known.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "bucket", F.coalesce("class", "node").alias("class"))
        buckets = part.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.expr("bit_xor(xxhash64(node))").alias("who"))
        buckets = buckets.filter("lo < hi").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        members = part.join(buckets.select("bucket", "blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
        members = materialise(members, folder, f"members-{turn}")
        found, known = bucket_links(members, texts_of, table, threshold, folder, f"turn-{turn}", links)
        links.append(found)
    known = known.unionByName(known.select(F.col("class").alias("node"), "class")).distinct()
    named = known.join(nodes.select("node", "doc", "md5"), "node").groupBy("class").agg(F.min("doc").alias("class_id"), F.min("md5").alias("keeper"))
    named = materialise(named, folder, "names")
    named = F.broadcast(named) if few(named) else named
    named = known.join(named, "class").select("node", "class", "class_id", "keeper")
    one = F.col("class").isNull()  # a text without links
    named = nodes.select("node", "md5", "doc").join(named, "node", "left").select("md5", F.when(one, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.when(one, F.col("md5")).otherwise(F.col("keeper")).alias("keeper"))
    return signed.select("doc_id", "md5").join(named, "md5")


def classes(docs: DataFrame, threshold: float = THRESHOLD, folder: str | None = None) -> DataFrame:
    """doc_id, class_id for every row."""
    return labelled(docs, threshold, folder or shared_folder(docs.sparkSession)).select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the smallest id of each class, or all but one row of a class without ids; all columns stay."""
    folder = shared_folder(docs.sparkSession)
    found = materialise(labelled(docs, threshold, folder), folder, "classes")
    gone = found.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    gone = F.broadcast(gone) if few(gone) else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    nameless = found.filter("doc_id is null")
    repeated = not found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not repeated and nameless.isEmpty():
        return left
    with_id = left.filter(F.col("doc_id").isNotNull())
    with_id = with_id.dropDuplicates(["doc_id"]) if repeated else with_id
    kept = nameless.filter(F.col("class_id").isNull() & (F.col("md5") == F.col("keeper"))).select(F.col("md5").alias("_kept")).distinct()
    rest = docs.filter(F.col("doc_id").isNull()).withColumn("_md5", F.md5(text_or_empty().cast("binary")))
    rest = rest.join(F.broadcast(kept) if few(kept) else kept, F.col("_md5") == F.col("_kept"), "left_semi").dropDuplicates(["_md5"])
    return with_id.unionByName(rest.select(*docs.columns))
