"""A vector index that grows with its catalogue: a two-level tree of centres, lists kept as a table, sketches before scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import BLOCK_BYTES, QUERY_ROWS, SLICE_ROWS

MAX_TRAIN, MAX_LISTS, LIST_ROWS = 20_000, 4096, 4096
SKETCH_BITS, SEED = 256, 7
FIRST, MOST, KEEP = 4, 0.6, 0.05
#: Queries whose sketches meet those of a list at once.
PIECE_QUERIES = 64


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def centres_of(points: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k unit centres of a bounded sample of unit vectors; empty ones take the points worst served."""
    rng = np.random.default_rng(seed)
    c = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        s = points @ c.T
        own = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = points[np.argsort(s.max(axis=1))[: len(empty)]]
        c = unit(sums)
    return c


@dataclass
class Tree:
    """Top centres, and the lists below each: `centres[i]` is of a list under top centre `parent[i]`."""

    top: np.ndarray
    centres: np.ndarray
    parent: np.ndarray
    plane: np.ndarray

    @staticmethod
    def grown(points: np.ndarray, lists: int) -> Tree:
        """About `lists` lists from a bounded sample, as many of them under a top centre as it has points."""
        top = centres_of(points, max(1, math.isqrt(lists)))
        own = (points @ top.T).argmax(axis=1)
        below, parent = [], []
        for t in range(len(top)):
            mine = points[own == t]
            if len(mine):
                c = centres_of(mine, max(1, round(lists * len(mine) / len(points))))
                below.append(c)
                parent += [t] * len(c)
        plane = np.random.default_rng(SEED).normal(size=(points.shape[1], SKETCH_BITS))
        return Tree(top, np.concatenate(below), np.array(parent), plane)

    def list_of(self, v: np.ndarray) -> np.ndarray:
        """The nearest list of each row, among those of its two nearest top centres."""
        near = np.argsort(-(v @ self.top.T), axis=1, kind="stable")[:, :2]
        best, score = np.zeros(len(v), np.int64), np.full(len(v), -np.inf)
        for t in np.unique(near):
            lists = np.flatnonzero(self.parent == t)
            rows = np.flatnonzero((near == t).any(axis=1))
            if len(lists):
                s = v[rows] @ self.centres[lists].T
                at = s.argmax(axis=1)
                s = s[np.arange(len(rows)), at]
                better = s > score[rows]
                best[rows[better]], score[rows[better]] = lists[at[better]], s[better]
        return best

    def sketch(self, v: np.ndarray) -> np.ndarray:
        return np.packbits(v @ self.plane > 0, axis=1)


@dataclass
class Index:
    """The tree, and the table of items by list. `reach` is the greatest angle between a list's centre and an item, `sizes` its items."""

    tree: Tree
    path: str
    reach: np.ndarray
    sizes: np.ndarray

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def build(catalogue: DataFrame, path: str, max_train: int = MAX_TRAIN, list_rows: int = LIST_ROWS) -> Index | None:
    """Index every (id, vector) of the catalogue; None for an empty one.

    There are about as many lists as the root of the number of rows (up to MAX_LISTS); the tree is fitted on at most about `max_train` rows, picked by hash. Vectors are
    taken at unit length. A list above `list_rows` rows is kept in parts.
    """
    spark = catalogue.sparkSession
    total = catalogue.count()
    if not total:
        return None
    share = min(1.0, max_train / total)
    picked = catalogue.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vector").limit(2 * max_train).toPandas()
    if not len(picked):
        picked = catalogue.select("vector").limit(1).toPandas()
    tree = Tree.grown(unit(stacked(picked["vector"])), min(MAX_LISTS, max(1, math.isqrt(total))))
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                t, v = shared.value, unit(stacked(b["vector"]))
                own = t.list_of(v)
                angle = np.arccos(np.clip((v * t.centres[own]).sum(axis=1), -1, 1))
                yield pd.DataFrame({"list": own, "item_id": b["id"], "v": list(v), "sketch": [s.tobytes() for s in t.sketch(v - t.centres[own])], "angle": angle})

    rows = catalogue.select("id", "vector").mapInPandas(placed, "list int, item_id long, v array<double>, sketch binary, angle double")
    rows.write.mode("overwrite").parquet(path)
    sizes, reach = np.zeros(len(tree.centres), np.int64), np.zeros(len(tree.centres))
    for r in spark.read.parquet(path).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect():  # a row per list
        sizes[r["list"]], reach[r["list"]] = r.n, r.a
    return Index(tree, path, reach, sizes)


@dataclass
class Blocks:
    """Lists in pieces, and pieces that follow each other in blocks. `of_list` and `of_piece`: the list and the block of each piece; `from_piece`: the first piece of each block, and one past the last."""

    tree: Tree
    reach: np.ndarray
    full: np.ndarray
    of_list: np.ndarray
    of_piece: np.ndarray
    from_piece: np.ndarray

    @staticmethod
    def dealt(index: Index, parts: np.ndarray, rows: int) -> Blocks:
        """Blocks of about `rows` items; each list is in so many parts."""
        held = np.cumsum(np.repeat(index.sizes / parts, parts))
        _, of_piece = np.unique(np.maximum(0, np.ceil(held) - 1) // max(1, rows), return_inverse=True)
        from_piece = np.searchsorted(of_piece, np.arange(of_piece[-1] + 2))
        return Blocks(index.tree, index.reach, index.sizes > 0, np.repeat(np.arange(len(parts)), parts), of_piece, from_piece)

    def visits(self, batches: Iterator[pd.DataFrame], first: int, visited: int, later: bool) -> Iterator[pd.DataFrame]:
        """The blocks each query (id, vector, low) goes to, with bits of the pieces there: of its `first` lists, or of the rest up to `visited` that its bound leaves."""
        for batch in batches:
            for at in range(0, len(batch), QUERY_ROWS):
                b = batch.iloc[at : at + QUERY_ROWS]
                v, ids, low = unit(stacked(b["vector"])), b["id"].to_numpy(), b["low"].to_numpy()
                s = np.where(self.full, v @ self.tree.centres.T, -np.inf)
                order = np.argsort(-s, axis=1, kind="stable")
                chosen = np.zeros(s.shape, bool)
                np.put_along_axis(chosen, order[:, first:visited] if later else order[:, :first], True, axis=1)
                chosen &= self.full
                if later:
                    near = np.maximum(0, np.arccos(np.clip(s, -1, 1)) - self.reach)
                    chosen &= np.cos(near) >= low[:, None]
                pieces = chosen[:, self.of_list]
                rows, blocks = np.nonzero(np.logical_or.reduceat(pieces, self.from_piece[:-1], axis=1))
                for a in range(0, len(rows), SLICE_ROWS):
                    i, to = rows[a : a + SLICE_ROWS], blocks[a : a + SLICE_ROWS]
                    bits = [np.packbits(pieces[x, self.from_piece[y] : self.from_piece[y + 1]]).tobytes() for x, y in zip(i, to, strict=True)]
                    yield pd.DataFrame({"query_id": ids[i], "q": list(v[i]), "low": low[i], "block": to.astype(np.int32), "bits": bits})


def near_rows(q: np.ndarray, centre: np.ndarray, plane: np.ndarray, bits: np.ndarray, size: np.ndarray, number: int) -> np.ndarray:
    """For each query the places of the `number` items that sketches take for the most like it; a slice of queries at a time."""
    apart = q - centre
    asked = np.packbits(apart @ plane > 0, axis=1).view(np.uint64)
    length, cosines = np.linalg.norm(apart, axis=1), np.cos(np.pi / SKETCH_BITS * np.arange(SKETCH_BITS + 1))
    differ = np.zeros((len(q), len(bits)), np.uint16)
    for word in range(bits.shape[1]):
        differ += np.bitwise_count(asked[:, word, None] ^ bits[None, :, word])
    about = length[:, None] * size * cosines[differ] - size**2 / 2
    return np.argpartition(-about, number - 1, axis=1)[:, :number]


class Best:
    """The k best items so far of each of some queries, by scores of twelve places; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, who: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((who, item, score))
        self.held += len(who)
        if self.held > 2 * self.n * self.k + 100_000:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, item, score = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((item, -score, who))
        who, item, score = who[order], item[order], score[order]
        kept = np.arange(len(who)) - np.searchsorted(who, np.arange(self.n))[who] < self.k
        self.parts, self.held = [(who[kept], item[kept], score[kept])], int(kept.sum())
        return self.parts[0]


def search(queries: DataFrame, index: Index, k: int = 15, first: int = FIRST, most: float = MOST, keep: float = KEEP, but_itself: bool = False, list_rows: int = LIST_ROWS, meter=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k items most like each (id, vector): query_id, item_id, score (cosine), rank.

    A query scores all of its `first` nearest lists, which give it a k-th best score. Then it visits the other lists that may hold a better
    item: the angle to the centre less the list's reach bounds what is in it. At most `most` of all lists are visited, nearest first; clustered
    vectors end long before. In these lists, items are compared by sketches: SKETCH_BITS signs of what parts them from the centre. The angle
    between two such differences, with their lengths, tells the score roughly, and only the best `keep` of the list (at least 2 k) are scored. `meter`, an accumulator, counts scored pairs.

    Lists that follow each other go into blocks of about `block_bytes`, and queries into parts as large. A query is sent once to each block in which it has lists,
    with the bits of their places there, and each block meets each part in a task, a list and a slice of queries after the other. So what a task holds doesn't grow with either side.
    """
    spark = queries.sparkSession
    wide = 8 * index.tree.centres.shape[1]
    parts = np.maximum(1, -(-index.sizes // list_rows))
    share = max(1, int(index.sizes.sum()) // (4 * spark.sparkContext.defaultParallelism))  # so that small tables go to all cores too
    dealt = Blocks.dealt(index, parts, min(max(1, block_bytes // wide), share))
    shared = spark.sparkContext.broadcast(dealt)
    visited = max(first, math.ceil(most * int(dealt.full.sum())))
    asked_parts = max(1, -(-queries.count() * wide // block_bytes))
    of = lambda xs, i: F.get(F.array(*[F.lit(int(x)) for x in xs]), i)
    piece = of(np.cumsum(parts) - parts, F.col("list")) + F.pmod(F.xxhash64("item_id"), of(parts, F.col("list")))
    items = index.items(spark).withColumn("piece", piece.cast("int")).withColumn("block", of(dealt.of_piece, F.col("piece"))).drop("list")
    items = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))

    def visits(rows: DataFrame, later: bool) -> DataFrame:
        sent = rows.mapInPandas(lambda batches: shared.value.visits(batches, first, visited, later), "query_id long, q array<double>, low double, block int, bits binary")
        return sent.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(asked_parts)).cast("int"))

    def merge(left: pd.DataFrame, right: pd.DataFrame, keep: float) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        blocks, tree = shared.value, shared.value.tree
        start = int(blocks.from_piece[left["block"].iloc[0]])
        queries, low, q = left["query_id"].to_numpy(), left["low"].to_numpy(), stacked(left["q"])
        asked = np.unpackbits(np.frombuffer(b"".join(left["bits"]), np.uint8).reshape(len(left), -1), axis=1).view(bool)
        right = right.sort_values("piece", kind="stable")
        pieces, ids, m, angle = right["piece"].to_numpy(), right["item_id"].to_numpy(), stacked(right["v"]), right["angle"].to_numpy()
        bits = np.frombuffer(b"".join(right["sketch"]), np.uint64).reshape(len(right), -1)
        best, scored = Best(len(left), k), 0
        for piece in np.unique(pieces):
            a, z = np.searchsorted(pieces, [piece, piece + 1])
            who = np.flatnonzero(asked[:, piece - start])
            n, size = min(z - a, max(2 * k, math.ceil(keep * (z - a)))), 2 * np.sin(angle[a:z] / 2)  # of an item's difference to the centre
            for at in range(0, len(who), PIECE_QUERIES):
                w = who[at : at + PIECE_QUERIES]
                if n < z - a:
                    near = a + near_rows(q[w], tree.centres[blocks.of_list[piece]], tree.plane, bits[a:z], size, n)
                    score = np.matmul(m[near], q[w][:, :, None])[:, :, 0]
                else:
                    near = np.broadcast_to(np.arange(a, z), (len(w), z - a))
                    score = q[w] @ m[a:z].T
                scored += near.size
                score = np.round(score, 12)
                if but_itself:
                    score[ids[near] == queries[w][:, None]] = -np.inf
                # what lies below the k-th best of those found before, or of these, is not among the best
                least = np.partition(score, n - min(k, n), axis=1)[:, n - min(k, n)]
                i, j = np.nonzero((score >= np.maximum(least, low[w])[:, None]) & np.isfinite(score))
                best.add(w[i], ids[near[i, j]], score[i, j])
        if meter is not None:
            meter.add(scored)
        who, item, score = best.rows()
        return pd.DataFrame({"query_id": queries[who], "item_id": item, "score": score})

    def scored(asked: DataFrame, keep: float) -> DataFrame:
        return asked.groupBy("block", "part").cogroup(items.groupBy("block", "part")).applyInPandas(lambda left, right: merge(left, right, keep), "query_id long, item_id long, score double")

    ties = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(ties)).filter(F.col("rank") <= k)
    asked = queries.select("id", "vector")
    begun = best(scored(visits(asked.withColumn("low", F.lit(-np.inf)), False), 1.0))
    begun.drop("rank").write.mode("overwrite").parquet(f"{index.path}-begun")
    begun = spark.read.parquet(f"{index.path}-begun")
    low = begun.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-1.0).alias("low"))
    rest = asked.join(low, "id", "left").withColumn("low", F.coalesce("low", F.lit(-1.0)))
    return best(begun.unionByName(scored(visits(rest, True), keep)))
