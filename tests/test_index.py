"""The index against the exact join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import index as ix
from termloom.operators import retrieval as rt


def vectors(kind, n, d=32):
    rng = np.random.default_rng(n)
    if kind == "random":
        return rng.normal(size=(n, d))
    centres = rng.normal(size=(max(2, n // 100), d)) * 3
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["random", "clustered"])
@pytest.mark.parametrize("n", [200, 20_000])
def test_recall_and_scored_pairs(spark, tmp_path, kind, n):
    v = ix.unit(vectors(kind, n))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(4)
    q = c.filter(F.col("id") % (n // 100) == 0)
    meter = spark.sparkContext.accumulator(0)
    found = {(r.query_id, r.item_id) for r in ix.search(q, ix.build(c, f"{tmp_path}/i"), 5, but_itself=True, meter=meter).collect()}
    exact = {(r.query_id, r.item_id) for r in rt.topk_vector_join(q, c, 5, but_itself=True).collect()}
    asked = q.count()
    assert len(exact) == 5 * asked and len(exact & found) >= 0.9 * len(exact)
    if n > 1000:  # a hundred times the rows
        assert meter.value < 0.1 * asked * n


def test_small_and_empty_catalogues(spark, tmp_path):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.item_id for r in ix.search(c.filter("id = 1"), ix.build(c, f"{tmp_path}/i"), 3).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (1, 3): 2}
    assert ix.build(c.limit(0), f"{tmp_path}/none") is None


def test_large_lists_are_kept_in_parts(spark, tmp_path):
    c = spark.createDataFrame([(i, [1.0, i / 1e6]) for i in range(300)], "id long, vector array<double>")
    i = ix.build(c, f"{tmp_path}/i")
    a = {(r.query_id, r.rank): r.item_id for r in ix.search(c.filter("id < 3"), i, 4, keep=1.0, list_rows=7).collect()}
    assert a == {(r.query_id, r.rank): r.item_id for r in ix.search(c.filter("id < 3"), i, 4, keep=1.0).collect()} and len(a) == 12


def test_scores_are_held_in_slices():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    q, items = rng.normal(size=(300, 8)), rng.normal(size=(50_000, 8))
    items[1000:] = items[rng.integers(0, 1000, 49_000)]  # copies, so ties
    ids = rng.permutation(50_000)
    tracemalloc.start()
    found = rt.best_of(np.arange(300), q, ids, items, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores of 256 queries alone are 102 MB
    scores = np.round(q @ items.T, 12)
    expected = [(i, ids[j]) for i in range(300) for j in np.lexsort((ids, -scores[i]))[:5]]
    assert list(zip(found.query_id, found.item_id, strict=True)) == expected


def test_visits_are_held_in_slices(spark, tmp_path):
    """A query goes once to each block, not to each list, and a batch's visits leave in slices."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(11)
    lists, n, d = 700, 3000, 32
    tree = ix.Tree(ix.unit(rng.normal(size=(26, d))), ix.unit(rng.normal(size=(lists, d))), np.sort(rng.integers(0, 26, lists)), rng.normal(size=(d, ix.SKETCH_BITS)))
    index = ix.Index(tree, "", np.full(lists, 1.2), np.full(lists, 700))
    blocks = ix.Blocks.dealt(index, np.ones(lists, np.int64), 70_000)
    v = rng.normal(size=(n, d))
    batch = pd.DataFrame({"id": np.arange(n), "vector": list(v), "low": np.full(n, 0.3)})
    tracemalloc.start()
    rows, pairs = 0, 0
    for sent in blocks.visits(iter([batch]), 4, 420, True):
        assert len(sent) <= ix.SLICE_ROWS and not sent.duplicated(["query_id", "block"]).any()
        rows, pairs = rows + len(sent), pairs + sum(int.from_bytes(x, "big").bit_count() for x in sent["bits"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(blocks.of_piece)) == 7 and rows <= 7 * n and pairs > 1_000_000
    assert peak < 40e6  # a row for each query and list would be over a million vectors


@pytest.mark.parametrize("block_bytes", [2560, 50_000])
def test_blocks_and_parts_lose_nothing(spark, tmp_path, block_bytes):
    v = ix.unit(vectors("clustered", 4000))
    v[::7] = v[0]  # equal scores
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(4)
    q, i = c.filter("id % 100 = 0"), ix.build(c, f"{tmp_path}/i")
    exact = {(r.query_id, r.rank): r.item_id for r in rt.topk_vector_join(q, c, 5, but_itself=True).collect()}
    got = ix.search(q, i, 5, most=1.0, keep=1.0, but_itself=True, list_rows=200, block_bytes=block_bytes)
    assert {(r.query_id, r.rank): r.item_id for r in got.collect()} == exact
