"""Near-duplicate classes against brute-force weighted Jaccard similarity."""

import random
from collections import Counter

import numpy as np
import pytest

from termloom.llm import neardup as nd


def weights_of(spark, rows):
    """The weight of each shingle (a tuple of words), from the operator's corpus counts."""
    d = spark.createDataFrame([(t,) for _, t in rows], "text string")
    table = nd.weight_table(nd.frequencies(d, nd.group_sizes(d)), len(rows))

    def weight(gram):
        _, shingle = nd.shingles([" ".join(gram)])
        return float(table[nd.slot(shingle)][0])

    return weight


def grams(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b, weight):
    low = sum(weight[g] * min(a[g], b[g]) for g in a.keys() & b.keys())
    return low / sum(weight[g] * max(a[g], b[g]) for g in a.keys() | b.keys())


def closure(n, links):
    forest = nd.Forest()
    for a, b in links:
        forest.join(a, b)
    return [forest.root(i) for i in range(n)]


def judged(spark, rows):
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    counts = [grams(t) for _, t in rows]
    find = weights_of(spark, rows)
    weight = {g: find(g) for g in set().union(*counts)}
    every, near = 0, []
    for i in range(len(rows)):
        for j in range(i):
            if counts[i].keys() & counts[j].keys() and similarity(counts[i], counts[j], weight) >= nd.THRESHOLD:
                every += 1
                near.append((i, j))
    return got, every, near


def copies(rng, words, base, edits):
    copy = list(base)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = rng.choice(words)
    return " ".join(copy)


@pytest.mark.parametrize("seed", [1])
def test_all_near_pairs_and_no_others(spark, seed):
    """Copies with edits, a passage that many texts share, and repeated words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for k in range(20):
        base = [rng.choice(words) for _ in range(100)] + (["again and again"] * 8 if k % 3 == 0 else [])
        texts += [copies(rng, words, base, e) + (f" {passage}" if k % 2 else "") for e in (0, 0, 1, 2, 3, 4, 6, 9)]
    rows = list(enumerate(texts))
    got, every, near = judged(spark, rows)
    expected = closure(len(rows), near)
    assert every > 100 and sum(got[i] == got[j] for i, j in near) >= 0.98 * every
    # whatever shares a class is near, directly or through a chain
    assert all(expected[i] == expected[j] for i in range(len(rows)) for j in range(i) if got[i] == got[j])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Blocks of a few texts: leaders, their followers, and chains that only followers close."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(3):  # chains: each text a few words from the one before
        now = [rng.choice(words) for _ in range(80)]
        for step in range(30):
            texts.append(" ".join(now))
            for k in range(2):
                now[(step * 2 + k) % 80] = rng.choice(words)
    rows = list(enumerate(texts))
    got, every, near = judged(spark, rows)
    expected = closure(len(rows), near)
    assert every > 120 and all(got[i] == got[j] for i, j in near)
    assert len(set(got.values())) == len(set(expected))


def test_a_group_of_copies_keeps_its_weight(spark):
    """Near copies of one text are about one document in the counts, unrelated texts that share a passage are many."""
    rng = random.Random(3)
    words = [f"u{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(20)]
    rows = [(i, copies(rng, words, base, 3)) for i in range(200)]
    rows += [(1000 + i, " ".join([*(rng.choice(words) for _ in range(100)), *passage])) for i in range(200)]
    weight = weights_of(spark, rows)
    shared = np.mean([weight(g) for g in grams(" ".join(base))])
    common = np.mean([weight(g) for g in grams(" ".join(passage))])
    rare = weight(("u1", "never", "seen", "before", "u2"))
    assert shared > 0.9 * rare and common < 0.4 * rare
    # three edits in 120 words leave a similarity of about 0.6: brute force has the classes; one edit leaves over 0.8
    rows += [(3000 + i, copies(rng, words, base, 1)) for i in range(200)]
    got, _, near = judged(spark, rows)
    expected = closure(len(rows), near)
    assert all(got[rows[i][0]] == got[rows[j][0]] for i, j in near)
    assert len(set(got.values())) == len(set(expected))
    assert len({got[i] for i in range(3000, 3200)}) == 1 and len({got[i] for i in range(1000, 1200)}) == 200


def test_long_texts_are_cut_without_losing_shingles(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["aa", "b", "ccc dd", "e\n"]) + str(rng.randrange(50)) for _ in range(n)) for n in (3, 700, 5000)]
    texts += ["x" * 9000, "", "y" * 3000 + " z " + "w" * 4000, "one two " + "q" * 5000 + " three four five six"]
    whole = [tuple(np.sort(nd.shingles([t])[1])) for t in texts]
    monkeypatch.setattr(nd, "CHUNK_BYTES", 500)
    at, shingle = nd.shingles(texts)
    assert [tuple(np.sort(shingle[at == i])) for i in range(len(texts))] == whole


def test_stretches_are_bounded():
    """At the real size: a text of 1.2 million characters with one very long word in it."""
    text = "a few words and " * 20_000 + "q" * 600_000 + " and more words" * 20_000
    parts = list(nd.segments(text))
    assert all(len(p) <= 2 * nd.CHUNK_BYTES + 600_000 for p in parts) and sum(map(len, parts)) < len(text) + 600_000 + 200 * len(parts)
    plain = list(nd.segments("some plain words " * 300_000))
    assert len(plain) > 7 and max(map(len, plain)) <= 2 * nd.CHUNK_BYTES + 100
