"""Runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from termloom.llm import runs as rn


def longest_lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def brute(ids, min_length=24, min_exponent=3):
    ids, n, found = list(ids), len(ids), set()
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            s = ids[i : j + p]
            if j > i and len(s) >= max(min_length, min_exponent * p) and not any(s[q:] == s[:-q] for q in range(1, p)):
                found.add((i, len(s), p))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_groups_are_lyndon_words(letters):
    rng = random.Random(letters)
    for _ in range(150):
        s = np.unique([rng.randrange(letters) for _ in range(rng.randrange(1, 24))], return_inverse=True)[1]
        group, size = rn.lyndon_groups(s)
        assert size.tolist() == longest_lyndon(s.tolist())
        words = [tuple(s[i : i + m].tolist()) for i, m in enumerate(size)]
        assert len(set(zip(group.tolist(), words, strict=True))) == len(set(words)) == len(set(group.tolist()))
        assert [w for _, w in sorted(set(zip(group.tolist(), words, strict=True)))] == sorted(set(words))


def periodic(rng, n):
    s = []
    while len(s) < n:
        s += [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(1, 16))] * rng.choice([1, 1, 2, 3, 7, 20])
        if rng.random() < 0.3:
            s += s[-rng.randrange(1, len(s) + 1) :] * rng.choice([1, 3])
    return s[:n]


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(400):
        s = periodic(rng, rng.randrange(1, 260))
        assert rn.find(np.array(s)) == brute(s)
        assert rn.find(np.array(s), 9, 3) == brute(s, 9, 3) and rn.find(np.array(s), 10, 4) == brute(s, 10, 4)


@pytest.mark.parametrize("s", [list(range(30_000)) * 3, [0] * 200_000, [0, 1] * 60_000, list(range(300, 0, -1)) * 200])
def test_long_rows(s):
    p = len(set(s))
    assert rn.find(np.array(s)) == [(0, len(s), p)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    first = {}
    runs = brute([first.setdefault(w, i) for i, w in enumerate(words)])
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"wörd{w}" for w in periodic(rng, rng.randrange(1, 200)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 40), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(300, "x y z w " * 30), (301, "one\x0btwo\x0cthree\r\n" * 20), (302, "a " * 23), (303, "a " * 24)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rn.digests(d.selectExpr("*", "1 as runs", "2 as collapsed", "3 as best"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([expected(*r) for r in rows], key=repr)


def test_runs_of_two_periods_are_refused():
    with pytest.raises(ValueError):
        rn.find(np.zeros(30, np.int64), 10, 2)


def test_empty_table_and_own_names(spark):
    d = spark.createDataFrame([], "doc_id long, text string, runs int")
    assert rn.digests(d).count() == 0 and rn.collapse(d).columns == ["doc_id", "text", "runs", "collapsed"]
    d = spark.createDataFrame([(1, "a b " * 12, 5)], "id int, text string, runs int")
    row = rn.collapse(d).first()
    assert [tuple(r) for r in row.runs] == [(0, 24, 2)] and row.collapsed == "a b" and row[0] == 1
