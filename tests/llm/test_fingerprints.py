"""Fingerprints against a decoder of their own and plain sets of paragraphs."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.llm import fingerprints as fp


def cells(fingerprint):
    n, body = fingerprint.split(".")
    raw = base64.b64decode(body)
    out = {}
    for at in range(0, len(raw), 15):
        x = raw[at : at + 15]
        out[x[0]] = (int.from_bytes(x[1:3], "big"), int.from_bytes(x[3:11], "big"), int.from_bytes(x[11:], "big"))
    return int(n), out


def decoded(spark, a, b):
    """(digests only in a, only in b) from two fingerprints alone; None where peeling gets stuck."""
    left = {}
    for sign, f in ((1, a), (-1, b)):
        for i, (c, k, h) in cells(f)[1].items():
            x = left.get(i, (0, 0, 0))
            left[i] = (x[0] + sign * c, x[1] ^ k, x[2] ^ h)
    found = {1: set(), -1: set()}
    while True:
        once = [(c, k) for c, k, h in left.values() if abs(c) == 1]
        signed = lambda k: k - (1 << 64) if k >> 63 else k
        rows = spark.createDataFrame([(c, signed(k)) for c, k in once], "c int, k long").select("c", "k", fp.check_of(F.col("k")).alias("h"), *[(F.lit(t * fp.BASE) + fp.cell_of(F.col("k"), F.lit(t), F.lit(fp.BASE))).alias(f"i{t}") for t in range(3)])
        took = False
        for r in rows.collect():
            k, h = r.k % (1 << 64), r.h % (1 << 32)
            places = [r.i0, r.i1, r.i2]
            if not any(left.get(i) == (r.c, k, h) for i in places):  # more digests than one, or taken already
                continue
            for i in places:
                left[i] = (left[i][0] - r.c, left[i][1] ^ k, left[i][2] ^ h)
            found[r.c].add(r.k)
            took = True
        if not took:
            return (found[1], found[-1]) if not any(any(x) for x in left.values()) else None


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "dog", "sky", "tree"]) + str(rng.randrange(999)) for _ in range(8))
    out = []
    for i in range(40):
        out.append("\n".join(line() for _ in range(rng.choice([1, 3, 12, 90]))))
        if i % 4 == 0:  # close versions are neighbours
            rows = out[-1].split("\n")
            rows[0] = line()
            out.append("\n".join(rows))
    return [*out, "", "one line without an end " * 60, "字" * 2500, "x" * 3000, "A sentence. " * 5 + "Another one! " * 40]


def parts(text):
    """The paragraphs, by the stated rule."""

    def cut(ps, pieces):
        return [q for p in ps for q in (pieces(p) if len(p) > fp.MAX_PARAGRAPH else [p])]

    ps = cut(text.split("\n"), lambda x: re.split(fp.SENTENCE_END, x))
    ps = cut(ps, lambda x: re.split(fp.WORD_BREAK, x))
    return {p for p in cut(ps, lambda x: [x[i : i + fp.WINDOW] for i in range(0, len(x), fp.WINDOW)]) if p}


def test_likeness_is_the_jaccard_of_paragraphs(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fp.fingerprints(d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        following = texts[i - 1]
        cut = len(t) // 3
        for other, near in ((t[: len(t) - cut] + following[:cut], got[i].near_edited), (following, got[i].near_next)):
            a, b = parts(t), parts(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0), i
        assert cells(got[i].fingerprint)[0] == len(parts(t))


def test_two_fingerprints_give_their_difference(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(d).collect()}
    digest = {p: h for p, h in spark.createDataFrame([(p,) for p in {p for t in texts for p in parts(t)}], "p string").select("p", F.xxhash64("p")).collect()}
    tried = decodable = 0
    for i in range(0, 30, 3):
        a, b = parts(texts[i]), parts(texts[i + 1])
        both = decoded(spark, got[i], got[i + 1])
        tried += len(a ^ b) <= 16
        if both is not None:
            assert both == ({digest[p] for p in a - b}, {digest[p] for p in b - a})
            decodable += len(a ^ b) <= 16
    assert tried and decodable == tried


def test_hot_and_clumped_ids(spark, texts):
    """Ids far apart, repeated and null: every row has its neighbour by descending id."""
    ids = [None, None, -5, 2**62, 2**62, *range(7)]
    d = spark.createDataFrame([(k, texts[i]) for i, k in enumerate(ids)], "doc_id long, text string").repartition(4)
    rows = fp.with_next(d, "").collect()
    ordered = sorted(zip(ids, texts, strict=False), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    expected = [(k, t, ordered[(i + 1) % len(ordered)][1]) for i, (k, t) in enumerate(ordered)]
    assert sorted(map(str, [(r.doc_id, r.text, r.next_text) for r in rows])) == sorted(map(str, expected))
