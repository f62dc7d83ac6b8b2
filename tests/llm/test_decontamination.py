"""Decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.llm import decontamination as dc
from termloom.llm.common import text_or_empty

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    ids |= x - {None}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(rng, n, letters):
    return [rng.choice(["é", "x", "W", "q1"]) * rng.randrange(1, 3) + str(rng.randrange(letters)) for _ in range(n)]


def tables():
    rng = random.Random(11)
    join = lambda w: "".join(x + rng.choice([" ", ", ", "\n", "-", "'"]) for x in w)
    items = [(i, join(made(rng, rng.choice([0, 1, 2, 4, 5, 6, 9, 10, 11, 30]), 40))) for i in range(60)]
    items += [(7, items[59][1]), (None, "only the item without an id has these ten words here"), (61, None), (62, ""), (63, items[5][1]), (64, "tie tie tie tie tie tie tie tie tie tie tie")]
    docs = []
    for i in range(300):
        w = made(rng, rng.randrange(0, 60), 40)
        for _ in range(rng.randrange(0, 3)):
            piece = words(rng.choice(items)[1])
            a = rng.randrange(len(piece) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.2 and x.isascii() else x for x in piece[a : a + rng.randrange(1, 30)] or piece]
        docs.append((i, join(w)))
    docs += [(None, None), (None, docs[3][1]), (3, docs[3][1]), (400, ""), (401, " -- "), (402, "TIE " * 50), (403, "Only the item without an ID has these ten words here."), (404, "É" + "tie" * 3)]
    docs.append((405, "word " * 200_000 + items[59][1]))
    return docs, items


@pytest.mark.parametrize("small", [dc.SMALL, 0])
def test_equals_brute_force(spark, small):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as key", "2 as found")
    b = spark.createDataFrame(items, "item_id int, text string").repartition(3)
    got = sorted(map(tuple, dc.contaminated(d, b, small).collect()), key=repr)
    assert got == brute(docs, items) and sum(r[5] for r in got) > 100


def test_every_width_and_fingerprint(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(made(rng, 30, 5))) for i in range(40)]
    for width in (1, 4, 5, 6, 10):
        items = [(i, " ".join(words(t)[a : a + width])) for i, t in docs[:20] for a in (rng.randrange(20),)]
        got = dc.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_windows_share_fingerprints(spark):
    text = " ".join(f"w{i}" for i in random.Random(1).choices(range(10_000), k=3000))
    d = spark.createDataFrame([(text,)], "text string").select(F.inline(dc.windows_of(dc.words_of(text_or_empty()), 10)))
    assert d.count() == 2991 and d.select("print").distinct().count() < 2991 / 3  # 2 in 7 are picked


def test_clean_keeps_whole_rows(spark):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    b = spark.createDataFrame(items, "item_id int, text string")
    left = dc.clean(d, b)
    assert left.columns == d.columns and left.count() == sum(not r[5] for r in brute(docs, items))


def test_empty_tables(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs[:20], "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, dc.contaminated(d, b.limit(0)).collect()), key=repr) == brute(docs[:20], [])
    none = dc.contaminated(d.limit(0), b)
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
