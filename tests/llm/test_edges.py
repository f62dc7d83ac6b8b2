"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import fingerprints, langid, mixing, neardup, packing, pii, quality, secrets, urls, warc
from termloom.llm.common import shared_folder
from termloom.llm.queries import URL_RULES, tokenizer_path

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards watch quietly from a distant hill. "
LONG = PROSE * 400
ROWS = [
    (1, PROSE * 3, "en", "a"),
    (2, PROSE * 3, "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "b"),
    (7, "Le petit chat dort sur la chaise rouge pendant que la pluie tombe doucement sur le toit de la maison. " * 3, "fr", "b"),
    (8, "eins", "de", None),
    (None, "Ein Text ohne Nummer, der trotzdem gelesen werden soll.", "de", "c"),
    (2, PROSE * 3, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("size", "target", "taken", "score", "lang_pred", "md5", "bands", "range", "kind", "rank", "pii_spans", "n_words", "kept", "key")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    expected = sum(-(-(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1) // 2048) for x in ROWS)
    assert len(rows) == expected
    assert len([r for r in rows if r.doc_id is None]) == 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    long = sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.start)
    ids = [*t.encode(LONG, add_special_tokens=False).ids, 1]
    for r in long:
        part = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
        assert zlib.crc32(part) == r.ids_crc32
    assert packing.pack(none, tokenizer_path()).count() == 0


WORDS = ["Σας", "ΣΑΣ ΟΔΟΣ", "<|endoftext|>", "a<|endoftext|>b", "éa", "it's they'LL '' ''s --'s", "İb", "x\u00a0y", "日本語", "a_'s1２", "a\u0301 \u0301", "\x1c\x1d a\x85b", "ﬁ½²", "x\u200by"]


@pytest.mark.parametrize("word", WORDS)
def test_word_ids_are_the_tokenizers(word):
    ids = packing.WordIds(tokenizer_path())
    text = f"one {word} two\n{word}"
    assert ids.of(text) == tokenizer_ids(ids.tokenizer, text)


def tokenizer_ids(tokenizer, text):
    return b"".join(i.to_bytes(4, "little") for i in [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])


def test_every_character_has_the_tokenizers_ids():
    ids = packing.WordIds(tokenizer_path())
    for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)]:
        text = f"a{chr(c)}b 1{chr(c)}"
        assert ids.of(text) == tokenizer_ids(ids.tokenizer, text), hex(c)


def test_ids_of_a_whole_table(spark, monkeypatch):
    """Small caches and chunks, so that words are forgotten and long texts are cut."""
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    monkeypatch.setattr(packing, "CHUNK", 300)
    ids = packing.WordIds(tokenizer_path())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert ids.of(r.text) == tokenizer_ids(ids.tokenizer, r.text)
    assert len(ids) <= 50 and len(ids.old) <= 50


def test_merging_by_rank_is_the_tokenizers_merging():
    """Ids grow in the order of the merges, and the merges make each token of its own letters: then both merge alike."""
    import json

    with open(tokenizer_path()) as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    assert order == sorted(order)
    rank = {p: i for i, p in enumerate(pairs)}
    for token in model["vocab"]:
        word = token.removesuffix("</w>")
        parts = [*word[:-1], word[-1] + token[len(word) :]] if word else [token]
        while len(parts) > 1:
            i = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            assert (parts[i], parts[i + 1]) in rank, token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [token]


def test_plan_holds_every_piece():
    import numpy as np

    demand = np.random.default_rng(3).integers(0, 40, 64)
    patterns = packing.plan(demand, 64)
    got = np.zeros(64, int)
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            got[k - 1] += n * times
    assert (got == demand).all()
    optimum = packing.solve(demand, 64)[1].sum()  # of the linear program, a lower bound
    assert optimum <= sum(t for _, t in patterns) <= 1.03 * optimum + 2


def test_pii(docs, none):
    rows = pii.replace(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.text or "-") for r in rows) == sorted((x[1] or "-") if x[1] is not None else "-" for x in ROWS)
    assert pii.replace(none).count() == 0


def test_surrogates(spark):
    texts = ["Mail ann@corp.example.com or ANN@corp.example.com, +1 (659) 555-3949, 4111 1111 1111 1111.", "Frau Anna Keller, Г-жа Ольга Иванова; 10.0.0.1 and 152.143.123.131", "again ann@corp.example.com", None, "no data here"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r.text for r in pii.replace(d).collect()}
    for secret in ("ann@", "ANN@", "555-3949", "4111", "Keller", "Иванова", "152.143"):
        assert not any(secret in (t or "") for t in out.values())
    mail = out[2].split()[1]
    assert out[0].lower().count(mail) == 2 and out[3] is None and out[4] == texts[4]
    card = "".join(c for c in out[0].split(", ")[2] if c.isdigit())
    assert len(card) == 16 and pii.luhn([int(c) for c in card[:-1]]) == int(card[-1])
    assert out[1].startswith("Frau ") and any(n in out[1] for n in pii.GIVEN["cyrillic", "f"])


def test_surrogates_stay_distinct(spark):
    real = pii.surrogate
    d = spark.createDataFrame([(i, f"10.0.{i // 250}.{i % 250}") for i in range(300)], "doc_id int, text string")
    tried = pii.attempts(d.union(spark.createDataFrame([(999, real("ipv4", "10.0.0.1", pii.KEY))], "doc_id int, text string")))
    got = {r.entity: real(r.kind, r.entity, pii.KEY, r.attempt) for r in tried.collect()}
    assert len(set(got.values())) == len(got) and not set(got.values()) & set(got)


def test_pii_joined_equals_broadcast(spark):
    texts = [(i, f"u{i % 7}@mail.example.com and 192.168.1.{i}") for i in range(40)]
    d = spark.createDataFrame(texts, "doc_id int, text string")
    one = {(r.doc_id, r.text) for r in pii.replace(d).collect()}
    odd = pii.attempts(d).filter("attempt > 0")
    assert {(r.doc_id, r.text) for r in pii.replace_joined(d, pii.KEY, odd).collect()} == one


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1 and len({r.fingerprint for r in rows if r.doc_id in (3, 4)}) == 1
    ordered = sorted((x for x in ROWS if x[0] is not None), key=lambda x: -x[0]) + [x for x in ROWS if x[0] is None]
    text = [x[1] or "" for x in ordered]
    expected = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + text[(i + 1) % len(text)][: len(t) // 3]).encode()).hexdigest() for i, t in enumerate(text))
    assert sorted(r.edited_sha256 for r in rows) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprints(none).count() == 0


def test_peeling_retries_larger(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BASE", 2)
    a = "\n".join(f"line {i}" for i in range(60))
    b = "\n".join(f"line {i}" for i in range(20, 90))
    d = spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprints(d).collect()}
    assert got[2] == pytest.approx(40 / 90)


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own) + 1
        assert all(r.taken <= 3 * r["size"] for r in own)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(r.text.split()) for r in out.collect())
    assert abs(words - sum(r.taken for r in rows)) <= 3
    assert all(r["size"] == "x" for r in out.select("size").collect())


def test_secrets(docs, none):
    rows = secrets.spans(docs).collect()
    assert len(rows) == len(ROWS) and all(r.spans == "" for r in rows)
    assert secrets.spans(none).count() == 0


@pytest.mark.parametrize("wrap", ["plain", "base64", "twice", "gzip", "percent", "unicode", "entity"])
def test_secret_layers(wrap):
    import base64
    import gzip
    from urllib.parse import quote

    inner = 'api_key = "abc123DEF456ghi"'
    b64 = lambda b: base64.b64encode(b).decode()
    coded = {
        "plain": inner, "base64": b64(inner.encode()), "twice": b64(b64(inner.encode()).encode()), "gzip": b64(gzip.compress(inner.encode())),
        "percent": quote(inner), "unicode": "".join(f"\\u{ord(c):04x}" for c in inner), "entity": "".join(f"&#{ord(c)};" for c in inner),
    }[wrap]
    text = f"é {coded} end"
    base, every = secrets.find(text)
    assert (len(base) == 1) == (wrap == "plain")
    assert any(kind == "assign" and 2 <= a < b <= 2 + len(coded) for a, b, kind in every)


def test_secret_cycles_end():
    text = "%252525252525257A" * 50
    assert secrets.find(text) == ([], [])


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert rows[1] == rows[2] == 1 and rows[3] == rows[4] == 3 and rows[5] == 5 and rows[7] == 7
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 8]
    assert neardup.classes(none).count() == 0


def test_near_duplicates_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(base)
        for edits in (0, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(d).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.83:
                assert got[i] == got[j], (i, j, s)
            if s == 0:
                assert got[i] != got[j]


def test_hot_group_of_copies(spark):
    d = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, PROSE * 2).otherwise(F.concat(F.lit(PROSE), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha1(F.col("id").cast("string")))).alias("text"))
    got = neardup.classes(d.withColumnRenamed("id", "doc_id"))
    assert got.filter("doc_id % 3 = 0").select("class_id").distinct().count() == 1


PAGES = [(1, "http://a.com/en/x?q#f", "<p>a</p>"), (2, None, None), (3, "http://WWW.Example.com/en/", "<p>a</p>"), (4, "no scheme", ""), (5, "https://b.net/fr/1", "é" * 50_000), (5, "https://b.net/fr/1", "é" * 50_000), (6, "http://x.example.com:80", "<p>a</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "payload", "rule", "_sha", "verdict")})


def test_warc(spark, pages):
    rows = warc.round_trip(pages, shared_folder(spark)).collect()
    assert len(rows) == len(PAGES)
    by = {r.page_id: r for r in rows}
    assert (by[1].record_type, by[3].record_type, by[3].refers_to, by[6].refers_to) == ("response", "revisit", 1, 1)
    assert by[5].payload_bytes == 100_000 and by[3].payload_bytes == 8
    assert by[3].payload_digest == warc.base32_sha1(b"<p>a</p>") == by[1].payload_digest
    assert by[4].record_type == "revisit" and by[4].refers_to == 2
    empty = pages.limit(0)
    assert warc.round_trip(empty, shared_folder(spark)).count() == 0


def test_warc_pushdown_and_foreign_members(spark, tmp_path):
    import gzip

    warc.use(spark)
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n"
    with open(tmp_path / "x.warc.gz", "wb") as f:
        for i in range(20):
            body = bytes([65 + i]) * (i * 5000)
            f.write(gzip.compress(head % (b"response" if i % 2 else b"request", i, len(body)) + body + b"\r\n\r\n"))
    got = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'response'")
    assert "record_type" in got._jdf.queryExecution().toString()
    assert sorted((r.record_id, len(r.payload)) for r in got.collect()) == sorted((f"<urn:page:{i}>", i * 5000) for i in range(20) if i % 2)
    reader = warc.WarcReader(got.schema, {"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("record_type",), "request")])) == []
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 10


def test_language_id(docs, none):
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "und" and rows[3].score == 0
    assert rows[1].lang_pred == rows[2].lang_pred == "en"
    assert langid.identify(none).count() == 0
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.filter("lang_pred = 'x' and score = 'x'").count() == kept.count()


def test_language_id_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    d = spark.read.parquet(path)
    r = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality.judge(none).count() == 0
    assert quality.clean(none).count() == 0


def test_quality_lines(spark):
    good = "\n".join(" ".join(f"word{i}{chr(97 + k)}" for k in range(9)) + "." for i in range(12))
    menu = "\n".join(f"Home | News{i} | Sport{i} | Login{i} | Help{i} | More{i} | Shop{i}" for i in range(12))
    d = spark.createDataFrame([(1, good), (2, menu), (3, good + "\nHome | News | Sport | Login\nAll rights reserved.\nMenu")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.judge(d).collect()}
    assert kept == {1: True, 2: False, 3: True}
    assert {r.doc_id: r.text for r in quality.clean(d).collect()} == {1: good, 3: good}


def test_urls(spark, pages):
    rows = urls.judge(pages, urls.rule_table(spark, URL_RULES)).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(PAGES)
    assert (by[1].rule, by[1].verdict, by[1].path) == ("com/", "allow", "/en/x")
    assert (by[3].host, by[3].rule, by[3].verdict) == ("www.example.com", "www.example.com/en/", "allow")
    assert (by[5].rule, by[5].verdict) == ("net/fr/", "block")
    assert (by[2].host, by[2].rule, by[4].host, by[6].rule) == ("", None, "", None)
    salted = urls.judge(pages, urls.rule_table(spark, URL_RULES), max_broadcast_rules=0).collect()
    assert sorted(map(str, salted)) == sorted(map(str, rows))
    assert urls.judge(pages.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0
