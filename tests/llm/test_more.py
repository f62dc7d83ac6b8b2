"""Language ID, quality, WARC, URL and mixing against plain Python; long texts, nulls and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import langid, mixing, packing, pii, quality, secrets, urls, warc
from termloom.llm.common import shared_folder
from termloom.llm.queries import URL_RULES, tokenizer_path

SAMPLES = {
    "en": "the cat sat on the mat while the rain fell on the roof of the house and nobody said a word about it",
    "fr": "le chat dort sur la chaise rouge pendant que la pluie tombe doucement sur le toit de la maison",
    "de": "der Hund schläft unter dem Tisch und träumt von einem langen Spaziergang durch den Wald",
    "ru": "кошка спит на красном стуле пока дождь тихо падает на крышу дома",
}


def naive_vector(profiler, text):
    """A text's unit vector letter by letter, and None without a letter."""
    letters = re.sub(" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " ")
    if not letters.strip():
        return None
    codes = [ord(c) for c in letters]
    total = np.zeros(profiler.dim)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += np.roll(profiler.letter(a), 2).astype(int) * np.roll(profiler.letter(b), 1) * profiler.letter(c)
    return total / max(np.linalg.norm(total), 1e-9)


def test_language_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        lang = rng.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) + rng.choice(["", " 12!", "\n\n ..."]), lang if i % 5 else None))
    rows += [(80, None, "en"), (81, "12 34", "en"), (82, "ÀÉ ＡＢ 中文字", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    import zlib

    profiler, sums = langid.Profiler(), {}
    for i, text, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if text and lang and not got[i].held_out and (v := naive_vector(profiler, text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    protos = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for i, text, _ in rows:
        v = naive_vector(profiler, text or "")
        if v is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        like = protos @ v
        assert got[i].score == pytest.approx(min(1, max(0, like.max())), abs=1e-4)
        assert like[names.index(got[i].lang_pred)] == pytest.approx(like.max(), abs=1e-4)


def test_language_pieces_join_without_seams(monkeypatch):
    text = "Ein  langer Text, mit   vielen Leerzeichen 123 und 中文 𐐀𐐁 Ende   " * 7
    whole = langid.Profiler().counts(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "CHUNK", size)
        k, n, lettered = langid.Profiler().counts(text)
        assert lettered and dict(zip(k.tolist(), np.array(n).astype(int).tolist())) == dict(zip(whole[0].tolist(), whole[1].tolist()))


def repeated(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1})


def test_repeated_words_of_texts_of_all_lengths(spark):
    rng = random.Random(8)
    rows = [(n, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n))) for n in (0, 1, 2, 3, 4, 7, 8, 9, 63, 64, 65, 1000, 3000)]
    rows += [(5000, "same word " * 2000), (5001, " ".join(str(i) for i in range(120_000)) + " 5 6 7")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (got[i].n_words, got[i].n_repeat_words) == (len(words), repeated(words))


def test_warc_files_are_split(spark, tmp_path):
    import gzip

    rng = random.Random(3)
    own = spark.createDataFrame([(i, f"http://a/{i}", rng.randbytes(rng.randrange(4000)).hex()) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.use(spark)
    folder = str(tmp_path / "own")
    warc.archive_records(own, shared_folder(spark)).write.format("warc").mode("append").save(folder)
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    with open(foreign / "x.warc.gz", "wb") as f:
        for i in range(200):
            body = rng.randbytes(rng.randrange(3000))
            f.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body + b"\r\n\r\n"))
    for path in (folder, str(foreign)):
        whole = spark.read.format("warc").load(path).select("record_id", F.sha1("payload")).collect()
        for split in (700, 5000, 50_000):
            parts = spark.read.format("warc").option("split_bytes", split).load(path).select("record_id", F.sha1("payload"))
            assert sorted(map(str, parts.collect())) == sorted(map(str, whole)) and len(whole) == 200
    assert spark.read.format("warc").option("split_bytes", 5000).load(folder).rdd.getNumPartitions() > 20


def test_warc_marks_too_many_to_broadcast(spark):
    rows = [(i, "u", "same" if i % 3 == 0 else f"pair {i // 6}") for i in range(120)] + [(None, "u", "same"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = warc.archive_records(pages, shared_folder(spark)).collect()
    assert sorted(map(str, warc.archive_records(pages, shared_folder(spark), max_broadcast=0).collect())) == sorted(map(str, few))
    none = warc.round_trip(pages.limit(0), shared_folder(spark))
    assert none.count() == 0 and none.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_many_rules_and_a_hot_prefix(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_HOT", 20)
    rules = [*URL_RULES, *[("block", f"h{i}.org", "/") for i in range(300)], ("block", "h7.org", "/deep/")]
    pages = [(i, f"http://x.h{i % 400}.org/deep/{i}") for i in range(300)] + [(1000 + i, "https://www.example.com/en/a") for i in range(200)] + [(None, None)] * 2
    d = spark.createDataFrame(pages, "page_id long, url string")
    table = urls.rule_table(spark, rules)
    one = urls.judge(d, table).collect()
    many = urls.judge(d, table, max_broadcast_rules=0).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == len(pages)
    assert {r.rule for r in one if r.page_id == 7} == {"h7.org/deep/"}


def test_ranges_of_the_mix_follow_the_rows(spark, monkeypatch):
    assert mixing.range_digits(0) == 3 and mixing.range_digits(200_000 * 4096) == 3 and mixing.range_digits(200_000 * 4096 + 1) == 4
    d = spark.createDataFrame([(i, "a b c", "s") for i in range(500)] + [(1000, "d " * 40_000, "t")], "doc_id long, text string, source string")
    one = sorted(map(str, mixing.mix(d).collect()))
    monkeypatch.setattr(mixing, "ROWS_IN_RANGE", 0.001)
    assert sorted(map(str, mixing.mix(d).collect())) == one


def test_empty_tables_keep_their_schema(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert packing.pack(none, tokenizer_path()).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pii.replace(none).columns == [*none.columns, "pii_spans"]
    assert secrets.spans(none).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"]
    assert langid.identify(none).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert langid.accepted(none).columns == none.columns
    assert mixing.mixed_documents(none).columns == none.columns
    assert [f.name for f in quality.judge(none).schema][0] == "doc_id"


def test_session_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    d = spark.createDataFrame([(1, "some text here", "en", "s")], "doc_id long, text string, lang string, source string")
    packing.pack(d, tokenizer_path()).count()
    pii.replace(d).count()
    langid.accepted(d).count()
    assert spark.conf.get(name) == before
