"""Cases in which an operator once did less than the whole job."""

import base64
import gzip
import random
import zlib
from urllib.parse import quote

import pytest

from termloom.llm import neardup, pii, secrets


def test_short_formats_do_not_run_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    two = [f"{letters[i % 26]}{letters[i // 26 % 26]}@firm{i}.com" for i in range(1000)]
    lone = [f"{title} {name}" for title in ("Mr.", "Dr.") for name in pii.GIVEN["latin", "m"]]
    lone += [f"Г-жа {name}" for name in pii.GIVEN["cyrillic", "f"]]
    texts = [*two, *lone, *[f"{c}@x.firm.com" for c in letters], *[f"call +1 {i:02d} 77" for i in range(100)]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    out = {r.doc_id: r.text for r in pii.replace(d).collect()}
    new = [out[i] for i in range(len(texts))]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert all(t.split("@")[1].count(".") == 1 and len(t.split("@")[0]) == 2 for t in new[:1000])
    assert all(t.split("@")[1].endswith((".example", "example.com")) for t in new[:1000])


@pytest.mark.parametrize(("kind", "entity"), [("email", "me@a.com"), ("email", "x@y.co.uk"), ("person", "m|James"), ("person", "n|Анна"), ("phone", "12233")])
def test_later_attempts_have_more_surrogates(kind, entity):
    spaces = [len({pii.surrogate(kind, f"{entity[:2]}{entity[2:]}", f"key {i}", a) for i in range(3000)}) for a in (0, 12)]
    assert spaces[1] > 2900 and spaces[1] >= spaces[0]


def test_longer_numbers_keep_every_digit():
    new = pii.surrogate("phone", "12233", pii.KEY, 12)
    assert pii.in_format("phone", "+1 22 33", new) == f"+{new[0]} {new[1:3]} {new[3:]}"


def test_documents_without_id_are_kept_apart(spark):
    def text(seed, edit=None):
        words = [f"{seed}{i * i % 97}" for i in range(120)]
        return " ".join(words if edit is None else [*words[:60], edit, *words[61:]])

    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (None, text("c", "edit")), (None, text("d", "edit")), (7, text("d")), (9, text("e")), (9, text("e")), (None, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(d).collect()]
    by = {t[0] if t else "": [k for k in kept if (k[1] or "")[:1] == (t[0] if t else "")] for _, t in rows}
    assert {k: len(v) for k, v in by.items()} == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "": 1}
    assert by["d"] == [(7, text("d"))]
    found = neardup.classes(d).collect()
    assert len(found) == len(rows) and sorted(r.class_id for r in found if r.class_id is not None) == [7, 7, 9, 9]


def test_texts_of_one_id_are_one_class(spark):
    rows = [(3, "x"), (5, "x"), (5, "quite another text"), (8, "quite another text")]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {3}


SECRET = "first line\n" + "password = Hunter2Hunter2\n" + "x" * 40


def spans_of(text):
    return {kind for _, _, kind in secrets.find(text)[1]}


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(gzip.compress(gzip.compress(zlib.compress(s)))).decode(),
        lambda s: base64.b64encode(gzip.compress(b"a first member") + gzip.compress(s)).decode(),
        lambda s: base64.encodebytes(s * 3).decode(),
        lambda s: "key: " + base64.encodebytes(gzip.compress(s + random.Random(1).randbytes(300).hex().encode())).decode() + "and on",
        lambda s: base64.b64encode(gzip.compress(s + b"\xff\x00")).decode(),
        lambda s: "".join(f"%{c:02x}" for c in b"\xff" + s + b"\x01"),
        lambda s: quote(gzip.compress(s)),
        lambda s: repr(zlib.compress(s))[2:-1],
    ],
)
def test_secret_layers_to_a_fixpoint(wrap):
    text = wrap(SECRET.encode())
    assert "assign" in spans_of(f"see {text}\nend") and not secrets.find(text)[0]


def test_wrapped_base64_keeps_places():
    secret = "filler " * 7 + "password=Hunter2Hunter2Hunter2"
    text = "a\n" + base64.encodebytes(secret.encode()).decode() + "b c\n"
    found = [(a, b) for a, b, kind in secrets.find(text)[1] if kind == "assign"]
    start = 2 + len("filler " * 7) * 8 // 6
    assert any(a == start and "\n" in text[a:b] and b <= len(text) - 4 for a, b in found)
