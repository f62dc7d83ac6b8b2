"""The secret scan against a naive recursive decoder."""

import base64
import gzip
import random
import re
import zlib
from urllib.parse import quote, unquote_to_bytes

import pytest

from termloom.llm import secrets

b64 = lambda b: base64.b64encode(b).decode()
WRAPS = {
    "base64": b64,
    "url-safe": lambda b: base64.urlsafe_b64encode(b).decode(),
    "path": lambda b: "/v1/" + b64(b).rstrip("="),
    "slug": lambda b: "x-" + base64.urlsafe_b64encode(b).decode().rstrip("="),
    "wrapped": lambda b: base64.encodebytes(b).decode(),
    "gzip": lambda b: b64(gzip.compress(b)),
    "zlib twice": lambda b: b64(zlib.compress(zlib.compress(b))),
    "gzip in a path": lambda b: "a_b/" + b64(gzip.compress(b)).rstrip("="),
    "percent": lambda b: "".join(f"%{c:02X}" for c in b),
    "quoted": lambda b: quote(b),
    "unicode": lambda b: "".join(f"\\u{ord(c):04x}" if c < "\U00010000" else "\\u%04x\\u%04x" % (0xD800 + (ord(c) - 0x10000 >> 10), 0xDC00 + (ord(c) - 0x10000 & 1023)) for c in b.decode()),
    "entity": lambda b: "".join(f"&#{ord(c)};" for c in b.decode()),
    "broken bytes": lambda b: b64(b"\xff\x00\x01" + b + b"\x00\xfe"),
}


def naive(text, depth=8, seen=None):
    """Kinds of secrets in a text, by decoding whatever the standard library can, over and over."""
    seen = set() if seen is None else seen
    if depth < 0 or text in seen:
        return set()
    seen.add(text)
    kinds = {k for _, _, k in secrets.scan(text)}
    nexts = [unquote_to_bytes(text).decode(errors="replace"), re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), text)]
    for run in [*re.findall(r"[A-Za-z0-9+/_-]{16,}", text), *re.findall(r"[A-Za-z0-9+/_-]{16,}", text.replace("\n", ""))]:
        starts = {0, *(m.end() for m in re.finditer(r"[/_-]", run))}
        for at in starts:
            body = run[at:].replace("-", "+").replace("_", "/")
            body = body[: len(body) - (len(body) % 4 == 1)]
            try:
                raw = base64.b64decode(body + "=" * (-len(body) % 4))
            except ValueError:
                continue
            for _ in range(3):
                try:
                    raw = zlib.decompressobj(47).decompress(raw)
                except zlib.error:
                    break
            nexts.append(raw.decode(errors="replace"))
    for n in nexts:
        kinds |= naive(n, depth - 1, seen)
    return kinds


SECRETS = {"assign": 'password = "Hunter2Hunter2"', "access": "AKIA" + "A1B2C3D4E5F6G7H8", "hex": "0123456789abcdef" * 2}


@pytest.mark.parametrize("seed", range(60))
def test_generated_nestings(seed):
    rng = random.Random(seed)
    kind = rng.choice(list(SECRETS))
    inner = f"some {SECRETS[kind]} text ☃ 😀 with more of it"
    names = [rng.choice(list(WRAPS)) for _ in range(rng.randrange(1, 4))]
    coded = inner
    for name in names:
        coded = WRAPS[name](coded.encode())
    text = f"é see {coded}\n and on"
    base, every = secrets.find(text)
    start, end = text.index(coded), text.index(coded) + len(coded)
    kinds = {k for _, _, k in every}
    assert kind in kinds, names
    assert naive(text) <= kinds
    assert all(start <= a < b <= end for a, b, k in every if k == kind), names
    assert set(base) <= set(every)


def test_clean_texts_have_no_spans():
    rng = random.Random(2)
    words = "the quick brown fox internationalization/of-some_very-long+words electroencephalographically".split()
    for _ in range(200):
        assert secrets.find(" ".join(rng.choice(words) for _ in range(50))) == ([], [])
        assert secrets.find(b64(rng.randbytes(300)))[1] == []


def test_long_streams_are_scanned_to_the_end(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE_CHARS", 5000)
    for filler in ("ab ☃ " * 30_000, "line of text ☃\n" * 10_000):
        for at in (0, 4990, 4999, 77_777, len(filler)):
            inner = filler[:at] + " password=Hunter2Hunter2 " + filler[at:]
            for coded in (b64(gzip.compress(inner.encode())), b64(gzip.compress(zlib.compress(inner.encode())))):
                assert [k for _, _, k in secrets.find(f"x {coded}")[1]] == ["assign"]


@pytest.mark.parametrize("filler", ["line of text\n", "word\n", "several words here "])
def test_layers_across_the_ends_of_pieces(monkeypatch, filler):
    """Wrapped base64, tokens longer than a piece and escapes at every place round the end of a piece."""
    monkeypatch.setattr(secrets, "PIECE_CHARS", 400)
    secret = b"filler " * 20 + b"password=Hunter2Hunter2"
    for inner in ("\n" + base64.encodebytes(secret).decode(), " " + b64(b"filler " * 200 + secret) + "\n", "\n" + "".join(f"%{c:02x}" for c in secret) + "\n"):
        for at in range(0, 460, 7):
            text = (filler * 60)[:at] + inner + filler * 40
            assert [k for _, _, k in secrets.find(b64(gzip.compress(text.encode())))[1]] == ["assign"], (at, inner[:9])


def test_text_behind_inner_members():
    inner = gzip.compress(b"an inner member") + b"and then token: abcdefghi"
    assert [k for _, _, k in secrets.find("x " + b64(gzip.compress(inner)))[1]] == ["assign"]


def test_a_stream_far_larger_than_a_piece():
    raw = gzip.compress(b"a b\n" * (10 << 20) + b"token: abcdefghi")
    text = "see " + b64(raw)
    assert secrets.find(text)[1] == [(4, len(text), "assign")]


def test_ties_and_repeats(spark):
    both = "token=abcdef0123456789abcdef0123456789"
    rows = [(1, both), (1, both), (2, None), (3, ""), (None, both), (4, "x" * 100_000 + " " + both)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.spans(d).collect()
    assert len(got) == len(rows)
    one = [r for r in got if r.doc_id in (1, None)]
    assert {r.spans for r in one} == {f"assign:0:{len(both)},hex:6:{len(both)}"} and len(one) == 3
    assert [r.spans for r in got if r.doc_id == 4] == [f"assign:100001:{100_001 + len(both)},hex:100007:{100_001 + len(both)}"]
    assert secrets.digests(d.limit(0)).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
