"""Secret scans with a recursive decoding worklist.

Every text is scanned as it stands (the base spans). Then encoded stretches
are decoded layer by layer: percent escapes, Unicode escapes (`\\uXXXX`, surrogate pairs
joined, `\\xXX`, `&#N;`), base64 (in one line or wrapped, at every alignment of its
letters, so a token glued to a path is found), and gzip or zlib data (all members, and again
inside each other) inside base64, percent escapes or `\\xXX`. Of decoded bytes every
readable stretch is kept, so a control character or broken byte hides nothing else. Each new layer goes on a
worklist, is scanned with the same patterns and searched for further
encodings, until nothing new appears. A layer equal to one already seen (for
the same stretch) isn't queued again, so cycles end.

Each layer carries, for every character, the start and end of the stretch of
the text it came from; a secret found in a layer is reported with the stretch
of the original text that encodes it. Compressed data has no finer origin than
its whole token.

Compressed data is inflated as a stream, whole: it is scanned in pieces of about `PIECE_CHARS`
characters, cut where no token, escaped run, assignment or wrapped layer goes on; a piece grows
until there is such a place. The worklist holds one piece of each nesting level at a time, so memory
follows the depth of the nesting and the longest token or wrapped layer, not the inflated size.

Defined results: null texts are empty and have no spans; repeated rows are
scanned alike; an empty table gives an empty result; other columns are dropped. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of each kind, in the order the kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]+)+={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
SEPARATOR = re.compile("[+/_-]")
#: Compressed bytes, escaped: they start like gzip or zlib data.
PERCENT_BYTES = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%[0-9A-Fa-f]{2})(?:%[0-9A-Fa-f]{2}|[!-$&-~])*")
HEX_BYTES = re.compile(r"(?:\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\\x[0-9A-Fa-f]{2}|\^))(?:\\x[0-9A-Fa-f]{2}|\\[nrt0'\"\\]|[ -\[\]-~])*")
HEX_BYTE = re.compile(rb"\\(?:x([0-9A-Fa-f]{2})|([nrt0'\"\\]))")

#: Bytes that are UTF-8 without control characters.
READABLE = re.compile(rb"(?:[\t\n\x0b\x0c\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){6,}")
PIECE_CHARS = 1 << 22
READ_BYTES = 1 << 20

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """Base spans of one layer: leftmost, non-overlapping per kind; failing matches are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def readable(raw: bytes) -> str | None:
    """The bytes as text, if they are UTF-8 without control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def compressed(raw: bytes) -> int:
    """The window bits for zlib where `raw` starts like gzip or zlib data, else 0."""
    if raw[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0 else 0


def inflate(stream: Iterator[bytes], inner: bool = False) -> Iterator[bytes]:
    """The content of all members of a compressed stream, in pieces; what is broken ends it. What follows the members of an `inner` stream comes too, after a line break."""
    raw = next(stream, b"")
    while True:
        while len(raw) < 3 and (more := next(stream, b"")):
            raw += more
        if not (bits := compressed(raw)):
            if inner and raw:
                yield b"\n" + raw
                yield from stream
            return
        member = zlib.decompressobj(bits)
        try:
            while not member.eof:
                if not raw and not (raw := next(stream, b"")):
                    return
                yield member.decompress(raw, READ_BYTES)
                raw = member.unconsumed_tail
                while not member.eof and not raw and (more := member.decompress(b"", READ_BYTES)):
                    yield more
        except zlib.error:
            return
        raw = member.unused_data.lstrip(b"\0")


def taken(raw: bytes) -> int:
    """How many of the bytes belong to the compressed stream that they start with."""
    left = raw
    while bits := compressed(left):
        member = zlib.decompressobj(bits)
        try:
            data = left
            while not member.eof and (member.decompress(data, READ_BYTES) or data):
                data = member.unconsumed_tail
        except zlib.error:
            return len(raw)
        if not member.eof:
            return len(raw)
        left = member.unused_data.lstrip(b"\0")
    return len(raw) - len(left)


def unpacked(raw: bytes) -> Iterator[str]:
    """The text inside compressed layers, however many, in pieces; none if `raw` isn't compressed."""
    stream, seen = iter([raw]), set()
    while True:
        first = b""
        while len(first) < 1 << 16 and (more := next(stream, b"")):
            first += more
        stream = chain([first], stream)
        digest = hashlib.sha256(first).digest()
        if not compressed(first) or digest in seen:  # a stream that inflates to itself
            break
        stream = inflate(stream, bool(seen))
        seen.add(digest)
    if not seen or not first:
        return
    text, size, decoder = "", PIECE_CHARS, codecs.getincrementaldecoder("utf-8")("replace")
    for part in stream:
        text += decoder.decode(part)
        if len(text) >= size and (cut := last_break(text)):
            yield text[:cut]
            text, size = text[cut:], PIECE_CHARS
        elif len(text) >= size:
            size = 2 * len(text)  # a token, or a wrapped layer, that hasn't ended yet
    yield text + decoder.decode(b"", True)


def last_break(text: str) -> int:
    """The last place at which a text can be cut without parting a token, an escaped run, an assignment or a wrapped layer; 0 without one.

    Line breaks come first, but for those between lines that base64 may go on over; then control characters; then single spaces between words, where
    no backslash comes before in the line.
    """
    at, end = 0, len(text) - 1  # how the next line starts must be known
    wrapped = [m.span() for m in WRAPPED.finditer(text)]
    while not at and (end := text.rfind("\n", 0, end)) >= 0:
        while wrapped and wrapped[-1][0] > end:
            wrapped.pop()
        if wrapped and end < wrapped[-1][1]:
            end = wrapped[-1][0]
        else:
            at = end + 1
    if at:
        return at
    for m in CONTROL.finditer(text):
        at = m.end()
    line = text.rfind("\n") + 1
    if not at and "\\" not in text[line:]:
        for m in WORDS_APART.finditer(text, line):
            at = m.start() + 1
    return at


#: Control characters, and a space that no assignment goes over.
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
WORDS_APART = re.compile(r"(?<=[A-Za-z.,;!?]) (?=[A-Za-z])")


class Layer:
    """A decoded text; `start[i]` and `end[i]` are the original stretch of its character i."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end

    def stretch(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])

    @staticmethod
    def at(text: str, a: int, b: int) -> Layer:
        """A text that comes from one stretch as a whole."""
        return Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))


def rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of `pattern` decoded in place, neighbours kept."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None:
            continue
        parts += [layer.text[at : m.start()], new]
        a, b = layer.stretch(m.start(), m.end())
        starts += [layer.start[at : m.start()], np.full(len(new), a)]
        ends += [layer.end[at : m.start()], np.full(len(new), b)]
        at = m.end()
    if not parts:
        return None
    parts.append(layer.text[at:])
    return Layer("".join(parts), np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))


def unpercent(layer: Layer) -> Layer | None:
    """Percent escapes decoded, one escaped byte (or UTF-8 character) at a time."""
    text = layer.text
    if "%" not in text:
        return None
    parts, starts, ends, at = [], [], [], 0
    for m in PERCENT.finditer(text):
        raw = binascii.unhexlify(m[0].replace("%", ""))
        new = readable(raw)
        if new is not None:
            widths = np.array([3 * len(c.encode()) for c in new])
        else:  # bytes that are no text stay escaped
            chars, sizes, byte = [], [], 0
            for c in raw.decode(errors="surrogateescape"):
                n = len(c.encode(errors="surrogateescape"))
                if 0xDC80 <= ord(c) <= 0xDCFF or not readable(c.encode()):
                    chars.append(m[0][3 * byte : 3 * byte + 3])
                    sizes += [1, 1, 1]
                else:
                    chars.append(c)
                    sizes.append(3 * n)
                byte += n
            new, widths = "".join(chars), np.array(sizes)
        edges = m.start() + np.concatenate([[0], np.cumsum(widths)])
        parts += [text[at : m.start()], new]
        starts += [layer.start[at : m.start()], layer.start[edges[:-1]]]
        ends += [layer.end[at : m.start()], layer.end[edges[1:] - 1]]
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    return Layer("".join(parts), np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))


def unescape(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None

    def decode(m: re.Match) -> str | None:
        if m[1]:
            return chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
        code = int(m[3] or m[4] or m[6] or "0", 16) if not m[5] else int(m[5])
        ok = 32 <= code < 0x110000 and not 0xD800 <= code < 0xE000 or code in (9, 10, 13)
        return chr(code) if ok else None

    return rewritten(layer, ESCAPE, decode)


def unbytes(layer: Layer) -> Iterator[Layer]:
    """A layer for each stretch of escaped bytes that is compressed."""

    def percent(found: str) -> bytes:
        return unquote_to_bytes(found)

    def escapes(found: str) -> bytes:
        named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0"}
        return HEX_BYTE.sub(lambda m: binascii.unhexlify(m[1]) if m[1] else named.get(m[2], m[2]), found.encode())

    for sign, pattern, decode in (("%", PERCENT_BYTES, percent), ("\\x", HEX_BYTES, escapes)):
        if sign not in layer.text:
            continue
        for m in pattern.finditer(layer.text):
            for text in unpacked(decode(m[0])):
                yield Layer.at(text, *layer.stretch(m.start(), m.end()))


def wrapped(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """(letters, their places, end) of base64 that goes on over line breaks: lines of one width, and a shorter last one."""
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in PIECE.finditer(text, m.start(), m.end())]
        i = 0
        while i + 1 < len(lines):
            width, j = lines[i + 1][1] - lines[i + 1][0], i + 2
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            ends = {j}  # the last line may also be a word that follows
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                ends.add(j + 1)
            if j - 1 > i + 1:
                ends.add(j - 1)
            for k in sorted(ends):
                places = np.concatenate([np.arange(a, b) for a, b in lines[i:k]])
                yield "".join(text[a:b] for a, b in lines[i:k]), places, m.end() if k == len(lines) else lines[k - 1][1]
            i = max(ends)


def unbase64(layer: Layer) -> Iterator[Layer]:
    """A layer for each readable stretch that base64 letters hold, and each compressed text."""
    for m in BASE64.finditer(layer.text):
        yield from decoded(layer, m[0].rstrip("="), None, m.start(), m.end())
    if "\n" in layer.text:
        for body, places, end in wrapped(layer.text):
            yield from decoded(layer, body, places, int(places[0]), end)


def decoded(layer: Layer, body: str, places: np.ndarray | None, start: int, end: int) -> Iterator[Layer]:
    """The content of base64 letters, which lie at `places` (from `start` on if None), read from each of four alignments."""
    breaks = [0, *(m.end() for m in SEPARATOR.finditer(body))]  # where a token of its own may start
    letters = body.replace("-", "+").replace("_", "/")
    at = lambda i: start + i if places is None else int(places[i])
    for shift in range(min(4, len(letters) - 3)):
        n = len(letters) - shift
        n -= n % 4 == 1  # one letter more than whole bytes
        raw = binascii.a2b_base64(letters[shift : shift + n] + "=" * (-n % 4))
        for p in breaks:
            byte = (p - shift) // 4 * 3
            if p >= shift and (p - shift) % 4 == 0 and compressed(raw[byte : byte + 3]):
                last = shift + ((byte + taken(raw[byte:])) * 8 - 1) // 6
                till = layer.end[end - 1] if last >= len(letters) - 1 else layer.end[at(last)]
                for text in unpacked(raw[byte:]):
                    yield Layer.at(text, int(layer.start[at(p)]), int(till))
        for m in READABLE.finditer(raw):
            text = m[0].decode(errors="replace")
            if len(text) == len(m[0]):
                byte = np.arange(m.start(), m.end() + 1)
            else:
                byte = m.start() + np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
            # a character comes from the letters that hold its bits
            first, last = shift + byte[:-1] * 8 // 6, np.minimum(shift + (byte[1:] * 8 - 1) // 6, len(letters) - 1)
            if places is None:
                yield Layer(text, layer.start[start + first], layer.end[start + last])
            else:
                yield Layer(text, layer.start[places[first]], layer.end[places[last]])


def derived(layer: Layer) -> Iterator[Layer]:
    """The layers one decoding below."""
    yield from (x for x in (unpercent(layer), unescape(layer)) if x is not None)
    yield from unbase64(layer)
    yield from unbytes(layer)


def decoded_spans(text: str) -> set[Span]:
    """Spans of secrets in decoded layers, mapped to the text."""
    found: set[Span] = set()
    if not ("%" in text or "\\" in text or "&#" in text or BASE64.search(text)):
        return found
    n = len(text)
    seen = {(0, n, hashlib.sha256(text.encode(errors="surrogatepass")).digest())}
    work = [derived(Layer(text, np.arange(n), np.arange(1, n + 1)))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        key = (int(new.start[0]), int(new.end[-1]), hashlib.sha256(new.text.encode(errors="surrogatepass")).digest())
        if key not in seen:
            seen.add(key)
            found |= {(*new.stretch(a, b), kind) for a, b, kind in scan(new.text)}
            work.append(derived(new))
    return found


def order(span: Span) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, each by start and kind."""
    text = text or ""
    base = sorted(scan(text), key=order)
    more = decoded_spans(text)
    return base, sorted({*base, *more}, key=order) if more else base


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_spans and spans (strings) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [find(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    **{f"n_{k}": [sum(s[2] == k for s in base) for base, _ in pairs] for k in KINDS},
                    "base_spans": [joined(base) for base, _ in pairs],
                    "spans": [joined(every) for _, every in pairs],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def digests(docs: DataFrame) -> DataFrame:
    """The spans with the base ones as a SHA-256."""
    return spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")

