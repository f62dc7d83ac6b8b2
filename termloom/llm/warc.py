"""A WARC data source for Spark: reader with pushed-down header predicates, and writer.

Files are `.warc.gz`, one gzip member per record. The writer notes each
member's compressed size in the gzip header's extra field (`SL`), so a reader
can step over a member without inflating it; members without the note (files
of other tools) are inflated and thrown away.

Reader: the driver lists the committed files and plans partitions of about
`split_bytes`; a larger file is split into ranges of bytes, and a task reads the members that
start in its range (it looks for the first gzip header that inflates to a record). Equality, `IN` and null predicates on `record_type` and the
header columns are pushed down. In a task a record's headers are inflated and
parsed first; the rest of the member is inflated only if the record passes and
the `payload` column is in the schema asked for.

Writer: every task writes files of its own, rolled at `file_bytes`; on commit the
driver writes a manifest that names the committed ones, so files of failed or
repeated attempts are never read. Paths of any file system that pyarrow knows work.

Columns: record_type, record_id, target_uri, date, payload_digest,
payload_bytes, refers_to, payload (binary; null for a revisit).

Defined results: null html is the empty payload; a null URL is an empty target; a null
page_id is no response's id if another page has the payload, and stays null; rows that repeat a
response's page_id are responses too; repeated rows give one record each; an empty table gives no
records; other columns of the pages are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialise, shared_folder

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
MANIFEST = "_committed-"
PEEK = 1 << 14
MAX_BROADCAST, MAX_HOT = 500_000, 10_000


def store(path: str):
    """(file system, path below it)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(record: dict, level: int = 6) -> bytes:
    """One record as one gzip member whose extra field tells its size."""
    payload = record.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if (value := record.get(column)) is not None:
            lines.append(f"{header}: {clean(str(value))}")
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    raw = "\r\n".join(lines).encode() + payload + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, size, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def member_size(head: bytes) -> int | None:
    """The size of the member that starts with `head`, if its extra field has it."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"SL" and size >= 4 and at + 8 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def parse_headers(raw: bytes) -> dict:
    """Lower-cased header names to values."""
    found = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def columns_of(headers: dict) -> dict:
    found = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    length = found["payload_bytes"] if found["payload_bytes"] is not None else headers.get("content-length")
    found["payload_bytes"] = int(length) if length is not None else None
    digest = found["payload_digest"]
    if digest and digest.lower().startswith("sha1:"):
        found["payload_digest"] = digest[5:]
    return found


def next_record(stream, start: int) -> int | None:
    """Where the first record at or after `start` begins; None if there is none."""
    at, buffer = start, b""
    while True:
        stream.seek(at)
        buffer = stream.read(1 << 20)
        found = buffer.find(b"\x1f\x8b\x08")
        while found >= 0:
            stream.seek(at + found)
            try:
                if zlib.decompressobj(31).decompress(stream.read(1 << 12), 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
            found = buffer.find(b"\x1f\x8b\x08", found + 1)
        if len(buffer) < 1 << 20:
            return None
        at += len(buffer) - 2


def records(stream, wanted, payloads: bool, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """The records of one file that start from `start` up to `end` and that `wanted` accepts, by their headers alone."""
    buffer = b""
    if start and (start := next_record(stream, start)) is None:
        return
    stream.seek(start)

    def fill(least: int) -> None:
        nonlocal buffer
        while len(buffer) < least and (more := stream.read(max(1 << 20, least - len(buffer)))):
            buffer += more

    while end is None or stream.tell() - len(buffer) < end:
        fill(24)
        if not buffer:
            return
        size = member_size(buffer)
        if size:
            fill(min(size, PEEK))
        else:
            fill(PEEK)
        unpack, head = zlib.decompressobj(31), b""
        source = buffer[:size] if size else buffer
        while b"\r\n\r\n" not in head and not unpack.eof:
            head += unpack.decompress(source, PEEK)
            source = unpack.unconsumed_tail
            if not source and not unpack.eof:
                before = len(buffer)
                fill(before + (1 << 20))
                source = buffer[before:size] if size else buffer[before:]
                if not source:
                    break
        raw, _, body = head.partition(b"\r\n\r\n")
        headers = parse_headers(raw)
        found = columns_of(headers)
        take = wanted(found)
        if take and payloads or not size:
            while not unpack.eof:
                if take:
                    body += unpack.decompress(source)
                else:
                    unpack.decompress(source)
                source = b""
                if not unpack.eof:
                    before = len(buffer)
                    fill(before + (1 << 20))
                    source = buffer[before:]
                    if not source:
                        raise ValueError("a record is cut off")
        if take:
            revisit = found["record_type"] == "revisit"
            found["payload"] = None if revisit or not payloads else body[: int(headers.get("content-length", 0))]
            yield found
        if size:
            if size <= len(buffer):
                buffer = buffer[size:]
            else:
                stream.seek(stream.tell() + size - len(buffer))
                buffer = b""
        else:
            buffer = unpack.unused_data


class Files(InputPartition):
    """Files, each with the range of bytes to read."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


class Done(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.split = options["path"], int(options.get("split_bytes", 64 << 20))
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, frozenset([f.value])))
            elif isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            elif isinstance(f, IsNull):
                self.tests.append((column, frozenset([None])))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, root = store(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        manifests = [x.path for x in found if x.base_name.startswith(MANIFEST)]
        if manifests:
            named = {n for m in manifests for n in json.loads(files.open_input_stream(m).read())}
        else:
            named = {x.base_name for x in found if x.base_name.endswith(".warc.gz")}
        group, size, out = [], 0, []
        for x in sorted(found, key=lambda x: x.base_name):
            if x.base_name not in named:
                continue
            if group and size + x.size > self.split:
                out.append(Files(group))
                group, size = [], 0
            if x.size > self.split:
                out += [Files([(x.base_name, a, min(a + self.split, x.size))]) for a in range(0, x.size, self.split)]
                continue
            group.append((x.base_name, 0, x.size))
            size += x.size
        return out + [Files(group)] if group else out or [Files([])]

    def read(self, partition: Files):
        files, root = store(self.path)
        wanted = lambda r: all(r[c] in values for c, values in self.tests)
        for name, start, end in partition.parts:
            with files.open_input_file(f"{root}/{name}") as stream:
                for r in records(stream, wanted, "payload" in self.names, start, end):
                    yield tuple(r[n] for n in self.names)


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        self.size = int(options.get("file_bytes", 128 << 20))

    def write(self, rows) -> Done:
        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for row in rows:
            data = member(dict(zip(self.names, row, strict=True)))
            if out is None or size + len(data) > self.size:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Done(names)

    def commit(self, messages) -> None:
        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with files.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages) -> None:
        files, root = store(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                files.delete_file(f"{root}/{n}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, dict(self.options))


def use(spark: SparkSession) -> None:
    """Register the source, and switch on filter pushdown for Python sources in this session: pushdown happens when a later plan is made."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 8 letters for each 10 hex digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    block = lambda k: F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 10).cast("long")
    parts = [F.substr(letters, (F.shiftright(block(k), 35 - 5 * i) % 32 + 1).cast("int"), F.lit(1)) for k in range(4) for i in range(8)]
    return F.concat(*parts)


def archive_records(pages: DataFrame, folder: str, min_bytes: int = 0, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """A record per page: of equal payloads of `min_bytes` and more, the smallest page_id is the response, others revisit it.

    The first page of a payload comes from a map-side minimum over digests. Payloads
    that occur once need no mark; the marks of the others are broadcast while their counted rows are few.
    Beyond the bound only those of the hot payloads are, at most `MAX_HOT`, and the other pages are joined by digest.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumn("_sha", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32(F.col("_sha")))
    keys = pages.select("page_id", payload.alias("payload")).filter(F.octet_length("payload") >= min_bytes)
    first = keys.groupBy(F.sha1("payload").alias("_sha")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    first = materialise(first, folder, "firsts")
    if first.limit(max_broadcast + 1).count() <= max_broadcast:
        r = p.join(F.broadcast(first), "_sha", "left")
    else:
        total = first.agg(F.sum("_n")).first()[0]
        hot = F.broadcast(first.filter(F.col("_n") > total / MAX_HOT))
        rest = first.filter(F.col("_n") <= total / MAX_HOT)
        r = p.join(hot, "_sha").unionByName(p.join(hot, "_sha", "left_anti").join(rest, "_sha", "left"))
    again = F.coalesce((F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    return r.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), F.col("payload_digest")).alias("payload_digest"),
        "payload_bytes",
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archive the pages in `folder` and read them back: responses with their payloads, revisits by headers alone."""
    spark = pages.sparkSession
    use(spark)
    archive_records(pages, shared_folder(spark), min_bytes).write.format("warc").mode("append").save(folder)
    whole = spark.read.format("warc").load(folder).filter(F.col("record_type") == "response")
    whole = whole.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")
    names = ", ".join(x for x in SCHEMA.split(", ") if not x.startswith("payload binary"))
    bare = spark.read.format("warc").schema(names).load(folder).filter(F.col("record_type") == "revisit")
    bare = bare.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    both = whole.unionByName(bare)
    return both.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))

