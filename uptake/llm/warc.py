"""Web archives: one Zstandard frame per WARC record, behind a frame that holds the dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary all its records
are compressed with; the dictionary may be compressed itself. Then every record is one frame of its
own, so a reader can start at any record and one damaged record leaves the others readable.

Writing: each task writes its partition to archives of bounded size, whose dictionaries it trains on their first
records. Archives are written under a name of their own attempt and moved to their place only if a
finished task has reported them; what a lost task leaves behind is never read. Of equal payloads one is
written as a response, the others as revisits that refer to it.

Reading: a task streams an archive frame by frame and holds one record at a time. Version, mandatory
headers, lengths, line ends and digests are checked.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uptake.llm.chunks import written

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_MAGIC, FRAME_MAGIC = 0xEC30A437, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())

ARCHIVE_BYTES = 64 << 20
_DICTIONARY_BYTES = 32 << 10
_SAMPLE_BYTES = 1 << 20
_SAMPLE_ROWS = 256
_READ = 1 << 20
SUFFIX = ".warc.zst"


class ArchiveError(ValueError):
    """An archive or a record that breaks its format."""


# ---- records ----------------------------------------------------------------------------------

def record(headers, block: bytes) -> bytes:
    """A record as bytes: version, headers (name, value), block."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes):
    """(headers, block) of one record; header names in lower case. Raises ArchiveError."""
    head, ended, rest = data.partition(b"\r\n\r\n")
    if not ended:
        raise ArchiveError("the record's headers do not end")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError(f"unknown version {lines[0][:20]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"no header: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [name for name in MANDATORY if name not in headers]
    if missing:
        raise ArchiveError(f"missing headers: {', '.join(missing)}")
    if headers["warc-type"] not in TYPES:
        raise ArchiveError(f"unknown type {headers['warc-type'][:20]!r}")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise ArchiveError(f"Content-Length is {headers['content-length'][:20]!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4:
        raise ArchiveError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    if rest[length:] != b"\r\n\r\n":
        raise ArchiveError("the record does not end with two line ends")
    block = rest[:length]
    _check_digest(headers.get("warc-block-digest"), block, "block")
    return headers, block


def _check_digest(named, data, what):
    """Compare with a digest header; kinds other than hexadecimal SHA-256 are not judged."""
    if named and named.lower().startswith("sha256:"):
        found = hashlib.sha256(data).hexdigest()
        if named[7:].lower() != found:
            raise ArchiveError(f"the {what}'s digest is {found}, not {named[7:]}")


def payload(headers, block):
    """(payload, its full length) of a record with an HTTP block; a revisit has no payload, only the
    length that its HTTP headers name. Other records: the block itself."""
    if headers["warc-type"] not in ("response", "revisit") or not headers.get("content-type", "").startswith("application/http"):
        _check_digest(headers.get("warc-payload-digest"), block, "payload")
        return block, len(block)
    head, ended, body = block.partition(b"\r\n\r\n")
    if not ended:
        raise ArchiveError("the HTTP headers do not end")
    named = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
    if headers["warc-type"] == "revisit":
        return None, int(named[1]) if named else None
    if named and int(named[1]) != len(body):
        raise ArchiveError(f"the HTTP Content-Length is {int(named[1])}, the payload has {len(body)} bytes")
    _check_digest(headers.get("warc-payload-digest"), body, "payload")
    return body, len(body)


# ---- archives ---------------------------------------------------------------------------------

def dictionary(samples):
    """A dictionary for records like the samples; None where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(_DICTIONARY_BYTES, samples) if len(samples) > 7 else None
    except zstandard.ZstdError:
        return None


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(content)) + content


class Frames:
    """The records of an open archive, one frame each: iterates (offset, bytes of the record)."""

    def __init__(self, source):
        self.source, self.buffer, self.offset, self.known = source, b"", 0, None

    def _fill(self, n: int) -> bool:
        """At least n bytes in the buffer; False at the end of the archive."""
        while len(self.buffer) < n:
            more = self.source.read(max(_READ, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def _take(self, n: int) -> bytes:
        if not self._fill(n):
            raise ArchiveError(f"the archive ends inside the frame at {self.offset}")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.offset += n
        return out

    def __iter__(self):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        while self._fill(1):
            start = self.offset
            if not self._fill(4):
                raise ArchiveError(f"the archive ends inside the frame at {start}")
            magic = struct.unpack("<I", self.buffer[:4])[0]
            if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
                _, size = struct.unpack("<II", self._take(8))
                content = self._take(size)
                if start == 0 and magic == DICTIONARY_FRAME:
                    if content[:4] == struct.pack("<I", FRAME_MAGIC):
                        content = plain.decompressobj().decompress(content)
                    if content[:4] != struct.pack("<I", DICTIONARY_MAGIC):
                        raise ArchiveError("the first frame holds no dictionary")
                    self.known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                continue
            if magic != FRAME_MAGIC:
                raise ArchiveError(f"no frame begins at {start}")
            yield start, self._frame(self.known or plain)

    def _frame(self, decoder) -> bytes:
        import zstandard

        frame, parts, start = decoder.decompressobj(), [], self.offset
        while not frame.eof:
            if not self.buffer and not self._fill(1):
                raise ArchiveError(f"the archive ends inside the frame at {start}")
            size = len(self.buffer)
            try:
                parts.append(frame.decompress(self.buffer))
            except zstandard.ZstdError as error:
                raise ArchiveError(f"the frame at {start} cannot be decoded: {error}") from error
            self.buffer = frame.unused_data if frame.eof else b""
            self.offset += size - len(self.buffer)
        return b"".join(parts)


def _store(uri: str):
    """The store of a URI as Spark or a user writes it, and the path in it."""
    return stores.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


class _Writer:
    """Archives of one task, below ``folder``."""

    def __init__(self, folder, date, level, size):
        self.store, self.path = _store(folder)
        self.store.create_dir(self.path, recursive=True)
        self.date, self.level, self.size = date, level, size
        self.waiting, self.held, self.out, self.count, self.raw = [], 0, None, 0, 0

    def add(self, data: bytes):
        """Add a record; the name, record count and size of an archive that is full with it, or None."""
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held < _SAMPLE_BYTES and len(self.waiting) < _SAMPLE_ROWS:
                return None
            self._open()
        else:
            self._write(data)
        return self.close() if self.raw >= self.size else None

    def _write(self, data):
        self.out.write(self.packer.compress(data))
        self.count += 1
        self.raw += len(data)

    def _open(self):
        import zstandard

        trained = dictionary([d[:64 << 10] for d in self.waiting])
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        self.name = f"{uuid.uuid4().hex}{SUFFIX}"
        self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        if trained is not None:
            self.out.write(skippable(zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())))
        info = b"software: uptake\r\nformat: WARC File Format 1.1\r\n"
        identity = uuid.uuid5(uuid.NAMESPACE_URL, self.name)
        self.out.write(self.packer.compress(record([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{identity}>"), ("WARC-Date", self.date),
            ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info)))
        for data in self.waiting:
            self._write(data)
        self.waiting, self.held = [], 0

    def close(self):
        if self.out is None and not self.waiting:
            return None
        if self.out is None:
            self._open()
        done = (self.name, self.count, self.out.tell())
        self.out.close()
        self.out, self.count, self.raw = None, 0, 0
        return done


def _line(text: str) -> str:
    """A header's value: control characters and spaces, which would break the header, as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def page_records(page_id, url, body: bytes, digest: str, first, date: str) -> bytes:
    """The record of a page: a revisit where ``first``, the page_id of the response, is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    named = "" if page_id is None else page_id
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{named}:{digest}>"),
        ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if first is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{first}:{digest}>")]
        body = b""
    block = head + body
    headers.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    return record(headers, block)


def _written(folder, date, level, size):
    def write(batches):
        writer, done = None, []
        for batch in batches:
            for page_id, url, body, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "body", "digest", "first"))):
                writer = writer or _Writer(folder, date, level, size)
                done.append(writer.add(page_records(
                    page_id.as_py(), url.as_py(), body.as_py(), digest.as_py(), first.as_py(), date)))
        done = [d for d in [*done, writer and writer.close()] if d]
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.record_batch({
            "name": pa.array(names, pa.string()), "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())})
    return write


def _placed(begun, folder):
    """Move reported archives to their place. A second attempt finds them there already."""
    def place(batches):
        (store, source), (_, target) = _store(begun), _store(folder)
        store.create_dir(target, recursive=True)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                if store.get_file_info(f"{source}/{name}").type != stores.FileType.NotFound:
                    store.move(f"{source}/{name}", f"{target}/{name}")
                elif store.get_file_info(f"{target}/{name}").type == stores.FileType.NotFound:
                    raise ArchiveError(f"the archive {name} is lost")
            yield batch
    return place


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z", level: int = 6,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC records below ``folder`` and return the archives (name, records, bytes).

    The payload is the html in UTF-8 (NULL: empty). Of rows with equal payloads of at least ``least_bytes`` bytes
    those with the smallest page_id are responses and the others revisits of it; shorter payloads are always
    responses. Rows without page_id are responses that nothing refers to; where all rows of a payload lack it, all are responses. Rows that
    share the smallest page_id are all responses. A NULL url gives no WARC-Target-URI; control characters and spaces in a url are
    percent-encoded. Other columns are ignored; an empty table gives no archives. ``folder`` must be reachable for
    executors by pyarrow's file systems (file, hdfs, s3, gs), as Spark writes no binary files; it is filled eagerly.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    several = rows.where(F.octet_length("body") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first != last")
    several = written(several.select("digest", "first"))
    # Where the join shuffles, Spark splits a payload that very many rows hold.
    rows = rows.join(several, "digest", "left").withColumn("first", F.when(F.col("first") < F.col("page_id"), F.col("first")))
    begun, spark = f"{folder.rstrip('/')}/_begun", pages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    reported = written(rows.select("page_id", "url", "body", "digest", "first").mapInArrow(
        _written(begun, date, level, archive_bytes), "name string, records bigint, bytes bigint"))
    return written(reported.mapInArrow(_placed(begun, folder), "name string, records bigint, bytes bigint"))


_RECORDS = (
    "archive string, offset bigint, type string, record_id string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes bigint, payload binary, error string")


def _read(strict, with_payload):
    def row(path, offset, data):
        out = {"archive": path, "offset": offset}
        headers, block = parsed(data)
        body, length = payload(headers, block)
        return out | {
            "type": headers["warc-type"], "record_id": headers["warc-record-id"], "refers_to": headers.get("warc-refers-to"),
            "target_uri": headers.get("warc-target-uri"), "date": headers["warc-date"],
            "payload_digest": headers.get("warc-payload-digest"), "payload_bytes": length, "payload": body if with_payload else None}

    def one(path):
        store, inside = _store(path)
        offset = 0
        with store.open_input_stream(inside, compression=None) as source:
            frames = iter(Frames(source))
            while True:
                try:
                    offset, data = next(frames, (None, None))
                    if data is None:
                        return
                    yield row(path, offset, data)
                except ArchiveError as error:
                    if strict:
                        raise ArchiveError(f"{path}: {error} (record at {offset})") from error
                    yield {"archive": path, "offset": offset, "error": str(error)}

    def read(batches):
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (
            x.split() for x in _RECORDS.split(", "))])
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for found in one(path):
                    held.append(found)
                    size += 200 + len(found.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)
    return read


def read_archives(spark: SparkSession, folder: str, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """The records of all archives (``*.warc.zst``) in ``folder``, a row each.

    ``payload_bytes`` is the length of the full payload; a revisit has no payload itself. With ``strict`` anything that breaks
    the format ends the query; else such a record has its fault in ``error``, NULL elsewhere, and reading goes on with the
    next frame; what follows a frame that cannot be decoded is one row. An empty archive has no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path")
    return files.mapInArrow(_read(strict, with_payload), _RECORDS)
