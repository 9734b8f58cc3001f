"""Media columns: archives of media members as a Spark data source.

``write_archives`` stores payloads as members of tar archives, through Spark's own
committed writer, on any file system.  ``ArchiveSource`` (format
``media_archives``) reads them: the driver only lists the archive directory and
plans byte ranges; a task seeks into its range, finds the first member header
there by the archive's marker, and owns each member whose header starts in the
range.  Payloads leave a task as Arrow batches of bounded size.  A member that
cannot be read or whose checksum fails is tried again on its own, by its offset,
on a newly opened file; after ``retries`` tries the read fails, or, with
``on_error=row``, the member comes as a row with its error.

A text is stored as a grey image of 192 samples (8 bits each) a row, losslessly
(PNG).  Features: least, greatest and mean sample, their mean square, sign changes
about the mean, and a 16-bin histogram.

Defined results: a null or empty text is one row of blanks; a null doc_id is kept;
repeated rows get equal results; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanforge.sources.committed import store_of

from . import common

WIDTH = 192
BLOCK = 512
SCHEMA = "archive string, offset long, member string, media binary, error string"
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """8-bit grey samples, whole rows, as a PNG image (no row filter)."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG image, rows by columns; each chunk's checksum
    is verified."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body, size = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) < n or zlib.crc32(kind + content) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *_, interlaced = struct.unpack(">IIBBBBB", content)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("only 8-bit grey images are read")
            size = (height, width)
        elif kind == b"IDAT":
            body.append(content)
        at += n + 12
    height, width = size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    filters, rows = lines[:, 0], lines[:, 1:]
    if not filters.any():
        return rows
    out = np.zeros((height + 1, width), np.uint8)
    for i in range(height):
        if filters[i] == 0:
            out[i + 1] = rows[i]
        elif filters[i] == 1:
            out[i + 1] = np.cumsum(rows[i], dtype=np.uint8)
        elif filters[i] == 2:
            out[i + 1] = rows[i] + out[i]
        else:
            raise ValueError("this row filter is not read")
    return out[1:]


def _header(name: str, size: int, marker: str) -> bytes:
    """A ustar member header; the marker stands as the owner's name."""
    block = bytearray(BLOCK)
    for at, value in ((0, name.encode()[:100]), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000"), (265, marker.encode())):
        block[at : at + len(value)] = value
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


def _read_header(block: bytes, marker: bytes | None = None) -> tuple[str, int, bytes] | None:
    """(name, size, marker) of a header block, None if it is none of this archive."""
    if len(block) < BLOCK or block[257:262] != b"ustar":
        return None
    own = block[265:297].rstrip(b"\0")
    if marker is not None and own != marker:
        return None
    try:
        if int(block[148:154], 8) != sum(block[:148]) + 8 * 32 + sum(block[156:]):
            return None
        return block[:100].rstrip(b"\0").decode(), int(block[124:135], 8), own
    except ValueError:
        return None


def _members(marker: str):
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = common.Rows(schema)
        for batch in batches:
            for name, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
                record = _header(name, len(media), marker) + media
                # the writer ends each record with \n: the last byte of the filling
                record += bytes(-(len(record) + 1) % BLOCK)
                rows.add(record, size=len(record))
                yield from rows.take()
        yield from rows.take(0)

    return run


def write_archives(members: DataFrame, path: str) -> None:
    """Write (member, media) rows as tar archives, one a task, to a directory."""
    import uuid

    records = members.select("member", "media").mapInArrow(_members(uuid.uuid4().hex), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, marker: bytes):
        self.path, self.start, self.end, self.marker = path, start, end, marker


class ArchiveReader(DataSourceReader):
    """Reads each byte range by itself. A range finds its first member by the archives'
    marker; from there on each next header's place is known, and what fails there is a
    failed member, not something to look past: it is read again by its offset, on a file
    of its own, and then is an error, or a row with one. The header behind a range's last
    member is checked by that range, as the next one could not know of it."""

    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.retries = int(options.get("retries", 3))
        self.pause = float(options.get("pause", 0.05))
        self.on_error = options.get("onerror", "fail")

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, root = store_of(self.path)
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        step = max(self.range_bytes // BLOCK, 1) * BLOCK
        if not files:
            return [_Range("", 0, 0, b"")]
        markers = self._markers(system, [p for p, _ in files])
        return [_Range(p, a, min(a + step, n), markers[p.rpartition("/")[0]]) for p, n in files for a in range(0, n, step)]

    def _markers(self, system, paths: list[str]) -> dict[str, bytes]:
        """The marker that the archives of a folder share, from its first sound header."""
        found: dict[str, bytes] = {}
        for path in paths:
            folder = path.rpartition("/")[0]
            if folder not in found:
                with system.open_input_file(path) as f:
                    head = _read_header(f.read(BLOCK))
                if head is not None:
                    found[folder] = head[2]
        for path in paths:
            if path.rpartition("/")[0] not in found:
                raise OSError(f"{path} is no archive")
        return found

    def _open(self, path: str):
        return store_of(self.path)[0].open_input_file(path)

    def _header_at(self, f, at: int, marker: bytes) -> tuple[str, int] | None:
        f.seek(at)
        head = _read_header(f.read(BLOCK), marker)
        return None if head is None else head[:2]

    def _tried(self, f, path: str, work):
        """``work(file)``, again on a file of its own if it fails; (result, error)."""
        error = None
        for k in range(self.retries + 1):
            try:
                if not k:
                    return work(f), None
                time.sleep(self.pause * 2**k)
                with self._open(path) as own:
                    return work(own), None
            except (OSError, ValueError, zlib.error) as problem:
                error = f"{type(problem).__name__}: {problem}"
        return None, error

    def _known_header(self, at: int, marker: bytes):
        def work(f) -> tuple[str, int]:
            head = self._header_at(f, at, marker)
            if head is None:
                raise OSError(f"no member header at {at}")
            return head

        return work

    def _body(self, at: int, size: int):
        def work(f) -> bytes:
            f.seek(at + BLOCK)
            media = f.read(size)
            if len(media) < size:
                raise OSError(f"member at {at} is cut short")
            if media[:8] == _PNG:
                decode_png(media)
            return media

        return work

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        rows = common.Rows(schema, self.batch_bytes)

        def failed(at: int, name: str | None, error: str) -> None:
            if self.on_error != "row":
                raise OSError(f"{part.path} at {at}: {error}")
            rows.add(part.path, at, name, None, error, size=200)

        if part.path:
            with self._open(part.path) as f:
                at, size, sure = part.start, f.size(), part.start == 0
                while at < part.end:
                    if sure:
                        head, error = self._tried(f, part.path, self._known_header(at, part.marker))
                        if error:
                            failed(at, None, error)
                            sure = False
                    else:
                        head, error = self._tried(f, part.path, lambda x, at=at: self._header_at(x, at, part.marker))
                        if error:  # what is lost here nobody can tell
                            raise OSError(f"{part.path} at {at}: {error}")
                    if head is None:
                        at += BLOCK
                        continue
                    sure = True
                    name, length = head
                    media, error = self._tried(f, part.path, self._body(at, length))
                    if error:
                        failed(at, name, error)
                    else:
                        rows.add(part.path, at, name, media, None, size=len(media) + 200)
                    yield from rows.take()
                    at += -(-(BLOCK + length + 1) // BLOCK) * BLOCK
                if sure and part.end <= at < size:
                    _, error = self._tried(f, part.path, self._known_header(at, part.marker))
                    if error:
                        failed(at, None, error)
        yield from rows.take(0)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(directory)``. Options: rangeBytes,
    batchBytes, retries, onError (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(**options).load(path)


def _as_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = common.Rows(pa.schema([("member", pa.string()), ("media", pa.binary())]))
    for batch in batches:
        for did, text in zip(batch.column("did").to_pylist(), common.octets(batch.column("text")), strict=True):
            media = encode_png(text.ljust(max(-(-len(text) // WIDTH), 1) * WIDTH))
            rows.add(f"{did}.{len(text)}.png", media, size=len(media) + 100)
            yield from rows.take()
    yield from rows.take(0)


def features(samples: np.ndarray) -> str:
    """Fixed-point features of 8-bit samples."""
    flat = samples.ravel()
    n, total = len(flat), int(flat.sum(dtype=np.int64))
    bins = np.bincount(flat >> 4, minlength=16)
    square = int((np.bincount(flat, minlength=256) * np.arange(256) ** 2).sum())
    above = flat > total / n
    changes = int((above[1:] != above[:-1]).sum())
    return f"min={flat.min()};max={flat.max()};mean={total * 1000 // n};square={square * 1000 // n};changes={changes};bins={','.join(map(str, bins))}"


_DIGEST = T.StructType([T.StructField(k, t) for k, t in (("did", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    rows = common.Rows(schema, 1 << 20)
    for batch in batches:
        for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
            did, n, _ = member.split(".")
            samples = decode_png(media)
            payload = samples.tobytes()
            rows.add(int(did), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), size=400)
        yield from rows.take()
    yield from rows.take(0)


def media_columns(docs: DataFrame, **options) -> DataFrame:
    """Store each text as an image in archives, read the archives back and describe
    each member: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature). Raises if it read another number of members
    than it wrote."""
    spark = docs.sparkSession
    root = common.scratch(spark, "media")
    path = f"{root}/archives"
    write_archives(common.identified(docs).select("did", "text").mapInArrow(_as_images, "member string, media binary"), path)
    described = read_archives(spark, path, **options).select("member", "media").mapInArrow(_digests, _DIGEST)
    described = common.settle(described, f"{root}/described")
    written, read = docs.count(), described.count()
    if written != read:
        raise OSError(f"{read} members read of {written} written")
    common.drop(spark, path)
    return described.select(common.doc_id_back().alias("doc_id"), *[f.name for f in _DIGEST if f.name != "did"])
