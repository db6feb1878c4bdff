"""Operator 9, media columns: payloads as images in archives, read through a custom Spark data source.

Writing: every task stores its rows' payloads as members of one archive in the shared folder: 8-bit grayscale PNG
images 64 samples wide, so that each sample is a payload byte, in a stored (not compressed again) ZIP file. Beside it goes
an index of fixed records (offset, size and checksum of each member). Every attempt writes under a name of its own; the
manifest, which only attempts that Spark has committed are in, names the archives that count and their byte ranges, each
with its members' place in the index. So an attempt that dies, or one that is run twice, leaves nothing that is read.

Reading: the data source `attestor_media` plans the manifest's byte ranges. A task reads its part of the index, then its range
of the archive, checks each member by its offset, tries a member again by itself when that fails, and yields Arrow batches of
bounded size. A folder without a manifest is read too: ranges are then cut by size, and a task looks its members up in the
archive's own directory.

Defined cases: null and empty texts store 64 zero bytes; equal texts give equal media; a null, empty or repeated doc_id, or
one with any characters, is carried as it is (in the member's name); members are told apart by their place, not by id;
other columns are ignored; an empty table has no archive and gives no rows; a member that fails every attempt fails the task,
so no row is lost in silence.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from attestor.llm.common import fresh_path, store, table, tuned

SIDE = 64
#: Bytes of an archive that one task reads, and of payload in one Arrow batch.
RANGE_BYTES, BATCH_BYTES = 16 << 20, 8 << 20
ATTEMPTS = 4
_MAGIC = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4s5H3L2H")
#: A member in an index: where it begins, its bytes, their sum.
_ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("sum", "<u4")])
MANIFEST = "_manifest"


# ---- the format -------------------------------------------------------------------------------------------------

def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, filled with zeros to a positive multiple of 64, and its length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % SIDE if raw else SIDE), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """Grayscale, 8 bits a sample, 64 wide, no row filter; the length without padding is a text chunk."""
    rows = len(payload) // SIDE
    lines = np.zeros((rows, SIDE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, rows, 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The payload and the length without padding. Raises ValueError for anything that is not such an image."""
    if media[:8] != _MAGIC:
        raise ValueError("not an image")
    at, data, n, rows = 8, [], 0, 0
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, rows, depth, color = struct.unpack_from(">IIBB", body)
            if (width, depth, color) != (SIDE, 8, 0):
                raise ValueError("another kind of image")
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, SIDE + 1)
    return lines[:, 1:].tobytes(), n


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean, deviation, entropy in bits, mean step between neighbours, and a 4 by 4 grid's brightness hash."""
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    step = np.abs(np.diff(samples.astype(np.int16))).mean()
    cells = np.array_split(samples, 16)
    mean = samples.mean()
    grid = sum(int(c.mean() > mean) << i for i, c in enumerate(cells) if len(c))
    return f"gray8 {SIDE}x{len(samples) // SIDE} mean={mean:.4f} dev={samples.std():.4f} bits={abs((share * np.log2(share)).sum()):.4f} step={step:.4f} grid={grid:04x}"


# ---- archives ---------------------------------------------------------------------------------------------------

def member_name(place: int, doc_id) -> str:
    """The id stands in the name, spelled so that any text, none at all and null stay what they are."""
    return f"{place}.png" if doc_id is None else f"{place}/{quote(str(doc_id), safe='')}.png"


def id_in(name: str) -> str | None:
    _, slash, rest = name.partition("/")
    return unquote(rest.removesuffix(".png")) if slash else None


def write_archives(docs: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> int:
    """Stores each row's payload, and the manifest: archive, begin, end, first (place in the index), members. Returns the
    number of members."""
    def run(batches):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        own = f"part-{uuid.uuid4().hex}.zip"
        archive, out, entries = None, None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if archive is None:
                    out = fs.open_output_stream(f"{root}/{own}")
                    counted = _Counted(out)
                    archive = zipfile.ZipFile(counted, "w", zipfile.ZIP_STORED, allowZip64=True)
                media = to_png(*payload_of(text))
                entries.append((counted.at, len(media), zlib.crc32(media)))
                archive.writestr(zipfile.ZipInfo(member_name(len(entries) - 1, doc_id)), media)
        if archive is None:
            return
        ends = counted.at
        archive.close()
        out.close()
        index = np.array(entries, _ENTRY)
        with fs.open_output_stream(f"{root}/{own}.index") as f:
            f.write(index.tobytes())
        begin = index["offset"]
        first = np.append(np.unique(begin // range_bytes, return_index=True)[1], len(index))
        yield pa.RecordBatch.from_pydict({
            "archive": [own] * (len(first) - 1), "begin": begin[first[:-1]].astype(np.int64), "end": np.append(begin[first[1:-1]], ends).astype(np.int64),
            "first": first[:-1].astype(np.int64), "members": np.diff(first).astype(np.int64),
        })

    rows = docs.select("doc_id", "text").mapInArrow(run, "archive string, begin long, end long, first long, members long")
    rows.write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.parquet(f"{folder}/{MANIFEST}").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


class _Counted(io.RawIOBase):
    """A stream that only goes forward, for zipfile."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass


class ByteRange(InputPartition):
    """Members that begin in [begin, end) of an archive; with a manifest, also their place in the index."""

    def __init__(self, archive: str, begin: int, end: int, first: int = 0, members: int | None = None):
        super().__init__((archive, begin, end))
        self.archive, self.begin, self.end, self.first, self.members = archive, begin, end, first, members


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        fs, root = store(self.folder)
        if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
            found = sorted(tuple(r.values()) for r in pq.read_table(f"{root}/{MANIFEST}", filesystem=fs).to_pylist())
        else:
            files = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".zip")]
            found = [(f.base_name, at, min(at + self.range, f.size)) for f in sorted(files, key=lambda f: f.base_name) for at in range(0, f.size, self.range)]
        return [ByteRange(*x) for x in found] or [ByteRange("", 0, 0)]

    @staticmethod
    def members(fs: pafs.FileSystem, path: str, part: ByteRange, file) -> list[tuple[int, int, int]]:
        """Offset, size and sum of the range's members: from the index, else from the archive's directory."""
        if part.members is None:
            return [(m.header_offset, m.file_size, m.CRC) for m in zipfile.ZipFile(file).infolist() if part.begin <= m.header_offset < part.end]
        with fs.open_input_file(f"{path}.index") as index:
            index.seek(part.first * _ENTRY.itemsize)
            return np.frombuffer(index.read(part.members * _ENTRY.itemsize), _ENTRY).tolist()

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, root = store(self.folder)
        path = f"{root}/{part.archive}"
        with fs.open_input_file(path) as file:
            rows, size = [], 0
            for offset, length, total in self.members(fs, path, part, file):
                name, media = self.member(file, offset, length, total)
                rows.append((part.archive, offset, name, media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    @staticmethod
    def member(file, offset: int, size: int, total: int) -> tuple[str, bytes]:
        """One member's name and media, from its offset; tried again by itself, with a pause, when it cannot be read or its
        sum is wrong."""
        for attempt in range(ATTEMPTS):
            try:
                file.seek(offset)
                head = _LOCAL.unpack(file.read(_LOCAL.size))
                name = file.read(head[9])
                file.seek(offset + _LOCAL.size + head[9] + head[10])
                media = file.read(size)
                if head[0] != b"PK\x03\x04" or len(media) != size or zlib.crc32(media) != total:
                    raise ValueError(f"a damaged member at {offset}")
                return name.decode("utf-8"), media
            except (OSError, ValueError, struct.error):
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    archive, offset, member, media = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(archive), pa.array(offset, pa.int64()), pa.array(member), pa.array(media, pa.binary())], ["archive", "offset", "member", "media"])


class MediaSource(DataSource):
    """spark.read.format("attestor_media").load(folder): archive, offset, member, media."""

    @classmethod
    def name(cls) -> str:
        return "attestor_media"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """range_bytes: of the ranges where no manifest states them."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("attestor_media").option("rangebytes", str(range_bytes)).load(folder)


def features(media: DataFrame, id_type: str = "long") -> DataFrame:
    """Decodes each member and computes the contract's columns from what was stored."""
    def run(batches):
        for b in batches:
            out = []
            for name, blob in zip(b.column("member").to_pylist(), b.column("media").to_pylist()):
                payload, n = from_png(blob)
                out.append((id_in(name), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SIDE:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(np.frombuffer(payload, np.uint8))))
            if out:
                kinds = [pa.string(), *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _COLUMNS)

    rows = media.select("member", "media").mapInArrow(run, ", ".join(f"{c} {'string' if c in _STRINGS else 'long'}" for c in _COLUMNS))
    return rows.withColumn("doc_id", rows["doc_id"].cast(id_type))


_COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_STRINGS = {"doc_id", "payload_sha256", "media_sha256", "feature"}


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    folder = fresh_path(spark, "archives")
    write_archives(docs, folder)
    return features(read_media(spark, folder), docs.schema["doc_id"].dataType.simpleString())
