"""A WARC data source.

Files are planned into partitions of about equal bytes. Predicates on a record's type and headers are pushed into the reader, which parses a
record's headers first: where they don't match, an uncompressed payload is sought past and a compressed one is inflated without being kept,
and neither is parsed. The payload's HTTP headers are split off; the rest stays bytes, so nothing is decoded that a query doesn't ask for.

A damaged stretch doesn't end a file: reading goes on at the next record or gzip member. The mode says what becomes of the stretch, as with
Spark's own sources: a row of warc_type "damaged" whose content_length is the bytes passed over (PERMISSIVE), nothing (DROPMALFORMED), or
an error (FAILFAST).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from .common import columns, shared_dir, ship

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length bigint, headers map<string,string>, http_status int, payload binary"
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}
ARROW = pa.schema(
    [("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload", pa.binary())]
)
#: Bytes of files to a partition, and of payload to a batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
READ = 1 << 18
#: A header block that is longer is damage.
MAX_HEADER = 1 << 20
DAMAGED = "damaged"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _size(x) -> int:
    return int(x)


_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
}


def pushable(f: Filter) -> bool:
    """Whether a record's headers alone decide the filter."""
    if isinstance(f, Not):
        return pushable(f.child) and isinstance(f.child, (EqualTo, In, IsNull, IsNotNull, EqualNullSafe))
    if type(f) not in _TESTS or len(f.attribute) != 1:
        return False
    return f.attribute[0] in HEADERS or f.attribute[0] == "content_length"


def holds(f: Filter, record: dict) -> bool:
    """The filter's value for a record's parsed headers; null counts as false, also under not."""
    if isinstance(f, Not):
        v = record.get(f.child.attribute[0])
        return (v is not None or isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe))) and not holds(f.child, record)
    return _TESTS[type(f)](record.get(f.attribute[0]), f)


class _Damage(Exception):
    """A gzip member that can't be inflated was left; so many of its bytes were passed over, and the next member comes next."""


class _Plain:
    """Records of an uncompressed file; what isn't wanted is sought past."""

    def __init__(self, file):
        self.file, self.buffer, self.at, self.base, self.began = file, b"", 0, 0, 0

    def _more(self) -> bool:
        chunk = self.file.read(READ)
        self.buffer, self.base, self.at = self.buffer[self.at :] + chunk, self.base + self.at, 0
        return bool(chunk)

    def header(self) -> bytes | None:
        """The next record's header block, with the white space before it left out; empty if there is none to be found in what comes; None at
        the end of the file."""
        while True:
            while self.buffer[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            self.began = self.base + self.at
            end = self.buffer.find(b"\r\n\r\n", self.at)
            if end >= 0:
                block = self.buffer[self.at : end]
                self.at = end + 4
                return block
            if len(self.buffer) - self.at > MAX_HEADER:
                return b""
            if not self._more():
                return b"" if self.at < len(self.buffer) else None

    def payload(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        part = self.buffer[self.at : self.at + n]
        self.at += len(part)
        return part

    def skip(self, n: int) -> None:
        if len(self.buffer) - self.at >= n:
            self.at += n
        else:
            self.base += self.at + n
            self.file.seek(self.base)
            self.buffer, self.at = b"", 0

    def resume(self) -> int:
        """Go on at the next line that a record may begin with; the bytes since the last header block began."""
        self.at = max(0, self.began - self.base) + 1
        while True:
            found = self.buffer.find(b"\nWARC/", max(0, self.at - 1))
            if found >= 0:
                self.at = found + 1
                return self.base + self.at - self.began
            self.at = max(self.at, len(self.buffer) - 5)
            if not self._more():
                self.base, self.buffer, self.at = self.base + len(self.buffer), b"", 0
                return self.base - self.began

    def forget(self) -> None:
        self.buffer, self.at = b"", 0
        self.base = self.file.pos


class _Inflated:
    """A read-only view of a file of gzip members. Seeking forward inflates without keeping."""

    def __init__(self, file):
        self.file, self.raw, self.pos = file, b"", 0
        self.z = zlib.decompressobj(31)
        self.ended = self.inside = False

    def _next_member(self) -> int:
        """Leave the member that is being read for the next one; the bytes passed over, of what was read last."""
        passed, tail = 0, self.raw[1:]
        while True:
            found = tail.find(b"\x1f\x8b\x08")
            if found >= 0:
                self.raw = tail[found:]
                break
            more = self.file.read(READ)
            passed += max(0, len(tail) - 2) if more else len(tail)
            if not more:
                self.raw, found, self.ended = b"", 0, True
                break
            tail = tail[-2:] + more
        self.z, self.inside = zlib.decompressobj(31), False
        return passed + found + 1

    def read(self, n: int) -> bytes:
        while not self.ended:
            if self.z.eof:
                self.raw = self.z.unused_data or self.raw
                self.z, self.inside = zlib.decompressobj(31), False
                if not self.raw:
                    self.raw = self.file.read(READ)
                if not self.raw.strip(b"\0"):
                    self.ended = True
                    break
            if not self.raw:
                self.raw = self.file.read(READ)
                if not self.raw:
                    self.ended = True
                    if self.inside:
                        raise _Damage(0)
                    break
            try:
                out = self.z.decompress(self.raw, n)
            except zlib.error:
                raise _Damage(self._next_member()) from None
            self.inside = True
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if self.z.eof and not self.z.unused_data:
                self.raw = b""
            if out:
                self.pos += len(out)
                return out
        return b""

    def seek(self, to: int) -> None:
        while self.pos < to and self.read(min(READ, to - self.pos)):
            pass


def _parsed(block: bytes) -> dict | None:
    """A record's headers by lower-case name, continuation lines joined; None if the block doesn't begin as a record must."""
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return None
    found: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in b" \t" and last and line:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().decode("utf-8", "replace").lower()
            found[last] = value.strip().decode("utf-8", "replace")
    return found


def _length(headers: dict) -> int:
    try:
        return max(0, int(headers.get("content-length", "0")))
    except ValueError:
        return 0


def _http(raw: bytes, content_type: str | None) -> tuple[int | None, bytes]:
    """Status and body of an HTTP message; what isn't one is all body."""
    if not (content_type or "").startswith("application/http"):
        return None, raw
    head, split, body = raw.partition(b"\r\n\r\n")
    if not split:
        return None, raw
    first = head.split(b"\r\n", 1)[0].split(b" ")
    status = int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and first[1].isdigit() else None
    return status, body


def records(path: str, filters: Sequence[Filter] = (), payload: bool = True, mode: str = "DROPMALFORMED") -> Iterator[tuple]:
    """The file's records that pass the filters, as tuples in the schema's order. A record that is cut short is damage, too."""
    system, inner = fs.FileSystem.from_uri(path)

    def damage(passed: int) -> Iterator[tuple]:
        if mode == "FAILFAST":
            raise ValueError(f"{path}: {passed} bytes are damaged")
        record = dict.fromkeys(HEADERS) | {"warc_type": DAMAGED, "content_length": passed}
        if mode == "PERMISSIVE" and all(holds(f, record) for f in filters):
            yield (*(record[k] for k in HEADERS), passed, {}, None, None)

    with system.open_input_file(inner) as file:
        magic = file.read(2)
        file.seek(0)
        stream = _Plain(_Inflated(file) if magic == b"\x1f\x8b" else file)
        while True:
            try:
                block = stream.header()
                if block is None:
                    return
                headers = _parsed(block)
                if headers is None:
                    yield from damage(stream.resume())
                    continue
                n = _length(headers)
                record = {k: headers.get(h) for k, h in HEADERS.items()} | {"content_length": n}
                if not all(holds(f, record) for f in filters):
                    stream.skip(n)
                    continue
                status, body = None, None
                if payload:
                    raw = stream.payload(n)
                    if len(raw) < n:
                        yield from damage(len(raw))
                        continue
                    status, body = _http(raw, record["content_type"])
                else:
                    stream.skip(n)
            except _Damage as lost:
                stream.forget()
                yield from damage(lost.args[0])
                continue
            yield (*(record[k] for k in HEADERS), n, headers, status, body)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.mode = str(options.get("mode", MODES[0])).upper()
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r}")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what headers decide. All are given back, too, so that Spark tests the few rows that come out once more."""
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files by size, the largest first, each to the partition that has the least."""
        system, inner = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(inner)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        if info.type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        else:
            found = [info] if info.type == fs.FileType.File else []
        total = sum(i.size or 0 for i in found)
        bins: list[list] = [[0, i, []] for i in range(max(1, min(len(found), -(-total // self.partition_bytes))))]
        import heapq

        for i in sorted(found, key=lambda i: (-(i.size or 0), i.path)):
            least = heapq.heappop(bins)
            least[2].append(scheme + i.path if scheme == "file://" else scheme + i.path.lstrip("/"))
            least[0] += i.size or 0
            heapq.heappush(bins, least)
        return [Files(tuple(b[2])) for b in sorted(bins, key=lambda b: b[1])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols[6] = [list(h.items()) for h in cols[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)

        for path in partition.paths:
            for record in records(path, self.filters, self.payload, self.mode):
                rows.append(record)
                size += 500 + len(record[8] or b"")
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """format("warc"): options path, mode, payload (false leaves payloads null) and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, uri: str, payload: bool = True, mode: str = MODES[0]) -> DataFrame:
    """The records of a file, or of all .warc and .warc.gz files under a folder. A missing path has none.

    Spark keeps what a Python source planned last on the loaded relation, so each query with filters of its own, and each side of a join,
    takes a call of its own.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("mode", mode).load(uri)


def _field(name: str, value: str | None) -> bytes:
    return b"" if value is None else f"{name}: {value}\r\n".encode()


def _record(kind: str, fields: bytes, body: bytes) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\n" + fields + b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", compressed: bool = True) -> DataFrame:
    """Each page as a request and a response, in one file a partition; path and records of each file.

    Signs that can't stand in a header are percent-encoded in the URL. A null id or URL has no header; a null text has no response but a
    metadata record. A task that runs again writes another file and only the files in the result are to be read; archived() does so.
    """
    ship(pages.sparkSession)
    base = columns(pages, id_col, url_col, text_col).toDF("page_id", "url", "html").selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(uri)
        system.create_dir(inner, recursive=True)
        path, n = f"{inner}/{uuid.uuid4().hex}.warc" + (".gz" if compressed else ""), 0
        with system.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:

            def put(raw: bytes) -> None:
                if compressed:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                out.write(raw)

            put(_record("warcinfo", b"Content-Type: application/warc-fields\r\n", b"software: feedloom\r\n"))
            for batch in batches:
                for i, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    clean = None if url is None else quote(url, safe="".join(map(chr, range(33, 127)))) if not (url.isascii() and url.isprintable() and " " not in url) else url
                    same = _field("WARC-Record-ID", None if i is None else f"<urn:page:{i}>") + _field("WARC-Target-URI", clean) + _field("WARC-Date", "2024-01-01T00:00:00Z")
                    put(_record("request", same + b"Content-Type: application/http; msgtype=request\r\n", f"GET {clean or '/'} HTTP/1.1\r\n\r\n".encode()))
                    if html is None:
                        put(_record("metadata", same + b"Content-Type: application/warc-fields\r\n", b""))
                    else:
                        put(_record("response", same + b"Content-Type: application/http; msgtype=response\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode("utf-8", "surrogatepass")))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return base.mapInArrow(run, "path string, records bigint")


def archived(pages: DataFrame) -> DataFrame:
    """page_id, url and html of pages as read back from archives that are written of them here. Rows that repeat come back as often; a page
    without text, which has no response, does not."""
    spark = pages.sparkSession
    uri = shared_dir(spark)
    kept = {r.path for r in write_warc(pages, uri).collect()}  # one row a file
    system, inner = fs.FileSystem.from_uri(uri)
    for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if info.path not in kept:  # of a task that was run again
            system.delete_file(info.path)
    found = read_warc(spark, uri).filter((F.col("warc_type") == "response") & F.col("content_type").startswith("application/http"))
    return found.filter("http_status = 200").select(F.regexp_extract("record_id", "^<urn:page:(-?\\d+)>$", 1).try_cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "utf-8").alias("html"))
