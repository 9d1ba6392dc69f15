"""WARC archives: written with Spark's text writer, read by a Python data source.

`write_archive` makes one record per row. Rows with equal payloads of at least `min_bytes`
bytes share one `response` record, that of the largest key; the others become `revisit`
records with the same digest, HTTP headers and no payload. Payloads are equal if their
SHA-1 digests and lengths are.

`WarcSource` (format "warc") plans its partitions from the sizes of the files. Equality,
`in`, prefix and null filters on the columns that come from a record's header are pushed
down: a task parses a record's header first, and passes over the block of a record that
the filters refuse, or whose payload is not asked for (option payload = false). Plain and
gzip files are read as streams; at most one payload and one batch is held at a time.

Null payloads are written as empty. Null keys are written as an empty record id and read
as null; such a row never is what others refer to. Rows with the same key and payload are
all written. Control characters in a URL are percent-encoded. An empty table gives an
archive without records. Extra columns are not written.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith,
)

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string,"
    " payload_digest string, content_type string, payload_bytes bigint, payload binary"
)
#: Columns that come from a record's header, by the header's name in lower case.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to",
    "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
FILE_RECORDS = 50_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:page:"


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 digest in base 32: five digits make four characters."""
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def records(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int, date: str) -> DataFrame:
    """One column `value`: the records' text without the blank lines that end a record."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body"), "digest": F.sha1(F.encode("body", "UTF-8"))})
    # The digests alone are summed up; the payloads move once, in the join back.
    last = rows.groupBy("digest", "size").agg(F.max("key").alias("last"))
    rows = rows.join(last, ["digest", "size"])
    revisit = (F.col("size") >= min_bytes) & (F.col("key") < F.col("last"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"),
        F.lit("\r\n\r\n"),
    )
    rows = rows.withColumns({"revisit": F.coalesce(revisit, F.lit(False)), "http": http})
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "body"))
    safe = F.col("url")
    for code in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{URN}"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(">")),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("last"), F.lit(">"))),
        F.when(
            F.col("revisit"),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("value"))


def write_archive(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Writes the rows as gzipped WARC files of at most FILE_RECORDS records into a new folder."""
    written = records(pages, key, url, payload, min_bytes, date).write
    written.options(lineSep="\r\n\r\n", maxRecordsPerFile=FILE_RECORDS, compression="gzip").text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None


def _header(lines: list[bytes]) -> dict[str, str]:
    out, name = {}, ""
    for line in lines:
        if line[:1] in b" \t" and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _value(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column])
    return value.strip("<>") if value is not None and column in ("record_id", "refers_to") else value


def _passes(value: str | None, f: Filter) -> bool:
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else value == f.value


def read_records(stream, wanted=lambda headers: True, payloads: bool = True) -> Iterator[Record]:
    """Records of one open file whose headers are wanted; other blocks are passed over."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        lines = []
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            lines.append(line)
        headers = _header(lines)
        left = int(headers["content-length"])
        if not wanted(headers):
            _skip(stream, left)
            continue
        http: dict[str, str] = {}
        if headers.get("content-type", "").startswith("application/http"):
            lines = []
            while left and (line := stream.readline(left)):
                left -= len(line)
                if not line.rstrip(b"\r\n"):
                    break
                lines.append(line.rstrip(b"\r\n"))
            http = _header(lines[1:])
        if payloads and headers.get("warc-type") != "revisit":
            payload = stream.read(left)
            if len(payload) < left:
                raise ValueError("the file ends within a record")
            yield Record(headers, http, payload)
        else:
            _skip(stream, left)
            yield Record(headers, http, None)


def _skip(stream, size: int) -> None:
    if stream.seekable():
        stream.seek(size, 1)
        return
    while size > 0 and (part := stream.read(min(size, 1 << 20))):
        size -= len(part)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)
        for f in filters:
            if isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append((f.attribute[0], f))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(
            ((f.size, f.path) for f in found if f.is_file and f.size and f.base_name[:1] not in "_."), reverse=True
        )
        planned, size = [], PARTITION_BYTES
        for n, path in files:
            if size + n > PARTITION_BYTES:
                planned.append([])
                size = 0
            planned[-1].append(path)
            size += n
        return [Files(paths) for paths in planned] or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(_passes(_value(headers, column), f) for column, f in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                for record in read_records(stream, self._wanted, self.payloads):
                    own = [_value(record.headers, column) for column in HEADERS]
                    size = record.http.get("content-length")
                    if size is None and record.payload is not None:
                        size = len(record.payload)
                    rows.append([*own, None if size is None else int(size), record.payload])
                    held += len(record.payload or b"") + 200
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
    names = [*HEADERS, "payload_bytes", "payload"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of WARC files; turns filter push-down on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record (page_id, payload_bytes, payload_digest, record_type, refers_to).

    The payloads of responses are hashed again; of revisits only the headers are read.
    """
    def page(column: str) -> Column:
        return F.regexp_extract(column, f"^{URN}(-?[0-9]+)$", 1)

    found = read_archive(spark, path)
    full = found.where("record_type = 'response'").withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32(F.sha1("payload"))}
    )
    brief = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    brief = brief.withColumn("payload_digest", F.regexp_replace("payload_digest", "^sha1:", ""))
    return full.unionByName(brief).select(
        F.nullif(page("record_id"), F.lit("")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.nullif(page("refers_to"), F.lit("")).cast("bigint").alias("refers_to"),
    )
