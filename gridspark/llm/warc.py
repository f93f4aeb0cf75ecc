"""WARC archives as a Python data source, with repeated payloads written as revisit records.

Writing: every task writes ``.warc`` files of bounded size; a commit writes one list of those that count. Reading: a partition is a file; the reader parses headers
first, applies pushed predicates on them, and seeks over the payload of a record that fails or if payloads are not asked
for. Files are reached through ``pyarrow.fs``, so any store that it knows will do.
"""

from __future__ import annotations

import base64
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import Row, StructType

from gridspark.llm.tables import shared_path, stored

#: Payloads from this many bytes on are written once; records that repeat them refer to that one.
REVISIT_BYTES = 1_000
#: A task starts a new file after this many bytes.
FILE_BYTES = 128 << 20
#: End of the name of a list of files.
LIST = ".warc-files"
#: First line of a record.
VERSION = b"WARC/1.1"
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _hex(digest: str) -> str:
    """Lower-case hex of a ``sha1:`` digest in base 32."""
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _header_value(text: str) -> str:
    """A header line cannot hold line ends or other control characters: they are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in text)


def record(row: Row) -> bytes:
    """One WARC record: headers, then an HTTP header block, then the payload if it is a response."""
    payload = bytes(row.payload or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row.payload_bytes
    revisit = row.record_type == "revisit"
    block = http if revisit else http + payload
    head = {
        "WARC-Type": row.record_type,
        "WARC-Record-ID": f"<{row.record_id}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": _header_value(row.target_uri or ""),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row.payload_digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{row.refers_to}>"}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for row in rows:
            if out is None or size >= FILE_BYTES:
                if out is not None:
                    out.close()
                files.append(posixpath.join(base, f"{uuid.uuid4().hex}.warc"))
                out, size = store.open_output_stream(files[-1], buffer_size=1 << 20), 0
            data = record(row)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One list names the files of the tasks that succeeded, so retried tasks leave no records behind.

        It is written aside and then renamed, the only rename of a write, however many files there are.
        """
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        listed = posixpath.join(base, uuid.uuid4().hex + LIST)
        with store.open_output_stream(listed + ".open") as out:
            for message in messages:
                for file in message.files if message else ():
                    out.write(posixpath.basename(file).encode() + b"\n")
        store.move(listed + ".open", listed)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for file in message.files if message else ():
                store.delete_file(file)


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads
        self.wanted: dict[str, set[str]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and IS NOT NULL on header columns are applied here; the rest goes back to Spark."""
        header = {"record_id", "record_type", "target_uri", "refers_to", "payload_digest"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in header:
                self._want(column, {f.value})
            elif isinstance(f, In) and column in header:
                self._want(column, set(f.value))
            elif isinstance(f, IsNotNull) and column in header:
                self.present.add(column)
            else:
                yield f

    def _want(self, column: str, values: set[str]) -> None:
        self.wanted[column] = self.wanted[column] & values if column in self.wanted else values

    def partitions(self) -> list[InputPartition]:
        """The files that the lists of the folder name; all of them in a folder without a list, made by other programs."""
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base))
        names: set[str] = set()
        lists = [f.path for f in found if f.path.endswith(LIST)]
        for path in lists:
            with store.open_input_file(path) as listed:
                names |= set(listed.read().decode().split())
        files = [f for f in found if f.path.endswith(".warc") and (not lists or posixpath.basename(f.path) in names)]
        if lists and len(files) < len(names):
            raise FileNotFoundError(f"files of {self.path} that its lists name are missing")
        return [WarcFile(f.path) for f in sorted(files, key=lambda f: (-f.size, f.path))]

    def read(self, partition: InputPartition | None) -> Iterator[tuple[Any, ...]]:
        if partition is None:  # a folder without files
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as raw:
            yield from self._records(raw)

    def _records(self, raw: BinaryIO) -> Iterator[tuple[Any, ...]]:
        reader = _Lines(raw)
        while (head := reader.headers()) is not None:
            first, fields = head
            if first != VERSION:
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            length = int(fields["content-length"])
            row = {
                "record_id": fields["warc-record-id"].strip("<>"),
                "record_type": fields["warc-type"],
                "target_uri": fields.get("warc-target-uri"),
                "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                "payload_digest": _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None,
            }
            passes = all(row[c] in v for c, v in self.wanted.items()) and all(row[c] is not None for c in self.present)
            start = reader.at
            if passes:
                _, http = reader.headers()
                size = int(http.get("content-length", 0))
                own = start + length - reader.at
                payload = reader.take(own) if self.payloads and row["record_type"] != "revisit" else None
                yield *row.values(), size, payload
            reader.seek(start + length + 4)


class _Lines:
    """Buffered reading of header lines, payloads and jumps over what is not wanted."""

    def __init__(self, raw: BinaryIO, size: int = 1 << 18):
        self.raw, self.size, self.buffer, self.base, self.at = raw, size, b"", 0, 0

    def _fill(self, upto: int) -> bool:
        while self.base + len(self.buffer) < upto:
            more = self.raw.read(max(self.size, upto - self.base - len(self.buffer)))
            if not more:
                return False
            self.buffer = self.buffer[self.at - self.base :] + more
            self.base = self.at
        return True

    def headers(self) -> tuple[bytes, dict[str, str]] | None:
        """The first line and the fields up to an empty line; None at the end of the file."""
        while (end := self.buffer.find(b"\r\n\r\n", self.at - self.base)) < 0:
            if not self._fill(self.base + len(self.buffer) + 1):
                if self.buffer[self.at - self.base :]:
                    raise ValueError("the file ends within a header")
                return None
        lines = self.buffer[self.at - self.base : end].split(b"\r\n")
        self.at = self.base + end + 4
        pairs = (line.decode().partition(":") for line in lines[1:])
        return lines[0], {k.strip().lower(): v.strip() for k, _, v in pairs}

    def take(self, size: int) -> bytes:
        if not self._fill(self.at + size):
            raise ValueError("the file ends within a record")
        start = self.at - self.base
        self.at += size
        return self.buffer[start : start + size]

    def seek(self, to: int) -> None:
        if to > self.base + len(self.buffer):
            self.raw.seek(to)
            self.buffer, self.base = b"", to
        self.at = to


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", folder)``; option ``payloads`` false reads headers alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One record for each row of ``page_id``, ``url``, ``html``: the payload is the html in UTF-8 (null: empty).

    Of records with equal payloads of at least ``revisit_bytes`` the one of the largest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses too, as are smaller payloads. A null page_id comes
    before all others; without any other id every row of the payload is a response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    made = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).select(
        "page_id", "target_uri", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), F.unhex(F.sha2("payload", 256)).alias("same"),
    )
    large = made.where(F.col("payload_bytes") >= revisit_bytes)
    # Only repeated payloads have a row here; equality is judged by SHA-256 and length. The table is stored, so that
    # the planner knows its size: if it is small, it is broadcast and no payload is shuffled.
    heads = stored(
        large.groupBy(F.col("same").alias("of"), F.col("payload_bytes").alias("long"))
        .agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
        .where("n > 1")
        .select("of", "long", "head"),
        "warc-heads",
    )
    joined = made.join(heads, (made["same"] == heads["of"]) & (made["payload_bytes"] == heads["long"]), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, urn("head")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC files to the shared folder and read the records back: responses with their payloads, revisits
    by their headers. Each read passes over the other's records, by the type that its predicate asks for."""
    spark = pages.sparkSession
    register(spark)
    path = shared_path(spark, "warc")
    records(pages).write.format("warc").option("path", path).mode("append").save()
    kept = spark.read.format("warc").option("path", path)
    responses = kept.load().where("record_type = 'response'")
    return responses.union(kept.option("payloads", "false").load().where("record_type = 'revisit'"))


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every record read back.

    Size and digest of a response are those of the payload that was read, those of a revisit come from its headers.
    """
    read = round_trip(pages)
    response = F.col("record_type") == "response"
    page = lambda c: F.nullif(F.expr(f"substring({c}, 10)"), F.lit("")).cast(pages.schema["page_id"].dataType)
    return read.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


#: The same as SQL.
RECORDS_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, payload, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
FROM q
"""
