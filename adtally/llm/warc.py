"""Web archives as a Python data source: records written with payload revisits, read headers first."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

#: What a record has. ``payload`` is null for revisits, whose block is the HTTP head alone.
RECORD_SCHEMA = (
    "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary"
)
HEADER_COLUMNS = ("page_id", "record_type", "target_uri", "refers_to", "payload_digest")
# Fixed values of the archive format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_OF_HEAD, END_OF_RECORD = b"\r\n\r\n", b"\r\n\r\n"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")
_LINE_ENDS = re.compile(r"[\r\n]+")


def archive_records(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url",
                    html_column: str = "html") -> DataFrame:
    """One record per row of ``pages``: a response, or a revisit of the response with an equal payload.

    Among payloads of at least ``least_bytes`` bytes that are equal, the row with the largest
    id is the response. A null text is an empty payload; an id that is null is smaller than
    any other. Rows that repeat a response's id and payload are responses as well. Other
    columns are left out.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("target_uri"),
        F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # A third of all rows may share one payload: what is shuffled here is a digest and an id per task.
    firsts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.lit(True).alias("shared")
    )
    joined = rows.join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    revisit = revisit & (F.col("payload_bytes") >= least_bytes)
    return joined.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, F.col("first")).alias("refers_to"), F.col("digest").alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def use_warc(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark offer it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", roll_bytes: int = 64 << 20,
               date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``archive_records`` rows as archive files of about ``roll_bytes`` into a new folder."""
    use_warc(records.sparkSession)
    options = {"compression": compression, "rollBytes": roll_bytes, "date": date}
    records.write.format("warc").mode("append").options(**options).save(qualified(records.sparkSession, path))


def read_warc(spark: SparkSession, path: str, columns: str = RECORD_SCHEMA, verify: bool = False) -> DataFrame:
    """Records of all archives in a folder.

    Only the columns of the schema ``columns`` are made: without ``payload`` no payload is
    decoded, unless ``verify`` asks for their digests to be checked. Filters on header columns
    (equality, a list, a prefix, not null) are answered from the headers before a payload is.
    """
    use_warc(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(qualified(spark, path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: one without a scheme is on the cluster's own, which tasks cannot look up."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list


def record_head(row: dict, date: str) -> bytes:
    """The named fields of a record, up to and with the empty line."""
    http = http_head(row["payload_bytes"])
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    fields = [
        VERSION,
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{row['page_id'] if row['page_id'] is not None else 'none'}>",
        f"WARC-Date: {date}",
    ]
    if row["target_uri"] is not None:
        fields.append(f"WARC-Target-URI: {_LINE_ENDS.sub(' ', row['target_uri'])}")
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if row["record_type"] == "revisit":
        fields.append(f"WARC-Profile: {PROFILE}")
        if row["refers_to"] is not None:
            fields.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
    length = len(http) + len(row["payload"] or b"")
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(fields).encode() + END_OF_HEAD


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with the format's skip lengths, so a reader can pass it without inflating."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + total.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little")


class WarcWriter(DataSourceArrowWriter):
    """Each attempt writes files under names of its own; commit moves those of the attempts that count."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.packed = options.get("compression", "gzip") == "gzip"
        self.roll_bytes = int(options.get("rollbytes", options.get("rollBytes", 64 << 20)))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        system, root = _files(self.path)
        system.create_dir(f"{root}/_attempts", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = system.open_output_stream(f"{root}/_attempts/{names[-1]}", compression=None), 0
                    record = record_head(row, self.date) + http_head(row["payload_bytes"]) + (row["payload"] or b"") + END_OF_RECORD
                    record = member(record) if self.packed else record
                    out.write(record)
                    size += len(record)
                    if size >= self.roll_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return WrittenFiles(names)

    def commit(self, messages) -> None:
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{root}/_attempts/{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        system, root = _files(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.delete_file(f"{root}/_attempts/{name}")


@dataclass
class Archives(InputPartition):
    paths: list


class _Window:
    """Bytes of a file by place, read a stretch at a time."""

    def __init__(self, file, stretch: int = 1 << 18) -> None:
        self.file, self.stretch, self.size = file, stretch, file.size()
        self.at, self.held = 0, b""

    def get(self, at: int, count: int) -> bytes:
        if not (self.at <= at and at + count <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(count, self.stretch), self.size - at), at)
        return self.held[at - self.at : at - self.at + count]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path = options["path"].rstrip("/")
        self.verify = options.get("verify", "false") == "true"
        self.fields = [field.name for field in schema.fields]
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for test in filters:
            name = getattr(test, "attribute", ("",))[0]
            if name not in HEADER_COLUMNS:
                yield test
            elif isinstance(test, EqualTo):
                self.tests.append((name, "in", (test.value,)))
            elif isinstance(test, In):
                self.tests.append((name, "in", tuple(v for v in test.value if v is not None)))
            elif isinstance(test, StringStartsWith):
                self.tests.append((name, "prefix", test.value))
            elif isinstance(test, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield test

    def partitions(self, task_bytes: int = 64 << 20) -> list[Archives]:
        """Whole files, small ones together up to ``task_bytes``."""
        system, root = _files(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        groups, size = [[]], 0
        for info in sorted((f for f in found if f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if groups[-1] and size + info.size > task_bytes:
                groups.append([])
                size = 0
            groups[-1].append(info.path)
            size += info.size
        return [Archives(g) for g in groups]

    def passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or kind == "in" and own not in value or kind == "prefix" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(name, kinds.get(name, pa.string())) for name in self.fields])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in self.records(file):
                    rows.append({name: row[name] for name in self.fields})
                    size += 200 + len(row["payload"] or b"") * ("payload" in self.fields)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, file) -> Iterator[dict]:
        """Rows of an archive file: heads first, blocks of wanted records only."""
        window, at = _Window(file), 0
        wants_payload = "payload" in self.fields or self.verify
        wants_block = wants_payload or "payload_bytes" in self.fields
        while at < window.size:
            packed = window.get(at, 2) == b"\x1f\x8b"
            if packed:
                source, skip = self._inflated(window, at)
            else:
                source, skip = self._plain(window, at), None
            head = source(END_OF_HEAD, None)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
            length = int(fields["Content-Length"])
            after = at + skip if packed and skip else at + len(head) + length + len(END_OF_RECORD)
            page, refers = _PAGE.match(fields.get("WARC-Record-ID", "")), _PAGE.match(fields.get("WARC-Refers-To", ""))
            row = {
                "page_id": int(page[1]) if page else None,
                "record_type": fields["WARC-Type"],
                "target_uri": fields.get("WARC-Target-URI"),
                "refers_to": int(refers[1]) if refers else None,
                "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                "payload_bytes": None,
                "payload": None,
            }
            wanted = self.passes(row)
            if wanted and wants_block:
                http = source(END_OF_HEAD, None)
                found = re.search(rb"Content-Length: (\d+)", http)
                row["payload_bytes"] = int(found[1]) if found else length - len(http)
                if wants_payload and row["record_type"] == "response":
                    row["payload"] = source(None, length - len(http))
                    if self.verify:
                        digest = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                        if digest != row["payload_digest"] or len(row["payload"]) != row["payload_bytes"]:
                            raise ValueError(f"record of page {row['page_id']} does not match its digest")
            if packed and not skip:
                # A member without skip lengths has to be inflated to its end.
                after = at + source(None, None)
            if wanted:
                yield row
            at = after

    @staticmethod
    def _plain(window: _Window, at: int):
        def take(until: bytes | None, count: int | None) -> bytes:
            nonlocal at
            if until is None:
                found = window.get(at, count)
            else:
                reach = 4096
                while (place := window.get(at, min(reach, window.size - at)).find(until)) < 0:
                    if at + reach >= window.size:
                        raise ValueError("a record's head has no end")
                    reach *= 4
                found = window.get(at, place + len(until))
            at += len(found)
            return found

        return take

    @staticmethod
    def _inflated(window: _Window, start: int):
        """What takes bytes from the member at ``start``, and the member's length if its header has it."""
        head = window.get(start, min(24, window.size - start))
        marked = len(head) == 24 and head[3] & 4 and head[12:14] == b"sl"
        skip = int.from_bytes(head[16:20], "little") if marked else None
        machine, at, ready = zlib.decompressobj(16 + zlib.MAX_WBITS), start, b""

        def more(least: int) -> bool:
            nonlocal at, ready
            if machine.eof or at >= window.size:
                return False
            limit = window.size - at if skip is None else start + skip - at
            raw = window.get(at, min(max(least // 4, 2048), limit))
            ready += machine.decompress(raw)
            at += len(raw) - len(machine.unused_data)
            return True

        def take(until: bytes | None, count: int | None):
            nonlocal ready
            if until is None and count is None:
                while more(1 << 16):
                    ready = b""
                return at - start
            while (ready.find(until) < 0) if until is not None else (len(ready) < count):
                if not more(count or 0):
                    raise ValueError("an archive record ends too soon")
            size = ready.find(until) + len(until) if until is not None else count
            found, ready = ready[:size], ready[size:]
            return found

        return take, skip
