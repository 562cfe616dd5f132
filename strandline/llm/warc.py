"""WARC archives with an index: pages are written as records, and records are read back by coalesced byte ranges.

Each task writes archives of its own into a shared folder, one gzip member per record, and returns an index row per
record: archive, offset, length, URL and digest. The index is a table; a reader takes the rows it wants, puts them in
the order of the archives, joins neighbouring byte ranges into one read and parses the records in it. A task that is
run again writes a new archive, and only the archive named by the index counts.

The folder has to be in a store that ``pyarrow.fs`` opens (a mounted path, HDFS, S3, GCS, Azure).

A null payload counts as empty. A null URL is left out of the record. Control characters and spaces of a URL are
percent-encoded. Rows that repeat a ``page_id`` get a record each and are decided alike; a null ``page_id`` is no
target of a revisit unless all copies of the payload have none, and then they are all responses. Other columns are not
read. An empty table gives an empty index.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import with_group_totals
from strandline.sources.shared import shared_folder, stored

ARCHIVE_BYTES = 256 << 20
#: Unwanted bytes between two records that are read rather than skipped, and the most that one read returns.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: What one task reads at least in a row, and in all.
RANGE_BYTES, TASK_BYTES = 4 * READ_BYTES, 128 << 20
DATE = "2024-01-01T00:00:00Z"
_GZIP = 31
_URN = "urn:x-page:"

INDEX = (
    "archive string, offset bigint, length bigint, page_id bigint, url string, payload_bytes bigint,"
    " payload_digest string, record_type string, refers_to bigint"
)
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.0 record: a response with its payload, or a revisit that has only the headers."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_URN}{page_id}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        fields += [
            ("WARC-Refers-To", f"<{_URN}{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _page(urn: str | None) -> int | None:
    number = urn and urn[len(_URN) + 1 : -1]
    return None if number in (None, "None") else int(number)


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def decide(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, payload_sha256, refers_to) of the pages whose payload an earlier ``page_id`` has.

    Payloads are equal if their length and SHA-256 are. ``pages`` has payload_sha256 and payload_bytes.
    """
    rows = stored(pages.filter(F.col("payload_bytes") >= min_revisit_bytes).select(
        "page_id", "payload_sha256", "payload_bytes"
    ), "payloads")
    totals = {"refers_to": (F.min("page_id"), F.min)}
    first = with_group_totals(rows, ["payload_sha256", "payload_bytes"], ["page_id"], totals)
    later = first.filter("refers_to is not null and not (page_id <=> refers_to)")
    return later.select("page_id", "payload_sha256", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns the index, stored beside the archives."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_sha256", F.sha2("payload", 256))
    later = decide(rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")), min_revisit_bytes)
    later = later.withColumnsRenamed({"page_id": "__page", "payload_sha256": "__sha256"})
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_sha256") == F.col("__sha256"))
    planned = rows.join(later, same, "left").select("page_id", "url", "payload", "refers_to")
    return stored(planned.mapInArrow(_writer(folder), INDEX), "warc-index")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name = None, ""
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is not None and out.tell() >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                    record = make_record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                    packed = packer.compress(record) + packer.flush()
                    index.append({
                        "archive": f"{folder}/{name}", "offset": out.tell(), "length": len(packed),
                        "page_id": row["page_id"], "url": row["url"], "payload_bytes": len(row["payload"]),
                        "payload_digest": digest(row["payload"]), "refers_to": row["refers_to"],
                        "record_type": "response" if row["refers_to"] is None else "revisit",
                    })
                    out.write(packed)
                yield pa.RecordBatch.from_pylist(index, _INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return write


_LONG, _TEXT = pa.int64(), pa.string()
_RECORD_FIELDS = [
    ("page_id", _LONG), ("url", _TEXT), ("payload_bytes", _LONG), ("payload_digest", _TEXT), ("record_type", _TEXT),
    ("refers_to", _LONG),
]
_INDEX_SCHEMA = pa.schema([("archive", _TEXT), ("offset", _LONG), ("length", _LONG), *_RECORD_FIELDS])


def coalesce_ranges(rows: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, list]]:
    """(archive, start, [(offset, length)]) of sorted records: neighbours at most ``gap`` apart share a read."""
    archive, start, end, members = None, 0, 0, []
    for name, offset, length in rows:
        if members and (name != archive or offset - end > gap or offset + length - start > most):
            yield archive, start, members
            members = []
        if not members:
            archive, start = name, offset
        members.append((offset, length))
        end = offset + length
    if members:
        yield archive, start, members


def _readers(selected: DataFrame) -> int:
    """Tasks by the bytes that they read: index rows are small, so adaptive execution would leave all to a few."""
    size = selected.agg(F.sum("length")).first()[0] or 0
    return max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def read_records(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records named by index rows (archive, offset, length), read in the order of the archives.

    An archive is cut into ranges of ``RANGE_BYTES``, so that tasks share a large one. One job sums up the lengths first.

    Response payloads are checked against their digest. ``payload`` is null for revisits.
    """
    rows = selected.select("archive", "offset", "length")
    share = F.floor(F.col("offset") / RANGE_BYTES)
    ordered = rows.repartition(_readers(rows), "archive", share).sortWithinPartitions("archive", "offset")
    schema = RECORD + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row for b in batches for row in zip(b["archive"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist())
        )
        opened, source = None, None
        for archive, start, members in coalesce_ranges(rows, GAP_BYTES, READ_BYTES):
            if archive != opened:
                store, path = _store(archive)
                opened, source = archive, store.open_input_file(path)
            last_offset, last_length = members[-1]
            data = source.read_at(last_offset + last_length - start, start)
            found = [
                _row(zlib.decompress(data[offset - start : offset - start + length], _GZIP), with_payload)
                for offset, length in members
            ]
            yield pa.RecordBatch.from_pylist(
                found, pa.schema(_RECORD_FIELDS + [("payload", pa.binary())] * with_payload)
            )

    return ordered.mapInArrow(read, schema)


def _row(record: bytes, with_payload: bool) -> dict:
    fields, http, payload = parse_record(record)
    response = fields["WARC-Type"] == "response"
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and digest(payload) != found:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have its digest")
    row = {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if response else int(http["Content-Length"]),
        "payload_digest": found,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")),
    }
    return row | ({"payload": payload if response else None} if with_payload else {})


def archive_and_read(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes all pages into the shared folder and reads every record back."""
    index = write_archives(pages, shared_folder(pages.sparkSession, "archives"), min_revisit_bytes)
    return read_records(index)
