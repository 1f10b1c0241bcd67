"""WARC archives, written with an index and read back by coalesced byte ranges.

Each page is a record of its own gzip member in an archive below the shared folder. Of pages whose
payloads are equal and of at least ``least_bytes``, the one with the smallest id is written as a
response and the others as revisits that refer to it and carry no payload. The index (archive,
offset, length, url, digest) is written in the same pass. To read records, their index rows
are dealt out by archive, sorted by offset and merged into ranges; a range is read at once.

Archives are reached through ``pyarrow.fs`` by the URI of the shared folder. A task writes to a name of
its own attempt, and only the index rows of the attempt that Spark accepts count, so lost
executors and repeated tasks leave no record twice.

Null html is an empty payload, null urls are written empty. Rows with one page_id stay: a row that
equals the response in id and payload is a response too. A null page_id sorts after others: such a page is a
response only if its payload has no page with an id. An empty table gives no archive and no row.
Other columns of the input do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.tables import written
from orderflow.sources.shared_folder import new_folder

ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 8 << 20
RANGE_GAP = 64 << 10

INDEX = (
    "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, refers_to bigint, "
    "archive string, offset bigint, length bigint"
)
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"

_DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the path there; s3a is s3."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit if ``refers_to`` is given, as one gzip member."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        payload = b""
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Page, type and payload of a gzip member; a response's digest is computed from its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(payload) != int(fields["Content-Length"]) or rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
    if fields["WARC-Type"] == "response" and digest_of(payload) != stated:
        raise ValueError(f"payload of page {page} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers.removeprefix("<urn:page:").rstrip(">")) if refers else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each page below ``folder`` and return the written index."""
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("bigint")})
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first_page"))
    # the digests of all pages are as many as the pages: texts move once to meet them
    dealt = rows.join(first.hint("merge"), ["sha", "size"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        context = TaskContext.get()
        number, out, name, at = 0, None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, first_page in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first_page"))):
                    page_id, url, first_page = page_id.as_py(), url.as_py(), first_page.as_py()
                    payload = html.as_buffer().to_pybytes()
                    if out is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                        out, at, number = system.open_output_stream(f"{path}/{name}", compression=None), 0, number + 1
                    refers_to = first_page if first_page is not None and first_page != page_id else None
                    digest = digest_of(payload)
                    record = record_bytes(page_id, url, payload, digest, refers_to)
                    out.write(record)
                    index.append((page_id, url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to, f"{folder}/{name}", at, len(record)))
                    at += len(record)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                if index:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    system, path = file_system(folder)
    system.create_dir(path)
    return written(dealt.select("page_id", "url", "html", "first_page").mapInArrow(write, INDEX), "warc_index")


def ranges(offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of sorted records that are read at once: close to each other, and not too long."""
    first = 0
    for k in range(1, len(offsets) + 1):
        if (
            k == len(offsets)
            or offsets[k] > offsets[k - 1] + lengths[k - 1] + RANGE_GAP
            or offsets[k] + lengths[k] - offsets[first] > RANGE_BYTES
        ):
            yield first, k
            first = k


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the index rows, read from the archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            archive = np.array(batch.column("archive").to_pylist(), dtype=object)
            offset, length = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            cuts = [0, *(np.flatnonzero(archive[1:] != archive[:-1]) + 1), len(archive)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                system, path = file_system(archive[a])
                with system.open_input_file(path) as source:
                    for i, j in ranges(offset[a:b], length[a:b]):
                        i, j = a + i, a + j
                        data = source.read_at(int(offset[j - 1] + length[j - 1] - offset[i]), int(offset[i]))
                        found = [parse_record(data[o : o + n]) for o, n in zip((offset[i:j] - offset[i]).tolist(), length[i:j].tolist())]
                        if not with_payload:
                            for x in found:
                                x["payload"] = None
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds)], names)

    return (
        index.select("archive", "offset", "length")
        .repartition("archive")
        .sortWithinPartitions("archive", "offset")
        .mapInArrow(read, RECORDS)
    )


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What the archives hold for each page after writing all of them."""
    index = write_archives(pages, f"{new_folder(pages.sparkSession, 'warc')}", least_bytes)
    return read_records(index, with_payload=False).drop("payload")
