"""WARC archives with an index: written in tasks, and read back by coalesced byte ranges.

Method: each task writes its pages as WARC/1.1 records, one gzip member each, to
files of its own in a shared folder, and returns an index row for each record:
file, offset, length, URL and payload digest. The index is a Parquet table, and
only files named in it count, so a repeated task leaves at most unread files. To
read, index rows are selected like any table, grouped by file and stretch,
sorted by offset, and neighbouring records are fetched with one ranged read.

Of records with equal payloads the one with the smallest page_id is a response;
the others are revisits that carry the digest, the length and no payload. Which
record is first is found on digests alone.

Folders may be in any file system that pyarrow can open by URI.

Defined cases: a null payload is empty, and a null URL is written as
urn:page:<id>; empty payloads are equal to each other; rows that repeat the
smallest page_id of a payload are responses all; rows with a null page_id and
payloads without any other id are responses; an empty table writes no file; other
columns of the table are left out.
"""

from __future__ import annotations

import base64
import gzip
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small_batches, table

FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
TASK_BYTES = 32 << 20
GAP_BYTES = 64 << 10
DATE = "2020-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_of_hex(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def target_uri(page_id: int | None, url: str | None) -> str:
    """The URL without blanks and control characters, or a name of the page."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """Made from the page alone, so that a revisit can name the response without having seen it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{target_uri(page_id, url)}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP header only, which names the response of the page refers_to."""
    revisit = refers_to is not None
    target = target_uri(page_id, url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        *([
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {target_uri(refers_to, refers_url)}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {refers_to}",
        ] if revisit else []),
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches, folder: str, file_bytes: int, date: str):
    """Rows page_id, url, payload, sha1, refers_to, refers_url; returns index rows."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    out, name, at = None, "", 0
    try:
        for batch in batches:
            ids, urls, payloads, shas, refs, ref_urls = (batch.column(i).to_pylist() for i in range(6))
            rows: dict[str, list] = {f.name: [] for f in schema}
            for page_id, url, payload, sha, ref, ref_url in zip(ids, urls, payloads, shas, refs, ref_urls, strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0  # another name for each attempt
                    out = store.open_output_stream(name, compression=None)
                digest, data = base32_of_hex(sha), payload or b""
                packed = gzip.compress(record(page_id, url, data, len(data), digest, ref, ref_url, date), 5, mtime=0)
                out.write(packed)
                for key, value in (("file", name), ("offset", at), ("length", len(packed)), ("page_id", page_id), ("url", url), ("digest", digest), ("record_type", "response" if ref is None else "revisit")):
                    rows[key].append(value)
                at += len(packed)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
    finally:
        if out is not None:
            out.close()


def write_archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = DATE, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write all pages to `folder`; returns the index. least: smaller payloads are responses, equal or not."""
    small_batches(pages.sparkSession)
    data = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), data.alias("payload"), F.sha1(data).alias("sha1"))
    # Only digests are grouped; a payload moves once, to meet the first id of its digest if it has equals.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    equal = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    equal = materialize(equal.select("sha1", "first"), "equals")
    joined = rows.join(equal, "sha1", "left")
    later = (F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    marked = joined.select("page_id", "url", "payload", "sha1", F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.url")).alias("refers_url"))
    return materialize(marked.mapInArrow(partial(_write, folder=folder, file_bytes=file_bytes, date=date), INDEX), "index")


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def ranges(places: list[tuple[int, int]], gap: int, most: int) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) in runs that one read fetches: gaps of at most `gap` bytes, `most` bytes together unless a record is larger."""
    out: list[list[tuple[int, int]]] = []
    for a, n in sorted(places):
        if out and a - sum(out[-1][-1]) <= gap and a + n - out[-1][0][0] <= most:
            out[-1].append((a, n))
        else:
            out.append([(a, n)])
    return out


def _read(batches, folder: str, gap: int, most: int, payloads: bool):
    """Rows file, places (array of offset and length); returns a row for each record."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])])
    import hashlib

    store, _ = _store(folder)
    for batch in batches:
        for name, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_file(name) as source:
                for run in ranges([(p["offset"], p["length"]) for p in places], gap, most):
                    first = run[0][0]
                    data = source.read_at(sum(run[-1]) - first, first)
                    rows: dict[str, list] = {f.name: [] for f in schema}
                    for a, n in run:
                        fields, http, payload = parse(gzip.decompress(data[a - first : a - first + n]))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = fields["WARC-Type"] == "response"
                        if whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name} at {a}: the payload doesn't have its digest")
                        size = len(payload) if whole else int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows["page_id"].append(int(fields["WARC-Page-ID"]) if "WARC-Page-ID" in fields else None)
                        rows["url"].append(fields["WARC-Target-URI"])
                        rows["record_type"].append(fields["WARC-Type"])
                        rows["payload_bytes"].append(size)
                        rows["payload_digest"].append(digest)
                        rows["refers_to"].append(int(fields["WARC-Refers-To-Page-ID"]) if not whole else None)
                        if payloads:
                            rows["payload"].append(payload if whole else None)
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)


def read_archive(index: DataFrame, folder: str, payloads: bool = False, gap: int = GAP_BYTES, most: int = READ_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that `index` has rows of: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked for (null for revisits).

    The bytes that the selected records have, not the size of their index, decide how many tasks read; a task gets whole stretches of `most` bytes.
    """
    small_batches(index.sparkSession)
    wanted = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-wanted // task_bytes))
    dealt = index.withColumn("stretch", F.floor(F.col("offset") / most)).repartition(tasks, "file", "stretch")
    stretches = dealt.groupBy("file", "stretch").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    return stretches.select("file", "places").mapInArrow(partial(_read, folder=folder, gap=gap, most=most, payloads=payloads), schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files in the shared folder and read back through the index."""
    folder = fresh_path(spark, "warc")
    found = read_archive(write_archive(table(spark, sf_dir, "pages"), folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
