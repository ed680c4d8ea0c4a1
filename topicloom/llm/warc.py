"""WARC archives: an index first, then coalesced byte-range reads of the selected records.

Writing: a task streams its pages into one archive of gzip members (one record
each) in the shared folder, through pyarrow's file systems, and returns an index
row per record: file, offset, length, url, digest. A retried task writes a new
file, and only the index rows of the task that succeeded count, so a lost executor
leaves at most a file that no index row names. The index is materialised before
anything is read.

Of the records with equal payloads of at least min_bytes, the one with the largest
page_id is a response and the others are revisits of it. Payloads meet by digest
in two narrow steps (largest page_id for each digest, then only digests with
several records), so a hot payload is pre-aggregated and its pages are never
gathered.

Reading: selected index rows are dealt out by file and stretch of bytes, sorted by
offset, and neighbouring records are fetched by one range read. Payloads are
checked against their digests.

Defined results: null html is an empty payload; rows that tie for the largest
page_id are all responses; a null page_id counts as the smallest; a null url is
written empty and read back null. Line breaks in a url are percent-encoded in the
header; the index holds the url itself. Repeated rows are records of their own, an
empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._spark import cut, partitions, shared_dir, small_batches, tidy

#: Records this near are fetched by one read, of at most READ bytes; a task reads STRETCH of a file.
GAP, READ, STRETCH = 1 << 16, 4 << 20, 32 << 20
#: Repeated digests up to this many are broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long, payload_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload block."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace('%0D', '%250D').replace('%0A', '%250A').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return fields, rest[:n]


def _writer(folder: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        at, name = 0, f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                rows = batch.to_pydict()
                offsets, lengths, digests, sizes, kinds = [], [], [], [], []
                for page, url, html, to in zip(rows["page_id"], rows["url"], rows["html"], rows["refers_to"], strict=True):
                    if out is None:
                        fs, path = pafs.FileSystem.from_uri(folder)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
                    payload = (html or "").encode()
                    digest = payload_digest(payload)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, digest, to, to is not None)) + packer.flush()
                    out.write(member)
                    offsets.append(at), lengths.append(len(member)), digests.append(digest), sizes.append(len(payload)), kinds.append("response" if to is None else "revisit")
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), batch.column("refers_to"), pa.array(sizes, pa.int64())],
                    ["page_id", "url", "file", "offset", "length", "digest", "record_type", "refers_to", "payload_bytes"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under folder (a URI, by default in the shared folder); returns their index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if ":" not in folder.split("/")[0]:  # a path without a scheme is one of the cluster's default file system, as for Spark's own writers
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        folder = f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and not folder.startswith("file://") else folder
    pages = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("_sha"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("_n"))
    twice = cut(pages.filter(F.col("_n") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count("*").alias("_rows")).filter("_rows > 1 and _last is not null").select("_sha", "_last"))
    earlier = F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))
    if twice.count() <= BROADCAST_ROWS:
        pages, last = pages.join(F.broadcast(twice), "_sha", "left"), F.col("_last")
    else:  # pages are shuffled by their own id, so a digest that many share brings only ids together
        page = F.coalesce(F.col("page_id"), F.lit(-(2**63)))
        ids = pages.select("page_id", "_sha").distinct().join(twice, "_sha").filter(earlier).select(page.alias("_p"), F.col("_sha").alias("_s"), "_last")
        pages, last = pages.join(cut(ids), (page == F.col("_p")) & (F.col("_sha") == F.col("_s")), "left"), F.col("_last")
    to = F.when((F.col("_n") >= min_bytes) & earlier, last)
    rows = pages.select("page_id", "url", "html", to.alias("refers_to"))
    return cut(rows.mapInArrow(_writer(folder), INDEX))


@tidy
def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fetch(rows: list[dict]) -> pa.RecordBatch:
        fs, path = pafs.FileSystem.from_uri(rows[0]["file"])
        out = []
        with fs.open_input_file(path) as f:
            first, last = rows[0]["offset"], max(r["offset"] + r["length"] for r in rows)
            f.seek(first)
            data = f.read(last - first)
        for r in rows:
            at = r["offset"] - first
            fields, block = parse(zlib.decompress(data[at : at + r["length"]], 31))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
            if digest != r["digest"] or kind == "response" and (payload_digest(block) != digest or len(block) != size):
                raise ValueError(f"the record of page {r['page_id']} does not have the payload of its digest")
            page = fields["X-Page-Id"]
            out.append((int(page) if page else None, r["url"], size, digest, kind, int(fields["X-Refers-To-Page-Id"]) if kind == "revisit" else None, block if kind == "response" else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and (r["file"] != rows[-1]["file"] or r["offset"] > rows[-1]["offset"] + rows[-1]["length"] + GAP or r["offset"] + r["length"] - rows[0]["offset"] > READ):
                yield fetch(rows)
                rows = []
            rows.append(r)
    if rows:
        yield fetch(rows)


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index rows name; a revisit has no payload of its own."""
    spark = index.sparkSession
    dealt = index.select("page_id", "url", "file", "offset", "length", "digest").repartition(partitions(spark), "file", F.expr(f"offset div {STRETCH}"))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(_reader, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes all pages, reads all records back."""
    return read_records(write_archives(pages, folder, min_bytes))
