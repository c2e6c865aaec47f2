"""WARC archives with an index, read back by coalesced byte ranges.

Every task writes its rows as one gzip member per record to archives of its own and returns the
index rows (file, offset, length, URL, digest). The index is a table that Spark commits: an archive
of a task that was lost or ran twice is simply not in it. A reader sorts the index rows it
wants, joins neighbouring ranges into few large reads, and opens only those bytes.

Archives go through ``pyarrow.fs``, which knows file, s3, gs and hdfs folders.
"""

import hashlib
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import text_blocks
from itemweld.sources.staging import Stages

REVISIT_FROM = 1000              # payloads of fewer bytes are always stored
ARCHIVE_BYTES = 1 << 30
GAP, RANGE = 64 << 10, 8 << 20   # bytes between records worth reading over; largest single read
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
         "refers_to long, file string, offset long, length long")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(folder: str):
    """File system and path of a folder URI."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def header_value(text) -> str:
    return "" if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, uncompressed. A response carries an HTTP head and the payload; a
    revisit carries only its headers and names the response it repeats."""
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Target-URI: {header_value(url)}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "
                 + str(len(payload)).encode() + b"\r\n\r\n" + payload)
        lines += ["WARC-Type: response", "Content-Type: application/http;msgtype=response"]
    else:
        block = b""
        lines += ["WARC-Type: revisit", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes):
    """(headers, payload) of one record; the payload of a revisit is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                   for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else b""


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_number(urn: str):
    value = urn[len("<urn:x-page:"):-1]
    return None if value == "None" else int(value)


def write(pages: DataFrame, folder: str, *, page_id="page_id", url="url", html="html", archive_bytes=ARCHIVE_BYTES,
          stages=None) -> DataFrame:
    """Writes a record per row below ``folder`` and returns the stored index.

    The payload is the html in UTF-8 (null: empty). Among rows with equal payloads of at least 1000
    bytes, those with the largest page_id are responses, the others revisits of it; rows
    with a null page_id revisit too, unless all of the group are null. Line breaks in a URL are
    percent-encoded, a null URL is stored empty. An empty table gives an empty index.
    """
    stages = stages or Stages(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.cast("binary").alias("payload"))
    digest, size = F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")
    repeated = stages.save(
        rows.select("page_id", digest, size).where(f"size >= {REVISIT_FROM}").groupBy("digest", "size")
            .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
            .drop("copies"), "repeated")
    planned = (rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
               .join(repeated, ["digest", "size"], "left")
               .select("page_id", "url", "payload", "digest",
                       F.expr("CASE WHEN page_id = original THEN NULL ELSE original END").alias("refers_to")))

    def run(batches):
        context = TaskContext.get()
        system, base = store(folder)
        system.create_dir(base, recursive=True)
        stem = f"archive-{context.partitionId():06d}-{context.taskAttemptId()}"
        stream, name, at, number = None, None, 0, 0
        for block in text_blocks(batches, weight="payload"):
            made, index = [], []
            for p, u, body, d, r in zip(*(c.to_pylist() for c in block.columns)):
                if stream is None or at >= archive_bytes:
                    if stream is not None:
                        stream.write(b"".join(made))
                        stream.close()
                        made = []
                    name, at, number = f"{stem}-{number:04d}.warc.gz", 0, number + 1
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                member = packed(record(p, u, body, d, r))
                made.append(member)
                index.append((p, header_value(u), d, len(body), "response" if r is None else "revisit", r, name, at, len(member)))
                at += len(member)
            if index:
                stream.write(b"".join(made))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                                                                  pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=[x.split()[0] for x in INDEX.split(", ")])
        if stream is not None:
            stream.close()

    return stages.save(planned.mapInArrow(run, INDEX), "index")


def ranges(rows, gap=GAP, most=RANGE):
    """Runs of sorted (file, offset, length, ...) rows that one read serves."""
    run = []
    for row in rows:
        if run and (row[0] != run[-1][0] or row[1] > run[-1][1] + run[-1][2] + gap
                    or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(index: DataFrame, folder: str, *, payload=True) -> DataFrame:
    """The records that the rows of ``index`` (a selection) point to, with ``html`` if
    ``payload``: every column comes from the archive. A stored payload that doesn't match its
    record's digest or length raises."""
    spark = index.sparkSession
    schema = RECORD + (", html string" if payload else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payload

    def run(batches):
        system, base = store(folder)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        opened, name = None, None
        for span in ranges(rows):
            if span[0][0] != name:
                if opened is not None:
                    opened.close()
                name = span[0][0]
                opened = system.open_input_file(f"{base}/{name}")
            start = span[0][1]
            raw = opened.read_at(span[-1][1] + span[-1][2] - start, start)
            out = []
            for _, offset, length in span:
                headers, body = parse(zlib.decompress(raw[offset - start:offset - start + length], 31))
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                if kind == "response":
                    if hashlib.sha1(body).hexdigest() != digest or len(body) != size:
                        raise ValueError(f"damaged record in {name} at {offset}")
                out.append((page_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, kind,
                            page_number(refers) if refers else None)
                           + ((body.decode() if kind == "response" else None,) if payload else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             names=[x.split()[0] for x in schema.split(", ")])
        if opened is not None:
            opened.close()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return (index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset")
            .sortWithinPartitions("file", "offset").mapInArrow(run, schema))
