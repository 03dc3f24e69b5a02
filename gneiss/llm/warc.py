"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing: payload digests are grouped (map-side maxima), so each group of equal payloads of `least` bytes or more has one
response, the record with the largest id, and revisits that refer to it. Only groups of several rows are kept, in a stored table of
digests, so the join with the payloads moves none of them where that table is small and can be split where one digest is hot. Each
task writes one archive: one gzip member per record, to a temporary name that is renamed when whole, so a task that
runs again replaces its file.

Reading: a task gets byte ranges of archives. It looks for the gzip magic in its range, takes a candidate as a record
if it decodes to a WARC header, and owns the records that start inside the range, reading past its end where they
do. After a record it goes on at the member's end. Other members and stray bytes are passed over.

Defined cases: null or empty payloads are payloads of no bytes. Rows that repeat an id and payload are each written as
that id's record: all responses, or all revisits. Null ids group like others but are never referred to; a group of rows
without ids is all responses. Very long payloads are records like others: a task holds one of them, and read rows of 8 MB besides. Empty
tables give archives of no records. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored

MAGIC, SPLIT, LEVEL = b"\x1f\x8b\x08", 32 << 20, 4
RECORD = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def filesystem(uri: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    found, path = fs.FileSystem.from_uri(uri)
    return found, path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(x: str) -> str:
    """A header value of one line."""
    return re.sub(r"[\r\n]+", " ", x)


def record(kind: str, ident: str, uri: str | None, payload: bytes, sha: str, refers_to: str | None, size: int) -> bytes:
    """A gzip member with one WARC record; a revisit keeps the HTTP header only."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}"]
    if uri:
        head += [f"WARC-Target-URI: {clean(uri)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>"] * (refers_to is not None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def keepers(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """(sha, keeper) of the payloads of several rows: their digest and the id that keeps them."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("size") >= least)
    return rows.groupBy("sha").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("sha", "keeper")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least: int = 0) -> DataFrame:
    """Write one archive per task to the folder, which must be one that all executors share. Returns (path, records, bytes)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    rows = rows.join(stored(keepers(pages, id_col, payload_col, least), "keepers"), "sha", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    rows = rows.select(
        F.col("id").cast("string").alias("id"), "uri", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"),
        "sha", F.when(revisit, F.col("keeper").cast("string")).alias("refers_to"), revisit.alias("revisit"),
    )

    def run(batches):
        store, top = filesystem(folder)
        task = TaskContext.get()
        name = f"{top}/part-{task.partitionId():06d}.warc.gz"
        temporary = f"{top}/.part-{task.partitionId():06d}-{task.taskAttemptId()}.tmp"
        count = size = 0
        with store.open_output_stream(temporary) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    kind = "revisit" if r["revisit"] else "response"
                    data = record(kind, "" if r["id"] is None else r["id"], r["uri"], r["payload"] or b"", base64.b32encode(r["sha"]).decode(), r["refers_to"], r["size"])
                    out.write(data)
                    count, size = count + 1, size + len(data)
        store.move(temporary, name)
        yield pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": size}])

    store, top = filesystem(folder)
    store.create_dir(top, recursive=True)
    done = rows.mapInArrow(run, "path string, records long, bytes long").collect()  # one row per task
    return pages.sparkSession.createDataFrame([tuple(r) for r in done], "path string, records long, bytes long")


class Window:
    """Bytes of a file by position, read a block at a time."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.at, self.data = file, size, block, 0, b""

    def get(self, start: int, least: int) -> bytes:
        """Bytes from start on, `least` or more unless the file ends."""
        end = min(self.size, start + least)
        if start < self.at or end > self.at + len(self.data):
            self.at, self.data = start, self.file.read_at(min(self.size - start, max(least, self.block)), start) if start < self.size else b""
        return self.data[start - self.at :]


def member(window: Window, start: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at start and its end; None if it isn't a whole member with a WARC header."""
    z, out, at, seen = zlib.decompressobj(31), [], start, b""
    try:
        while not z.eof:
            data = window.get(at, 1 << 16)
            if not data:
                return None
            data = data[: 1 << 16]
            got = z.decompress(data)
            at += len(data)
            out.append(got)
            if len(seen) < 5:
                seen += got[:8]
                if not b"WARC/"[: len(seen)] == seen[:5]:
                    return None
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def parse(data: bytes) -> dict | None:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, sha = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = len(payload)
    if kind == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, payload = int(said[1]) if said else None, None
    else:
        sha = digest(payload)
    name = lambda x: x and x.strip("<>").removeprefix("urn:page:")
    return {"record_type": kind, "record_id": name(fields.get("warc-record-id")), "refers_to": name(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha, "payload": payload}


def records(window: Window, start: int, end: int):
    """(offset, content) of the records that start in [start, end)."""
    at = start
    while at < end:
        data = window.get(at, 4096)
        k = data.find(MAGIC, 0, end - at + len(MAGIC) - 1)
        if k < 0:
            # the magic may lie across the end of what was read
            at += max(1, min(len(data), end - at) - len(MAGIC) + 1) if at + len(data) < end else end - at
            continue
        found = member(window, at + k)
        if found is None:
            at += k + 1
            continue
        yield at + k, found[0]
        at = found[1]


def read(spark: SparkSession, folder: str, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """One row per record (RECORD) of the *.warc.gz files of a folder; payload=False leaves the payloads out once they are digested.

    Files are listed by Spark as rows of names and sizes, and their ranges are dealt to tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select("path", F.col("length").alias("size")).where("size > 0")
    ranges = files.withColumn("start", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")))
    ranges = ranges.select("path", "size", "start", F.least(F.col("size"), F.col("start") + split).alias("end"))
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])

    def run(batches):
        for batch in batches:
            for span in batch.to_pylist():
                store, path = filesystem(span["path"])
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for offset, data in records(Window(f, span["size"]), span["start"], span["end"]):
                        r = parse(data)
                        if r is None:
                            continue
                        if not payload:
                            r["payload"] = None
                        rows.append({"path": path, "offset": offset} | r)
                        held += len(r["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 0, 100_000))
    return ranges.repartition(tasks).mapInArrow(run, RECORD)
