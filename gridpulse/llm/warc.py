"""WARC archives and their capture index.

Pages are written as gzip-per-record WARC files; equal payloads are stored once
and revisited by the others. Each archive, read back, gives a locally sorted run
of captures. The runs are dealt out by ranges of (url key, timestamp, id, place in
the archives), and each range merges its k run segments with a loser tree:
partition after partition, the result is globally ordered.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import sliced, written
from gridpulse.session import scratch_path

#: an archive is closed beyond either
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32 << 20, 50_000
RANGE_ROWS = 20_000
#: captures that agree in key, time and id follow one another as they lie in the archives
ORDER = ["url_key", "captured", "page_id", "run", "record_offset"]
#: where archives can be written: what Arrow's file systems reach from every task
SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")
_EPOCH, _LAST = dt.datetime(1970, 1, 1), 253_402_300_799  # 9999-12-31T23:59:59Z
_FIRST = -62_135_596_800  # 0001-01-01T00:00:00Z
CAPTURE = (
    "run string, url_key string, captured long, page_id long, url string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, record_offset long, record_bytes long"
)


# ---------------------------------------------------------------------------
# records
# ---------------------------------------------------------------------------


def _header_text(value: str) -> str:
    """A header value on one line: control characters and % are percent-encoded."""
    return "".join(f"%{b:02X}" if (b := ord(c)) < 0x20 or b in (0x25, 0x7F) else c for c in value)


def _plain_text(value: str) -> str:
    out, rest = [], value
    while "%" in rest:
        head, _, tail = rest.partition("%")
        out += [head, chr(int(tail[:2], 16))]
        rest = tail[2:]
    return "".join([*out, rest])


def _date(seconds: int) -> str:
    """A capture time as the format wants it; one outside of the years 1 to 9999 is moved to their end."""
    return (_EPOCH + dt.timedelta(seconds=min(max(seconds, _FIRST), _LAST))).isoformat() + "Z"


def record(page_id, url, captured, payload: bytes, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone; its Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    # the exact seconds in a field of our own, as dates end with the year 9999
    head += [f"WARC-Date: {_date(captured)}", f"Capture-Seconds: {captured}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _seconds(date: str) -> int:
    """The seconds of a WARC-Date, which may have fractions (cut)."""
    return int((dt.datetime.fromisoformat(date.removesuffix("Z")[:19]) - _EPOCH).total_seconds())


def _id(urn: str):
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def parse(data: bytes) -> dict:
    """The fields of one record; a response's digest is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return {
        "captured": int(fields["Capture-Seconds"]) if "Capture-Seconds" in fields else _seconds(fields["WARC-Date"]),
        "page_id": _id(fields["WARC-Record-ID"]),
        "url": None if url is None else _plain_text(url),
        "record_type": kind,
        "refers_to": _id(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload,
    }


def members(stream, chunk: int = 1 << 18):
    """(offset, compressed length, bytes) of each gzip member of a stream; one member is held at a time."""
    offset, length, data, out, z = 0, 0, b"", [], zlib.decompressobj(31)
    while True:
        data = data or stream.read(chunk)
        if not data:
            if length:
                raise ValueError(f"the archive ends inside the record at {offset}")
            return
        out.append(z.decompress(data))
        length += len(data) - len(z.unused_data)
        data = z.unused_data
        if z.eof:
            yield offset, length, b"".join(out)
            offset, length, out, z = offset + length, 0, [], zlib.decompressobj(31)


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels turned round, then the rest, lower-cased."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return (url or "").lower()
    host, slash, path = rest.partition("/")
    return (",".join(reversed(host.split("."))) + ")" + slash + path).lower()


# ---------------------------------------------------------------------------
# archives
# ---------------------------------------------------------------------------


def planned(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Adds digest, size, revisit and refers_to to pages(page_id, url, captured, html).

    Payload groups are met by their aggregate (largest id, number of rows) alone;
    the join back on the digest is one whose large partitions Spark splits.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("captured").cast("long").alias("captured"),
        F.col("html").cast("string").alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and keep is not null").drop("n")
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("page_id"))
    return rows.join(groups, ["digest", "size"], "left").select(
        "page_id", "url", F.coalesce("captured", F.lit(0)).alias("captured"), F.when(~revisit, F.col("html")).alias("html"),
        "digest", "size", revisit.alias("revisit"), F.when(revisit, F.col("keep")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Writes the archives; returns their manifest (path, records, bytes), a written table.

    A task that is run again writes files of new names; only those of the task
    that counted are in the manifest. The folder is written by the tasks through
    Arrow's file systems, which know the schemes of ``SCHEMES`` with the settings
    of the machines; another scheme is refused before any work.
    """
    scheme = folder.partition("://")[0] if "://" in folder else "file" if folder.startswith(("/", "file:")) else ""
    if scheme not in SCHEMES:
        raise ValueError(f"archives can be written to {', '.join(SCHEMES)}; got {folder}")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        path, out, n, size = "", None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for batch in sliced(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                payload = (row["html"] or "").encode()
                data = record(row["page_id"], row["url"], row["captured"], payload, row["digest"], row["size"], row["refers_to"], row["revisit"])
                data = z.compress(data) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES or n >= ARCHIVE_RECORDS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    plan = planned(pages, min_bytes)
    return written(plan.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")[0]


def read_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """The captures of the archives; each archive is one run, in the order of ORDER."""
    schema = CAPTURE

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for offset, length, data in members(stream):
                        row = parse(data)
                        del row["payload"]
                        rows.append(row | {"run": path, "url_key": url_key(row["url"]), "record_offset": offset, "record_bytes": length})
                rows.sort(key=_order)
                yield pa.RecordBatch.from_pylist(rows, schema=CAPTURE_ARROW)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)


CAPTURE_ARROW = pa.schema(
    [(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in CAPTURE.split(", ")]
)


def _order(row: dict):
    """Null ids first, as Spark sorts."""
    return row["url_key"].encode(), row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["run"].encode(), row["record_offset"]


# ---------------------------------------------------------------------------
# merge
# ---------------------------------------------------------------------------


def loser_tree(runs: list[list], key):
    """Merges sorted runs. Inner nodes keep the losers of their matches, so each next
    row replays one path of log2(k) matches; ties go to the earlier run."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    end = (1,)  # sorts after every (0, key, run)

    def head(i):
        return (0, key(runs[i][at[i]]), i) if at[i] < len(runs[i]) else end

    heads = [head(i) for i in range(k)]
    losers: list[int | None] = [None] * k
    winner = 0
    for i in range(k):  # enter the runs one after another; each stops where it waits for a match
        w, node = i, (i + k) // 2
        while node and losers[node] is not None:
            if heads[losers[node]] < heads[w]:
                losers[node], w = w, losers[node]
            node //= 2
        if node:
            losers[node] = w
        else:
            winner = w
    while heads[winner] != end:
        yield runs[winner][at[winner]]
        at[winner] += 1
        heads[winner] = head(winner)
        node = (winner + k) // 2
        while node:
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2


def merge_runs(captures: DataFrame, rows: int) -> DataFrame:
    """Captures of all runs in global order: ranges of about RANGE_ROWS rows, merged by loser tree.

    A url key that holds many captures spans several ranges by timestamp and id, and
    captures that agree in these by their place in the archives.
    """

    def run(batches):
        runs: dict[str, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                runs.setdefault(row["run"], []).append(row)
        for rows_of_run in runs.values():  # in order already, but where an archive was read in pieces
            rows_of_run.sort(key=_order)
        merged = []
        for row in loser_tree(list(runs.values()), _order):
            merged.append(row)
            if len(merged) == 5000:
                yield pa.RecordBatch.from_pylist(merged, schema=CAPTURE_ARROW)
                merged = []
        if merged:
            yield pa.RecordBatch.from_pylist(merged, schema=CAPTURE_ARROW)

    return captures.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *ORDER).mapInArrow(run, CAPTURE)


def capture_index(pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """pages(page_id, url, captured, html) -> archives, and their captures in order of
    (url_key, captured, page_id), with run (archive path), record_offset and record_bytes.

    ``captured`` is in seconds (null: 0). A null html is an empty payload; a null
    url has an empty url key. Equal payloads of ``min_bytes`` or more: the row of
    the largest id is the response (rows repeated with that id as well), the
    others revisit it; a group whose ids are all null is all responses. Other
    columns are not read. An empty table gives an empty index.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, min_bytes)
    rows = manifest.agg(F.sum("records")).first()[0] or 0
    captures, _ = written(read_runs(manifest, folder), "warc-runs")
    return merge_runs(captures, rows)
