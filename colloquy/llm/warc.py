"""WARC: write captures to archives, read them back, and merge their indexes.

Each task writes archives whose records are sorted by URL key and time, one gzip member a
record. A payload is stored once, by the capture with the largest id; others revisit it.
Reading an archive gives a run of index rows in that order. The runs are dealt out by ranges
of (URL key, time, id), and in each range loser trees merge them in two levels: what comes
of many runs is merged as soon as BUFFER_ROWS rows are there and goes to a file of the task's
own, as one longer run; those files are then merged, a few rows of each in memory. So all
ranges together list every URL's capture history in global order.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import n_partitions, pick, stored
from .urls import host_and_path

#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 8 << 20
#: Index rows that one range of the merge gets, about; rows that are merged in memory; and rows of a longer run that are read at once.
RANGE_ROWS, BUFFER_ROWS, READ_ROWS = 1 << 19, 1 << 16, 1 << 12
#: Captures without a time of their own: this second plus their id modulo SECONDS, so that any id makes a date.
EPOCH, SECONDS = 1_700_000_000, 1_000_000_000
CRLF = b"\r\n"


def url_key(url: Column) -> Column:
    """Host names from the right, then path and query, as in com,example)/a?b; empty for no host."""
    host, _ = host_and_path(url)
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    name = F.concat_ws(",", F.reverse(F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")))
    return F.when(F.length(host) > 0, F.concat(name, F.lit(")"), rest)).otherwise("")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, not yet compressed."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def _one_line(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """Offset, length, headers and block of each record of an archive, member by member."""
    at = 0
    while at < len(data):
        reader, out, step = zlib.decompressobj(31), [], at
        while not reader.eof:
            if step >= len(data):
                raise ValueError("the archive ends inside a member")
            out.append(reader.decompress(data[step : step + (1 << 16)]))
            step += 1 << 16
        size = min(step, len(data)) - len(reader.unused_data) - at
        raw = b"".join(out)
        head, _, rest = raw.partition(CRLF + CRLF)
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a member holds no WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield at, size, headers, rest[: int(headers["Content-Length"])]
        at += size


def _write(batches):
    task, number, size, parts = TaskContext.get().partitionId(), 0, 0, []
    schema = pa.schema([("archive", pa.string()), ("data", pa.binary())])

    def close():
        return pa.RecordBatch.from_arrays([pa.array([f"captures-{task:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for row in batch.slice(at, 512).to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                when = datetime.fromtimestamp(row["seconds"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                headers = [("WARC-Record-ID", f"<urn:capture:{row['page_id']}>"), ("WARC-Date", when), ("WARC-Target-URI", _one_line(row["url"])), ("X-URL-Key", _one_line(row["key"])), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                if row["refers_to"] is not None:
                    headers += [("WARC-Refers-To", f"<urn:capture:{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    parts.append(member(record("revisit", headers, b"")))
                else:
                    parts.append(member(record("response", headers, payload)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, size, parts = number + 1, 0, []
    if parts:
        yield close()


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives (name, data) in the shared folder, one record for each row of pages."""
    page = pick(pages, "page_id", "url", "html")
    page = page.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    sized = page.select("page_id", "sha1", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    # Payloads that occur once need no join; the others' winners are one row a payload.
    winners = sized.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = page.join(winners, "sha1", "left")
    rows = rows.withColumns({"refers_to": F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")), "seconds": F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS)), "key": url_key(F.coalesce("url", F.lit("")))})
    rows = rows.select("page_id", "url", "html", "sha1", "refers_to", "seconds", "key").sortWithinPartitions("key", "seconds", "page_id")
    return stored(rows.mapInArrow(_write, "archive string, data binary"))


_INDEX = [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
_DDL = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _capture(name: str | None) -> int | None:
    id_ = (name or "").removeprefix("<urn:capture:").removesuffix(">")
    return int(id_) if id_.lstrip("-").isdigit() else None


def _read(batches):
    for batch in batches:
        for name, data in zip(batch.column("archive"), batch.column("data")):
            out = []
            for offset, length, headers, block in read_records(data.as_py()):
                kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if kind == "response":
                    digest, size = base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)
                when = headers["WARC-Date"].translate({ord(c): None for c in "-:TZ"})
                out.append((headers["X-URL-Key"], when, _capture(headers["WARC-Record-ID"]), size, digest, kind, _capture(headers.get("WARC-Refers-To")), name.as_py(), offset, length))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _INDEX)], schema=pa.schema(_INDEX))


def read_archives(archives: DataFrame) -> DataFrame:
    """Index rows of all records, in the order of each archive; digests and lengths of responses are taken from the stored bytes."""
    return archives.mapInArrow(_read, _DDL)


class LoserTree:
    """Merge k sorted runs: each inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = [iter(run) for run in runs], key, len(runs)
        self.rows: list = [None] * self.k
        self.heads: list = [None] * self.k
        for i in range(self.k):
            self._next(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _next(self, run: int) -> None:
        """Take a run's next row; an ended run has no head."""
        try:
            self.rows[run] = next(self.runs[run])
            self.heads[run] = (self.key(self.rows[run]),)
        except StopIteration:
            self.heads[run] = None

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes out before run b's; an ended run loses, equal heads go by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.losers[node] < 0:  # while the tree is built, the first to come waits
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            winner = self.losers[0]
            if self.heads[winner] is None:
                return
            yield self.rows[winner]
            self._next(winner)
            self._play(winner)


_URL_KEY, _TIMESTAMP, _PAGE, _ARCHIVE = (next(i for i, (n, _) in enumerate(_INDEX) if n == c) for c in ("url_key", "timestamp", "page_id", "archive"))


def _key(row: tuple) -> tuple:
    return row[_URL_KEY], row[_TIMESTAMP], row[_PAGE] is not None, row[_PAGE] or 0


def _tuples(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c, _ in _INDEX))


def _merged(rows: list[tuple]):
    """The rows in order, by a loser tree over their runs."""
    runs: dict = {}
    for row in rows:
        runs.setdefault(row[_ARCHIVE], []).append(row)
    ordered = []
    for name in sorted(runs):
        keys = [_key(row) for row in runs[name]]
        # A run comes as its archive was written; a fetch that was retried may come in another order.
        if any(a > b for a, b in zip(keys, keys[1:])):
            runs[name].sort(key=_key)
        ordered.append(runs[name])
    return LoserTree(ordered, _key)


def _batches_of(rows, schema: pa.Schema, most: int):
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _spilled(rows) -> Iterator[tuple]:
    """The rows, by way of a file of the task's own that is gone when it is closed."""
    schema, file = pa.schema(_INDEX), tempfile.TemporaryFile()
    with pa.ipc.new_stream(pa.PythonFile(file, "w"), schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        for batch in _batches_of(rows, schema, READ_ROWS):
            to.write_batch(batch)
    file.seek(0)

    def read():
        with file:
            for batch in pa.ipc.open_stream(pa.PythonFile(file, "r")):
                yield from _tuples(batch)

    return read()


def _merge(batches):
    held, runs = [], []
    for batch in batches:
        held += _tuples(batch)
        if len(held) >= BUFFER_ROWS:
            runs.append(_spilled(_merged(held)))
            held = []
    rows = LoserTree([*runs, _merged(held)], _key) if runs else _merged(held)
    task = TaskContext.get().partitionId()
    schema = pa.schema([*_INDEX, ("range", pa.int32()), ("position", pa.int64())])
    yield from _batches_of((row + (task, i) for i, row in enumerate(rows)), schema, 1 << 14)


def merged_index(index: DataFrame) -> DataFrame:
    """All index rows in global order by url_key, timestamp, page_id: range by range, and by position within."""
    index = stored(index)
    n = n_partitions(index.sparkSession, index.count(), RANGE_ROWS)
    return index.repartitionByRange(n, "url_key", "timestamp", "page_id").mapInArrow(_merge, f"{_DDL}, range int, position long")


def capture_histories(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, read back and index every page.

    A null html is an empty payload; a null url has an empty key. Rows with the id of a
    payload's response are responses too. An empty table gives no row; other columns are
    not read. page_id must be a whole number of 64 bits or null. A task holds one archive, so a
    very long html needs a few times its own bytes.
    """
    return merged_index(read_archives(write_archives(pages, least_bytes)))
