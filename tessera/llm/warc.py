"""WARC archives of pages: written in parallel, read back, and indexed by an external merge of locally sorted runs.

Each archive comes with one run: the places of its captures, sorted and written in blocks. Runs are merged by loser trees that
hold one block of each run, at most FAN_IN runs at a time, over as many passes as their number needs. The last pass goes by ranges of the
order, each of which finds its first block in every run by binary search, so its tasks read only what they merge.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, shared_folder, small_batches

#: Payloads of fewer bytes are stored every time; bytes and records at which an archive is closed and the next one begun.
LEAST_REVISIT, ARCHIVE_BYTES, ARCHIVE_ROWS = 100, 64 << 20, 65_536
LEVEL = 1
#: Rows of one block of a run, runs that one merge reads, and rows of one range of the last pass.
BLOCK, FAN_IN, RANGE_ROWS = 512, 128, 500_000
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)

_ENTRY = pa.schema([("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64())])
_RUN_SCHEMA = "run string, offset long, length long, url_key string, captured string, page_id long"
#: A row for each block of a run: the run's file, the block's rows, and the order of its first entry.
_FENCE = pa.schema([("file", pa.string()), ("n_rows", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("no_id", pa.int64()), ("page_id", pa.int64()), ("run", pa.string()), ("offset", pa.int64())])
_FENCE_SCHEMA = "file string, n_rows long, url_key string, captured string, no_id long, page_id long, run string, offset long"
_ORDER = ("url_key", "captured", "no_id", "page_id", "run", "offset")
_READ = pa.schema([("run", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_READ_SCHEMA = "run string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """A key that sorts a site's captures together: the host's labels in reverse, then path and query."""
    host, slash, rest = re.sub(r"^[^:/?#]*://", "", (url or "").split("#", 1)[0]).partition("/")
    host, mark, query = host.partition("?")
    return ",".join(reversed(host.lower().split("."))) + ")/" + rest + mark + query


def captured_at(page_id: int | None) -> str:
    """Pages carry no time; their captures are dated a second apart by id, so that histories have an order."""
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response and holds none."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{i}')}>"
    body = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {captured_at(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case names, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, rest[:size]


def _order(entry: tuple) -> tuple:
    """Where an entry of the index stands: by URL key, time and id, null ids last; its place in the archives breaks ties."""
    run, offset, _, key, captured, page_id = entry
    return key, captured, int(page_id is None), page_id or 0, run, offset


class _Run:
    """A sorted run that is written block by block, under a name of its own attempt that appears only when it is whole."""

    def __init__(self, folder: str):
        self.name = uuid.uuid4().hex
        self.files, base = fs.FileSystem.from_uri(folder)
        self.path = f"{base}/{self.name}.index"
        self.out = self.files.open_output_stream(self.path + ".part", compression=None)
        self.writer = pa.ipc.new_file(self.out, _ENTRY)
        self.block: list[tuple] = []
        self.fences: list[tuple] = []

    def add(self, entry: tuple) -> None:
        self.block.append(entry)
        if len(self.block) == BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.writer.write_batch(_rows_batch(self.block, _ENTRY))
            self.fences.append((self.name, len(self.block), *_order(self.block[0])))
            self.block = []

    def close(self) -> pa.RecordBatch:
        self._flush()
        self.writer.close()
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        return _rows_batch(self.fences, _FENCE)


class _Archive:
    """An archive under a name of its own attempt, which appears only when it is whole; records are gzip members."""

    def __init__(self, folder: str):
        self.run, self.folder = uuid.uuid4().hex, folder
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.path = f"{base}/{self.run}.warc.gz"
        self.out = self.files.open_output_stream(self.path + ".part", compression=None)
        self.at = 0
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, url: str | None, data: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.rows.append((self.run, self.at, len(member), url_key(url), captured_at(page_id), page_id))
        self.at += len(member)

    def close(self) -> pa.RecordBatch:
        """Finish the archive and write its index as a sorted run, whose fences are returned."""
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        run = _Run(self.folder)
        for entry in sorted(self.rows, key=_order):
            run.add(entry)
        return run.close()


def _rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _with_first(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``page_id, url, payload, digest, first``: the smallest id of the pages with an equal payload, null where it is small."""
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    several = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(several.drop("_n"), "digest", "left")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every page and a sorted run of the index for every archive; return the fences of the runs.

    Of pages with equal payloads of at least LEAST_REVISIT bytes the one with the smallest id is stored, others revisit it; a null
    id revisits if any other has an id, and rows that share the smallest id are all stored. Null html is an empty payload.
    Archives of tasks that fail or run twice are never referred to. The result is checkpointed: nothing is written again.
    """
    small_batches(pages.sparkSession)
    rows = _with_first(pages, page_id, url, html).select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for i in range(batch.num_rows):
                number, name, payload, digest, first = (batch.column(c)[i].as_py() for c in range(5))
                archive = archive or _Archive(folder)
                archive.add(number, name, record(number, name, payload, digest, None if first == number else first))
                if archive.at >= archive_bytes or len(archive.rows) >= ARCHIVE_ROWS:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return cut(rows.mapInArrow(run, _FENCE_SCHEMA))


def _members(files: fs.FileSystem, path: str) -> Iterator[tuple[int, bytes]]:
    """The offsets and records of an archive, one at a time."""
    with files.open_input_stream(path, compression=None) as source:
        at, begun, rest, unpacker, parts = 0, 0, b"", zlib.decompressobj(31), []
        while data := rest or source.read(1 << 20):
            parts.append(unpacker.decompress(data))
            rest = unpacker.unused_data
            at += len(data) - len(rest)
            if unpacker.eof:
                yield begun, b"".join(parts)
                begun, unpacker, parts = at, zlib.decompressobj(31), []
        if begun != at:
            raise ValueError(f"{path} is cut off")


def read_archives(fences: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that the first ``fences`` name: ``run, offset, page_id, record_type, payload_bytes, payload_digest, refers_to``.

    Sizes and digests of responses are those of the payload that was read, and are checked against the record's headers; a
    revisit has its header's digest, and its size is left null for :func:`resolve`. Archives are dealt out one by one, however
    few rows their names are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                for offset, data in _members(files, f"{base}/{name}.warc.gz"):
                    headers, block = parse(data)
                    number = int(headers["page-id"]) if "page-id" in headers else None
                    said = headers["warc-payload-digest"].removeprefix("sha256:")
                    if headers["warc-type"] == "revisit":
                        out.append((name, offset, number, "revisit", None, said, int(headers["refers-to-page-id"])))
                    else:
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != said:
                            raise ValueError(f"{name} at {offset}: the payload is not the one that was written")
                        out.append((name, offset, number, "response", len(payload), said, None))
                    if len(out) == 4096:
                        yield _rows_batch(out, _READ)
                        out = []
                if out:
                    yield _rows_batch(out, _READ)

    names = cut(fences.select("run").distinct())
    return names.repartition(max(1, names.count())).mapInArrow(run, _READ_SCHEMA)


def resolve(read: DataFrame) -> DataFrame:
    """Give revisits the size of the response that they refer to; the payloads' digests must agree.

    Only revisits are joined, by a merge join that can be split where one response has very many; nothing is broadcast.
    """
    responses = read.where("record_type = 'response'")
    sizes = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_size"))
    revisits = read.where("record_type = 'revisit'").join(sizes.hint("merge"), ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits.withColumn("payload_bytes", F.col("_size")).drop("_size"))


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the root's winner is next."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, i: int) -> None:
        """Send a run up from its leaf; at an empty node it waits for its opponent."""
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._less(self.losers[node], i):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[i := self.losers[0]]) is not None:
            yield head[2]
            self.heads[i] = self._pull(i)
            node = (i + self.k) // 2
            while node > 0:
                if self._less(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.losers[0] = i


def _entries(files: fs.FileSystem, path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The entries of a run from ``low`` on and before ``high``, a block at a time."""
    with files.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        first, end = 0, reader.num_record_batches
        while low is not None and first + 1 < end:  # the last block whose first entry is not after low
            middle = (first + end) // 2
            if _order(tuple(reader.get_batch(middle).slice(0, 1).to_pylist()[0].values())) <= low:
                first = middle
            else:
                end = middle
        for k in range(first, reader.num_record_batches):
            for entry in zip(*(c.to_pylist() for c in reader.get_batch(k).columns), strict=True):
                if low is not None and _order(entry) < low:
                    continue
                if high is not None and _order(entry) >= high:
                    return
                yield entry


def _merged(folder: str, names: list[str], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    files, base = fs.FileSystem.from_uri(folder)
    return iter(LoserTree([_entries(files, f"{base}/{name}.index", low, high) for name in names], _order))


def _fewer_runs(names: DataFrame, folder: str, fan_in: int, groups: int) -> DataFrame:
    """The fences of longer runs, each merged from at most ``fan_in``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [name for batch in batches for name in batch.column(0).to_pylist()]
        for k in range(0, len(held), fan_in):
            longer = _Run(folder)
            for entry in _merged(folder, held[k : k + fan_in]):
                longer.add(entry)
            yield longer.close()

    return cut(names.repartition(groups).mapInArrow(run, _FENCE_SCHEMA))


def merge_runs(fences: DataFrame, folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in one global order of URL key, time and id: ``run, offset, length, url_key, captured, page_id,
    part, position``.

    Rows with smaller ``(part, position)`` come first; null ids come last of their time. Parts are ranges of the order, so a URL
    with very many captures is spread over several. A task holds a block of each of at most ``fan_in`` runs, whatever the size of the
    data. The driver sees the names of ``fan_in`` runs at most.
    """
    names = cut(fences.select("file").distinct())
    while (k := names.count()) > fan_in:
        fences = _fewer_runs(names, folder, fan_in, math.ceil(k / fan_in))
        names = cut(fences.select("file").distinct())
    last = [r["file"] for r in names.collect()]
    rows = fences.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    parts = int(fences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, rows // (2 * BLOCK)), math.ceil(rows / range_rows))
    lows = fences.repartitionByRange(parts, *_ORDER).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*_ORDER)).alias("low"))
    by_low = W.orderBy("low")  # a row for each range
    ranges = cut(lows.select((F.row_number().over(by_low) - 1).alias("part"), "low", F.lead("low").over(by_low).alias("high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = [None if row[side] is None else tuple(row[side].values()) for side in ("low", "high")]
                out: list[tuple] = []
                for position, entry in enumerate(_merged(folder, last, *bounds)):
                    out.append((*entry, row["part"], position))
                    if len(out) == 4096:
                        yield _rows_batch(out, merged)
                        out = []
                if out:
                    yield _rows_batch(out, merged)

    merged = pa.schema([*_ENTRY, ("part", pa.int32()), ("position", pa.int64())])
    return ranges.repartition(parts).mapInArrow(run, f"{_RUN_SCHEMA}, part int, position long")


def archive_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives, merge their index, read them back, and return a row for each page with its place in the history.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, capture_rank, run, offset``. The captures'
    ranks count from 1 in the order of :func:`merge_runs`. See :func:`write_archives` for nulls and ties; repeated rows are records of
    their own; no pages give no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    fences = write_archives(pages, folder, page_id, url, html)
    history = cut(merge_runs(fences, folder).drop("page_id"))
    sizes = history.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    history = history.join(starts, "part").withColumn("capture_rank", F.col("_start") + F.col("position") + 1)
    rows = resolve(cut(read_archives(fences, folder))).join(history.hint("merge"), ["run", "offset"])
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_rank", "run", "offset")
    return rows.select(*names)
