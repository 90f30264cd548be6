"""WARC archives and their two-level capture index.

Archives hold one gzip member for each record. The index sorts captures by reversed-host URL key into compressed blocks;
each index file ends in a sparse directory with the first capture of every block, and a small table names the files'
first captures. A lookup bisects files, directory and block, and then reads only the record's byte range.

Tasks write files through Arrow's filesystems into a folder that all executors share, under names of their own: a file
counts only if the task's rows were committed, so a lost or repeated task leaves at most a file that nothing names.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.arrow import begin_task, slices
from orefield.session import discard, materialize, scratch_path, ship

LEAST_DEDUP_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
BLOCK_ENTRIES = 512
#: An index file gets about this many captures, so the files stay few at any size.
FILE_ENTRIES = 500_000
READ_BYTES = 4 << 20
#: A reading task gets about this many bytes of archives.
TASK_BYTES = 64 << 20
LEVEL = 4
NO_ID = -(1 << 63)
TRAILER = ">QQ"
TRAILER_BYTES = 16


def url_key(url: Column) -> Column:
    """com,example,www)/path?query: the host reversed and lower-cased; what is no URL is its own key, null is empty."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    path = F.regexp_extract(url, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(url.rlike(pattern), key).otherwise(url)


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def header_value(text: str | None) -> str:
    """Header lines end at CR LF, so control characters of a value are escaped as in a URL."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit, which has the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode().split("\r\n")[1:])
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page_of(urn: str | None) -> int | None:
    text = (urn or "")[len("<urn:page:") : -1]
    return int(text) if text else None


class Appender:
    """One growing file of a task, and a further one once it is large."""

    def __init__(self, folder: str, kind: str, limit: int):
        self.fs, self.path = store(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.kind, self.limit, self.out, self.name, self.at = kind, limit, None, "", 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.name = f"{self.kind}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def tasks(spark: SparkSession, amount: int, each: int) -> int:
    """How many tasks of about ``each`` the amount takes; a small amount is spread over the cluster, but in no less than
    64ths of that. Being explicit, the number isn't lowered for rows that are small themselves but lead to large reads."""
    return max(1, -(-amount // each), min(spark.sparkContext.defaultParallelism, -(-amount * 64 // each)))


ENTRY = "key string, page_id long, file string, offset long, length long"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages and return the captures (key, page_id, file, offset, length), committed.

    Of equal payloads of LEAST_DEDUP_BYTES or more, that with the largest page_id is a response and the others revisit
    it; rows that repeat this id are all responses, as are rows without id if none has one. Null payloads are empty.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), url_key(F.col(url_col).cast("string")).alias("key"), payload.alias("text"), F.sha1(payload).alias("digest")
    )
    large = rows.where(F.octet_length("text") >= LEAST_DEDUP_BYTES)
    equal = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = materialize(equal, "equal")
    told = rows.join(equal, "digest", "left")
    refers = F.when((F.octet_length("text") >= LEAST_DEDUP_BYTES) & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    told = told.select("key", "page_id", "url", "digest", refers.alias("refers_to"), "text")

    def run(batches):
        out = begin_task(lambda: Appender(folder, "archive", ARCHIVE_BYTES))
        for batch in batches:
            for part, texts in slices(batch):
                key, page_id, url, digest, refers_to = (part.column(i).to_pylist() for i in range(5))
                files, offsets, lengths = [], [], []
                for i, data in enumerate(texts):
                    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = press.compress(record(page_id[i], url[i], data, digest[i], refers_to[i], date)) + press.flush()
                    name, at = out.add(member)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((key, pa.string()), (page_id, pa.int64()), (files, pa.string()), (offsets, pa.int64()), (lengths, pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        out.close()

    captures = materialize(told.mapInArrow(run, ENTRY), "captures")
    discard(equal)
    return captures


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, int, str]]:
    """Sort the captures into index files; returns their first captures and names, one for each FILE_ENTRIES captures."""
    n = tasks(captures.sparkSession, captures.count(), FILE_ENTRIES)
    rows = captures.select(F.col("key").cast("binary").alias("key"), F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "file", "offset", "length")
    ordered = rows.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches):
        out, directory, block = begin_task(lambda: Appender(folder, "index", 1 << 62)), [], []

        def flush():
            data = zlib.compress("\n".join(json.dumps([k.decode("latin-1"), *rest]) for k, *rest in block).encode(), LEVEL)
            directory.append([block[0][0].decode("latin-1"), block[0][1], out.add(data)[1], len(data)])
            block.clear()

        for batch in batches:
            for entry in zip(*(batch.column(i).to_pylist() for i in range(5))):
                block.append(entry)
                if len(block) == BLOCK_ENTRIES:
                    flush()
        if block:
            flush()
        if directory:
            data = zlib.compress(json.dumps(directory).encode())
            name, at = out.add(data)
            out.add(struct.pack(TRAILER, at, len(data)))
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_pydict({"first_key": [first[0].encode("latin-1")], "first_id": [first[1]], "file": [name]})

    files = materialize(ordered.mapInArrow(run, "first_key binary, first_id long, file string"), "index")
    firsts = sorted((bytes(r[0]), r[1], r[2]) for r in files.collect())
    discard(files)
    return firsts


class Index:
    """The index as a task sees it: the newest directory and block are kept, as lookups come in key order."""

    def __init__(self, folder: str, files: list[tuple[bytes, int, str]]):
        self.fs, self.path = store(folder)
        self.files = files
        self.firsts = [x[:2] for x in files]
        self.file = self.block_at = None

    def block(self, f: int, b: int) -> list[tuple]:
        if (f, b) != self.block_at:
            _, _, at, length = self.directory[b]
            data = zlib.decompress(self.input.read_at(length, at)).decode()
            self.entries = [((k.encode("latin-1"), i), file, offset, n) for k, i, file, offset, n in map(json.loads, data.split("\n"))]
            self.keys = [e[0] for e in self.entries]
            self.block_at = (f, b)
        return self.entries

    def open(self, f: int) -> None:
        if self.file != f:
            self.input = self.fs.open_input_file(f"{self.path}/{self.files[f][2]}")
            size = self.input.size()
            at, length = struct.unpack(TRAILER, self.input.read_at(TRAILER_BYTES, size - TRAILER_BYTES))
            self.directory = json.loads(zlib.decompress(self.input.read_at(length, at)))
            self.blocks = [(k.encode("latin-1"), i) for k, i, _, _ in self.directory]
            self.file = f

    def find(self, key: bytes, page_id: int) -> list[tuple[str, int, int]]:
        """Places of all captures of this key and id; they may begin in the block before and run on through files."""
        want = (key, page_id)
        out: list[tuple[str, int, int]] = []
        f = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while f < len(self.files) and self.firsts[f] <= want:
            self.open(f)
            b = max(0, bisect.bisect_left(self.blocks, want) - 1)
            while b < len(self.blocks) and self.blocks[b] <= want:
                entries = self.block(f, b)
                i = bisect.bisect_left(self.keys, want)
                while i < len(entries) and entries[i][0] == want:
                    out.append(entries[i][1:])
                    i += 1
                b += 1
            f += 1
        return out


def lookup(wanted: DataFrame, folder: str, files: list[tuple[bytes, int, str]]) -> DataFrame:
    """(page_id, file, offset, length) of the captures of each distinct (key, page_id) of ``wanted``."""
    rows = wanted.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id")).distinct()
    n = tasks(wanted.sparkSession, wanted.count(), FILE_ENTRIES)
    rows = rows.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches):
        index = begin_task(lambda: Index(folder, files))
        for batch in batches:
            found = [(i, *place) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for place in index.find(k, i)]
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["page_id", "file", "offset", "length"])

    return rows.mapInArrow(run, "page_id long, file string, offset long, length long")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read(places: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at these places, read by byte ranges in file order; neighbours share a read.

    (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload binary: null for revisits). The digest
    of every payload is computed again and must be that of its header.
    """
    n = tasks(places.sparkSession, places.agg(F.sum("length")).first()[0] or 0, TASK_BYTES)
    rows = places.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def run(batches):
        fs, path = begin_task(lambda: store(folder))
        name = source = None
        for batch in batches:
            todo = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(todo):
                j, (file, start, length) = i + 1, todo[i]
                end = start + length
                while j < len(todo) and todo[j][0] == file and todo[j][1] == end and end - start < READ_BYTES:
                    end += todo[j][2]
                    j += 1
                if file != name:
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                data = memoryview(source.read_at(end - start, start))
                out = []
                for _, at, n in todo[i:j]:
                    warc, http, payload = parse(zlib.decompress(data[at - start : at - start + n], 31))
                    kind = warc["WARC-Type"]
                    digest = warc["WARC-Payload-Digest"][len("sha1:") :]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {at}: the payload doesn't have its header's digest")
                    row = (_page_of(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], kind, _page_of(warc.get("WARC-Refers-To")), int(http["Content-Length"]), digest)
                    out.append(row + ((payload if kind == "response" else None,) if with_payload else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                i = j

    return rows.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, with_payload: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, index, look up every page by its key and id, and read its record back: one row for each row of pages.

    An empty table gives no rows. Rows that repeat key and id are each written and told, each as often as they stand
    there; null payloads and URLs count as empty, and rows without id are found as such.
    """
    folder = folder or scratch_path(spark, "warc")
    captures = write(pages, folder, id_col, url_col, html_col)
    files = build_index(captures, folder)
    discard(captures)
    wanted = pages.select(url_key(F.col(url_col).cast("string")).alias("key"), F.col(id_col).alias("page_id"))
    places = materialize(lookup(wanted, folder, files), "places")
    return read(places, folder, with_payload)
