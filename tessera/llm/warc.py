"""WARC archives: writing, normalising monolithic gzip files, reading by index.

``write_archives`` writes records as whole-file gzip streams, several archives
per task. ``normalise`` inflates such a stream once, front to back in bounded
pieces, writes every record as a gzip member of its own to a new archive and an
offset index beside it (one JSON line per record). ``read_records`` fetches each
record by its offset.

Archives live in a folder that all executors share, reached through
``pyarrow.fs`` by its URI. A task attempt writes under a name of its own and only
names that a committed task has returned are read, so a lost executor or a
retried task leaves at most an unused file. Of the records, only index rows pass
through Spark; the driver sees counts.

Nulls: a null payload is empty; a null url or id leaves its header out. A record
with an id shared by others keeps its own row. Copies of a payload are a
partial aggregate on its digest; a hot digest is split by the adaptive skew join. Very
long payloads are records of their own length, repeated rows are records of their own, an
empty table gives no archive and an empty result. Columns other than the three named
ones are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boundary, shared_dir

ARCHIVE_BYTES = 32 << 20  # payload bytes after which a task starts its next archive
ARCHIVES_PER_TASK = 16
REVISIT_BYTES = 1000  # smaller payloads are always stored in full
PIECE = 1 << 16  # compressed bytes inflated at once
GZIP = 31  # zlib's window setting for gzip framing
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _create(uri: str):
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, target) -> bytes:
    """A response record, or (``target``: the page it repeats) a revisit without the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            .encode())
    block = http if target is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if target is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(target, digest)}",
                  f"X-Refers-To-Page: {target}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record starts here: {head[:40]!r}")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def with_targets(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
                 least: int = REVISIT_BYTES) -> DataFrame:
    """``id, url, payload, digest, target``: target is the largest id with the same
    payload of at least ``least`` bytes, null for that page itself and the others."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = (rows.filter(F.col("size") >= least).groupBy("digest", "size")
              .agg(F.max("id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    target = F.when(~F.col("_last").eqNullSafe(F.col("id")), F.col("_last"))
    return rows.join(groups, ["digest", "size"], "left").select("id", "url", "payload", "digest", target.alias("target"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Monolithic gzip archives of ``rows`` (see ``with_targets``); returns ``(archive, records)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        out = packer = name = None
        serial = count = size = 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["archive", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "target"))):
                page_id, url, payload, digest, target = (x.as_py() for x in row)
                if out is None:
                    name = f"{folder}/whole-{context.partitionId():06d}-{context.taskAttemptId()}-{serial:05d}.warc.gz"
                    out, packer = _create(name), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    count = size = 0
                out.write(packer.compress(record_bytes(page_id, url, payload, digest, target)))
                count, size = count + 1, size + len(payload)
                if size >= archive_bytes:
                    yield close()
                    out, serial = None, serial + 1
        if out is not None:
            yield close()

    return boundary(rows.mapInArrow(write, "archive string, records long"))


class RecordStream:
    """The records of a gzip file (one member or many), in bounded pieces."""

    def __init__(self, source, piece: int = PIECE):
        self.source, self.piece = source, piece
        self.raw, self.buffer, self.member = b"", bytearray(), None

    def _more(self) -> bool:
        """Inflate the next piece; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.source.read(self.piece)
            if not self.raw:
                if self.member is not None:
                    raise ValueError("the gzip stream is cut off")
                return False
            if self.member is None:
                self.member = zlib.decompressobj(GZIP)
            got = self.member.decompress(self.raw)
            if self.member.eof:
                self.raw, self.member = self.member.unused_data.lstrip(b"\0"), None
            else:
                self.raw = b""
            if got:
                self.buffer += got
                return True

    def __iter__(self) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("the last record is cut off")
                    return
            head = bytes(self.buffer[:end + 4])
            del self.buffer[:end + 4]
            headers = parse_headers(head[:-4])
            body = self._body(int(headers["content-length"]) + 4)
            yield head, headers, body
            for _ in body:  # what the caller has not read
                pass

    def _body(self, left: int) -> Iterator[bytes]:
        while left:
            if not self.buffer and not self._more():
                raise ValueError("the last record is cut off")
            part = bytes(self.buffer[:left])
            del self.buffer[:left]
            left -= len(part)
            yield part


INDEX = "archive string, ordinal long, offset long, length long, type string, record_id string, digest string"


def normalise(archives: DataFrame, folder: str, n_archives: int) -> DataFrame:
    """Every record of ``archives.archive`` as its own gzip member in a new archive
    under ``folder``, with a ``.index.jsonl`` beside it; returns the index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                stem = source.rsplit("/", 1)[-1].removesuffix(".warc.gz")
                name = f"{folder}/{stem}-by-record-{attempt}.warc.gz"
                fs, path = _open(source)
                rows, at = [], 0
                with fs.open_input_stream(path, compression=None) as raw, _create(name) as out, \
                        _create(name.removesuffix(".warc.gz") + ".index.jsonl") as index:
                    for ordinal, (head, headers, body) in enumerate(RecordStream(raw)):
                        packer, length = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
                        parts = [packer.compress(head)]
                        for part in body:
                            parts.append(packer.compress(part))
                        parts.append(packer.flush())
                        for part in parts:
                            out.write(part)
                            length += len(part)
                        row = (name, ordinal, at, length, headers.get("warc-type"), headers.get("warc-record-id"),
                               headers.get("warc-payload-digest"))
                        index.write(json.dumps(dict(zip(("offset", "length", "type", "id", "digest"), row[2:])))
                                    .encode() + b"\n")
                        rows.append(row)
                        at += length
                        if len(rows) == 10_000:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)

    return boundary(archives.select("archive").repartition(_tasks(archives, n_archives)).mapInArrow(run, INDEX))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["archive", "ordinal", "offset", "length", "type", "record_id", "digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def payload_of(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and payload size of an inflated record of any type. The payload of a record that
    holds an HTTP message is its body, that of any other its whole block; a revisit
    has none, and the size that its HTTP head states."""
    end = record.index(b"\r\n\r\n")
    headers = parse_headers(record[:end])
    block = record[end + 4:end + 4 + int(headers["content-length"])]
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return headers, block, len(block)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    return headers, payload, int(length[1]) if length and headers.get("warc-type") != "request" else len(payload)


def stated_digest(value: str | None) -> str | None:
    """Bare hex of a SHA-1 in base 32 or hex; None for none, and for other algorithms."""
    kind, _, digest = (value or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    return digest.lower() if len(digest) == 40 else base64.b32decode(digest.upper()).hex()


def _tasks(df: DataFrame, n_archives: int) -> int:
    """Tasks for ``n_archives``: all cores at work twice over, and at most ``ARCHIVES_PER_TASK`` each beyond that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n_archives, max(2 * cores, -(-n_archives // ARCHIVES_PER_TASK))))


RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "archive string, offset long, length long")


def read_records(index: DataFrame, n_archives: int) -> DataFrame:
    """The records that the index rows point at, of any type and writer, each inflated on its
    own; a stated SHA-1 is checked, and where none is stated the payload's own is returned.
    ``page_id`` and ``refers_to`` are null where the record does not name them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = source = None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if source is not None:
                        source.close()
                    fs, path = _open(archive)
                    name, source = archive, fs.open_input_file(path)
                record = zlib.decompress(source.read_at(length, offset), GZIP)
                headers, payload, size = payload_of(record)
                stated, digest = stated_digest(headers.get("warc-payload-digest")), hashlib.sha1(payload).hexdigest()
                if headers.get("warc-type") == "revisit":
                    digest = stated
                elif stated not in (None, digest) or len(payload) != size:
                    raise ValueError(f"payload of {headers.get('warc-record-id')} in {archive} does not match its digest")
                page, target = headers.get("x-page-id"), headers.get("x-refers-to-page")
                out.append((None if page is None else int(page), size, digest, headers.get("warc-type"),
                            None if target is None else int(target), archive, offset, length))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*out)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [x.split()[0] for x in RECORDS.split(", ")])
        if source is not None:
            source.close()

    return (index.repartition(_tasks(index, n_archives), "archive").sortWithinPartitions("archive", "offset")
            .select("archive", "offset", "length").mapInArrow(read, RECORDS))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
                       archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every record back."""
    folder = shared_dir(pages.sparkSession)
    whole = write_archives(with_targets(pages, id_col, url, payload), f"{folder}/whole", archive_bytes)
    n = whole.count()
    index = normalise(whole, f"{folder}/records", n)
    return read_records(index, n)


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
g AS (SELECT digest, n, max(page_id) AS last FROM d WHERE n >= {REVISIT_BYTES} GROUP BY digest, n)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM d LEFT JOIN g USING (digest, n)
"""
