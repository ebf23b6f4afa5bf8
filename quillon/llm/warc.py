"""WARC archives: a writer with revisit records and a splittable reader.

Writer: every task writes its rows as gzip members, one a record, to files of
its own in a shared folder and returns their paths; a file has its final name
only when whole, and only files that a successful task returned are read, so a
repeated task does no harm.

Reader: files are cut into byte ranges and dealt to tasks.  A task looks for
the gzip magic from the start of its range, takes a candidate for a member only
if its first bytes inflate to the begin of a WARC header of any length, and owns
the records that start inside its range, reading on past its end for the last of
them.  A range may begin inside a record that holds an archive itself; what is
found there lies before the end of a record of an earlier range and is dropped.

Records of any type are read: of ``application/http`` blocks the payload is what
follows the HTTP header, of others the whole block, as stored (content and
transfer encodings aren't undone).  payload_digest is the SHA-256 of the payload
that is there, or for a revisit the one declared; a declared digest is checked
if its algorithm is known.  A damaged or cut-off member, a block shorter than
declared and a wrong digest are reported in the column ``error``; such a record
is a row like others, with what could be read of it.  A round trip fails unless
it reads as many records as it wrote, without errors.

Of records with equal payloads of ``REVISIT`` bytes or more, that with the
smallest page_id is a response and the others revisit it; smaller ones are all
responses.  A null html is an empty payload; rows with a null page_id have no
id in the record, and revisit like others but are never revisited; a page_id
that comes twice with one payload is a response twice.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Workspace

REVISIT = 100
#: Bytes after which a writer begins another file.
FILE_BYTES = 64 << 20
#: Bytes of a reader's range.
RANGE_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes, inflated and not, by which a record is known.
HEADER_BYTES = 1 << 16


def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write(work: Workspace, pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html); returns (path, bytes, records) of the files."""
    text = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", text.alias("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = pages.where(F.octet_length("html") >= REVISIT).select("page_id", "digest")
    firsts = work.table(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "firsts")
    pages = pages.join(work.small(firsts), "digest", "left")
    pages = pages.select("page_id", "url", "html", "digest", F.expr("case when first is not null and not (page_id <=> first) then first end").alias("refers_to"))
    folder = f"{work.path}/warc"

    def rows(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, None, 0, 0

        def close():
            out.close()
            fs.move(f"{base}/_{name}", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/_{name}", compression=None)
                data = record(page_id, url, html.encode(), digest, refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return work.table(pages.mapInArrow(rows, "path string, bytes long, records long"), "files")


def _member(read, at: int, first: bytes):
    """(inflated bytes, compressed length, error) of the member at ``at``, or
    None if no record starts there.  read(offset, n) gives bytes of the file."""
    inflate, parts, used = zlib.decompressobj(31), [], len(first)
    try:
        parts.append(inflate.decompress(first, 64))
        if not parts[0].startswith(b"WARC/"):
            return None
        step = 1 << 10  # small at first, for what comes before a damage in the step is kept
        while not inflate.eof:
            step = min(2 * step, 1 << 22)
            if inflate.unconsumed_tail:
                parts.append(inflate.decompress(inflate.unconsumed_tail, step))
            else:
                more = read(at + used, 1 << 18)
                if not more:
                    return b"".join(parts), used, "the file ends within the record"
                used += len(more)
                parts.append(inflate.decompress(more, step))
        return b"".join(parts), used - len(inflate.unused_data), None
    except zlib.error as wrong:
        return (b"".join(parts), len(MAGIC), f"damaged: {wrong}") if parts else None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").splitlines()[1:])}


def _page(value: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _declared(value: str | None):
    """(algorithm, bytes) of a declared digest in hex or base32; (None, None) if it can't be read."""
    name, _, text = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    try:
        size = hashlib.new(name).digest_size
        text = text.strip()
        got = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
        return (name, got) if len(got) == size else (None, None)
    except (ValueError, TypeError):
        return None, None


def _split(raw: bytes):
    """Header and what follows its empty line."""
    found = re.search(rb"\r?\n\r?\n", raw)
    return (raw[: found.start()], raw[found.end() :]) if found else (raw, b"")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "error", "payload"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, error string, payload binary"


def _parsed(raw: bytes, error: str | None):
    """Rows (see NAMES) of the records of a member; one, but for members that hold several."""
    while True:
        head, rest = _split(raw)
        fields = _fields(head)
        own = fields.get("content-length", "")
        size = int(own) if own.isascii() and own.isdigit() else len(rest.removesuffix(b"\r\n\r\n"))
        block, rest = rest[:size], rest[size:]
        if not error and len(block) < size:
            error = "the block is shorter than declared"
        kind, content = fields.get("warc-type"), fields.get("content-type", "").lower()
        http, payload = (block, block)
        if content.startswith("application/http") or (not content and block.startswith(b"HTTP/")):
            http, payload = _split(block)
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        algorithm, told = _declared(fields.get("warc-payload-digest"))
        if kind == "revisit":  # the payload is another record's
            length = _fields(http).get("content-length", "")
            n = int(length) if length.isascii() and length.isdigit() else None
            digest, payload = (told.hex() if algorithm == "sha256" else None), None
        elif not error and algorithm and hashlib.new(algorithm, payload).digest() != told:
            error = "the payload doesn't have its digest"
        yield _page(fields.get("warc-record-id")), n, digest, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), fields.get("warc-record-id"), error, payload
        raw = rest.lstrip(b"\r\n")
        if error or not raw.startswith(b"WARC/"):
            return


def records(path: str, begin: int, end: int, size: int, payload: bool = True):
    """(start, stop, *NAMES) of the records that start in [begin, end) of a file."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        f.seek(begin)
        data = f.read(min(size, end + HEADER_BYTES) - begin)

        def read(offset, n):
            if begin <= offset and offset + n <= begin + len(data):
                return data[offset - begin : offset - begin + n]
            f.seek(offset)
            return f.read(max(0, min(n, size - offset)))

        at = begin
        while at < end:
            at = data.find(MAGIC, at - begin) + begin
            if at < begin or at >= end:
                return
            got = _member(read, at, read(at, HEADER_BYTES))
            if got is None:
                at += 1
                continue
            raw, length, error = got
            for r in _parsed(raw, error):
                yield (at, at + length, *(r if payload else r[:-1]))
            at += length


def _ranges(files: DataFrame, range_bytes: int, payload: bool) -> DataFrame:
    """path, begin, start, stop and the columns NAMES of the records of all ranges."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("begin"))
    ranges = ranges.repartition(max(1, min(100_000, ranges.count())))
    schema = "path string, begin long, start long, stop long, " + (SCHEMA if payload else SCHEMA.removesuffix(", payload binary"))
    names, types = [x.split()[0] for x in schema.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.int64(), *TYPES]

    def rows(batches):
        for batch in batches:
            for path, size, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "begin"))):
                held, weight = [], 0
                for r in records(path, begin, min(size, begin + range_bytes), size, payload):
                    held.append((path, begin, *r))
                    weight += 200 + (len(r[-1] or b"") if payload else 0)
                    if weight > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return ranges.mapInArrow(rows, schema)


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """Records of files (path, bytes): page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, record_id, error, and the payload if asked for.

    Files are read once, and once more if payloads are asked for: what ranges
    hold of records of earlier ones must be known first.
    """
    work = Workspace(spark, "warc-read")
    found = work.table(_ranges(files, range_bytes, False), "records")
    reach = found.groupBy("path", "begin").agg(F.max("stop").alias("reach")).where(F.col("reach") > F.col("begin") + range_bytes)
    covered = reach.withColumn("begin", F.explode(F.sequence(F.col("begin") + range_bytes, F.col("reach") - 1, F.lit(range_bytes))))
    covered = work.table(covered.groupBy("path", "begin").agg(F.max("reach").alias("reach")), "covered")
    rows = _ranges(files, range_bytes, True) if payload else found
    rows = rows.join(work.small(covered), ["path", "begin"], "left").where("reach is null or start >= reach")
    return rows.select(*NAMES[: len(NAMES) if payload else -1])


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC files and reads them back; see read()."""
    work = Workspace(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    files = write(work, pages)
    out = read(pages.sparkSession, files)
    written, found = files.agg(F.sum("records")).first()[0] or 0, out.count()
    if found != written:
        raise ValueError(f"{written} records were written and {found} read")
    wrong = out.where("error is not null").head(1)
    if wrong:
        raise ValueError(f"record {wrong[0]['record_id']}: {wrong[0]['error']}")
    return out.drop("record_id", "error")
