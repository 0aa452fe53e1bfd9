"""WARC archives: one gzip member a record, written and read as binary rows.

An archive is a row with a binary column, so it lives in any table or store that Spark can
write, and ``spark.read.format("binaryFile")`` gives archive files in the same form.  The
reader goes through an archive once: it decompresses member by member in pieces, frames each
record by its ``Content-Length`` and checks the digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocell.llm.presence import may_be_in, presence
from chronocell.sources.scratch import Scratch

VERSION = b"WARC/1.1"
PIECE = 1 << 16
#: Bytes after which the writer closes an archive and begins the next.
ARCHIVE_BYTES = 4 << 20
#: Parts that the copies of one payload are joined in.
SALTS = 16
#: Stands for a record's date where none is known.
EPOCH = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class BadWarc(ValueError):
    """The bytes are no whole record."""


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member.  Line breaks in header values become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode("utf-8", "surrogatepass") for k, v in headers.items()), f"Content-Length: {len(block)}".encode(), b"", b""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines)) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit of the record of page ``refers_to`` without it."""
    name = f"<urn:page:{'' if page_id is None else page_id}>"
    revisit = refers_to is not None
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": EPOCH}
    if url:
        headers["WARC-Target-URI"] = url
    http = HTTP_HEAD + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1_label(payload), "WARC-Block-Digest": sha1_label(block)}
    if revisit:
        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record(headers, block)


class _Member:
    """Reads one gzip member that starts at ``at``, a piece of input at a time."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.unpack, self.ready = data, at, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.unpack.eof:
            return False
        if self.at >= len(self.data):
            raise BadWarc("the member ends early")
        piece = self.data[self.at : self.at + PIECE]
        try:
            self.ready += self.unpack.decompress(piece)
        except zlib.error as e:
            raise BadWarc("not a gzip member") from e
        self.at += len(piece) - len(self.unpack.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (k := self.ready.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.ready)
            if not self._more():
                raise BadWarc("no end of headers")
        out = bytes(self.ready[:k])
        del self.ready[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise BadWarc("the block is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def rest(self) -> bytes:
        while self._more():
            pass
        return bytes(self.ready)


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in lines.decode("utf-8", "surrogatepass").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            key, _, value = line.partition(":")
            last = key.strip().lower()
            out[last] = value.strip()
    return out


def _checked(label: str | None, data: bytes) -> bool | None:
    """Whether a digest header fits; null for none or one of another kind."""
    kind, _, value = (label or "").partition(":")
    if kind.lower() != "sha1":
        return None
    digest = hashlib.sha1(data)
    return value.lower() == digest.hexdigest() if len(value) == 40 else value.upper() == base64.b32encode(digest.digest()).decode()


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, headers, block`` of each record in an archive of gzip members; headers' names in lower case."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = _Member(view, at)
        first, _, lines = member.until(b"\r\n\r\n").partition(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise BadWarc("no version line")
        headers = _headers(lines)
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise BadWarc("no Content-Length")
        block = member.take(int(length))
        if member.rest() != b"\r\n\r\n":
            raise BadWarc("the record does not end after its block")
        yield at, headers, block
        at = member.at


#: What the reader returns of each record.
RECORD = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("block_ok", pa.bool_()), ("payload_ok", pa.bool_()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("error", pa.string())]
)
RECORD_SQL = "archive string, offset long, record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, block_ok boolean, payload_ok boolean, payload binary, payload_length long, error string"


def _described(headers: dict[str, str], block: bytes) -> dict:
    http = headers.get("content-type", "").startswith("application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    kind = headers.get("warc-type")
    declared = _headers(head).get("content-length", "") if http else ""
    digest = headers.get("warc-payload-digest")
    return {
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": digest,
        "block_ok": _checked(headers.get("warc-block-digest"), block),
        "payload_ok": None if kind == "revisit" else _checked(digest, payload),
        "payload": payload,
        "payload_length": int(declared) if kind == "revisit" and declared.isdigit() else len(payload),
        "error": None,
    }


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """A row a record of every archive, in the columns of ``RECORD``.

    ``block_ok`` and ``payload_ok`` tell whether the digests fit, null where there is none to
    check (a revisit has no payload).  An archive that breaks off gives its whole records and
    one row with ``error`` and the offset of the last whole one; a null one gives such a row, an empty one none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows: list[dict] = []
                held, at = 0, 0
                try:
                    if not content.is_valid:
                        raise BadWarc("null")
                    data = content.as_py()
                    for at, headers, block in read_records(data):
                        rows.append({"archive": name, "offset": at, **_described(headers, block)})
                        held += len(block)
                        if held > ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                            rows, held = [], 0
                except BadWarc as e:
                    rows.append(dict.fromkeys(RECORD.names) | {"archive": name, "offset": at, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    rows = archives.select(F.col(name_col).cast("string").alias("archive"), F.col(content_col).alias("content"))
    return rows.mapInArrow(run, RECORD_SQL)


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive, content``: archives of about ``archive_bytes`` from ``page_id, url, payload, refers_to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def archive() -> pa.RecordBatch:
            content = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                parts.append(page_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py()))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield archive()
                    parts, held = [], 0
        if parts:
            yield archive()

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, content binary")


def with_revisits(pages: DataFrame, scratch: Scratch, least: int = 1000) -> DataFrame:
    """``page_id, url, payload, refers_to`` of ``page_id, url, html``.

    Of pages with equal payloads of at least ``least`` bytes all but the one with the largest id refer
    to that one.  Digests are counted without their payloads, so copies meet as sums.  A payload
    whose digest cannot be among those that repeat goes on from where it was read; only the others
    are joined, each of ``SALTS`` parts of a digest's copies with its own row of the counts.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))
    rows = rows.withColumn("digest", digest)
    same = rows.select("page_id", "digest").where("digest is not null")
    same = same.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("digest", "last")
    same = scratch.keep(same, "repeated")
    flagged, repeats = may_be_in(rows, "digest", presence(same.select("digest")))
    flagged = flagged.withColumn("repeats", repeats)
    columns = ["page_id", "url", "payload"]
    alone = flagged.where("not repeats").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = flagged.where("repeats").withColumn("part", part).join(parts, ["digest", "part"], "left")
    joined = joined.select(*columns, F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    return alone.unionByName(joined)


def archive_round_trip(pages: DataFrame, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``page_id, url, html`` and reads all archives back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, uri, digests_ok``; the
    digest is lower-case hex.  A null html is an empty payload, a null url has no target
    URI, a null id stays null.  Rows that repeat the largest id of equal payloads are each a
    response.  Other columns are ignored; an empty table gives an empty result.  An archive that
    cannot be read to its end fails the query, as pages would be missing, and so does a record
    whose block or payload is not what its digest says.  A response's ``payload_digest`` is that of
    the payload as read; a revisit has none, so its is the header's.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archives = scratch.keep(write_archives(with_revisits(pages, scratch, least), archive_bytes), "archives")
    found = read_archives(archives)
    fault = F.coalesce(F.col("error"), F.when(~F.col("block_ok"), "a block does not fit its digest"), F.when(~F.col("payload_ok"), "a payload does not fit its digest"))
    broken = F.concat(F.lit("archive "), F.col("archive"), F.lit(": "), fault)
    found = found.where(F.when(fault.isNotNull(), F.raise_error(broken).cast("boolean")).otherwise(F.lit(True)))

    def number(c: str):
        return F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    digest = F.substring_index(F.col("payload_digest"), ":", -1)
    return found.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(_base32_hex(digest)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "uri",
        (F.col("block_ok") & F.coalesce("payload_ok", F.lit(True))).alias("digests_ok"),
    )


def _base32_hex(label):
    """Hex of a base-32 SHA-1: eight letters are 40 bits, ten hex digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    base = F.translate(label, letters, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    groups = [F.lpad(F.lower(F.conv(F.substring(base, 8 * k + 1, 8), 32, 16)), 10, "0") for k in range(4)]
    return F.concat(*groups)
