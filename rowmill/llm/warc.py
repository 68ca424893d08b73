"""Web archives: a gzip member per record, written and read by Spark's own file access."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.attach import FREQUENT, attach
from rowmill.llm.table import ready, saved
from rowmill.session import scratch_dir

# Payloads below this many bytes are always written in full.
SMALLEST_REVISIT = 100
# Payload bytes of an archive file, about; one file is read by one task.
ARCHIVE_BYTES = 64 << 20
# Bytes of an archive that cross to the reader at a time, and that are given to the decompressor at a time.
CHUNK_BYTES = 1 << 16
STEP_BYTES = 1 << 13
# Rows that leave a task at a time.
ROWS_OUT = 64

# Fixed values of the formats: start of a gzip member, a gzip stream of zlib, a member without content,
# the revisit profile.
MAGIC = b"\x1f\x8b\x08"
GZIP = 31
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, GZIP).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORDS = (
    "archive string, position bigint, record_type string, record_id string, target_uri string, date string, "
    "refers_to string, content_type string, payload_bytes bigint, payload_digest string, payload binary, problem string"
)
COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]


def record_uri(row_id: str | None) -> str:
    """The record id of a row; a NULL id has no last part."""
    return "<urn:row>" if row_id is None else f"<urn:row:{quote(row_id, safe='')}>"


def row_of(uri: Column) -> Column:
    """The row id (as text) in a record id written here; NULL for NULL ids and other record ids."""
    return F.when(uri.rlike("^<urn:row:.*>$"), F.url_decode(F.regexp_replace(uri, "^<urn:row:|>$", "")))


def build_record(row_id: str | None, uri: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """One record as a gzip member: a response, or with ``first`` a revisit of that row's record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    if first is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_uri(row_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        # A line break in a url must not end the header line.
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(first)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress("\r\n".join(lines).encode() + END) + packer.compress(block) + packer.compress(END) + packer.flush()


def _members(date: str):
    """Rows of (id, uri, payload, digest, first) as members without their last byte, which the writer adds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS_OUT).columns), strict=True):
                    member = build_record(*row, date)
                    # The last byte counts units of 16 MiB: zero, but for giants, which an empty member follows.
                    out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
                yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    return pack


def write(
    rows: DataFrame, path: str, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html",
    smallest: int = SMALLEST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", frequent: int = FREQUENT,
) -> None:
    """Write a record per row under ``path``, as files of gzip members.

    The payload is the text in UTF-8 (or the bytes of a binary column), NULL being empty. Of rows with equal payloads
    of ``smallest`` bytes or more, the one with the smallest id holds it (each of them, if rows repeat that
    id); the others are revisits of it. NULL ids come after all ids; rows of NULL ids alone are no revisits. Any
    other column is left out, whatever its name.

    Equal payloads are found by SHA-256, counted per task before they meet. A payload in a large part of all rows
    is attached by broadcast (see ``attach``), so its rows spread over all files. The files come
    from Spark's text writer on bytes: a member lacks its last byte, a zero, and the line separator is that
    zero. So files are committed like any other, to any file system, and end in ``.txt``. No rows: no records.
    """
    ready(rows.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_column}`").cast("binary"), F.lit(b""))
    known = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{uri_column}`").alias("uri"), payload.alias("payload"))
    known = known.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("bigint"))
    facts = saved(
        known.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "warc-digests"
    )
    total = facts.agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).first()["bytes"] or 0
    parts = max(-(-total // archive_bytes), rows.sparkSession.sparkContext.defaultParallelism)
    repeats = facts.where((F.col("n") > 1) & (F.col("size") >= smallest) & F.col("first").isNotNull())
    known = known.withColumn("shared", F.when(F.col("size") >= smallest, F.col("digest")))
    typed = attach(known, "shared", repeats.withColumnRenamed("digest", "shared"), ["first"], frequent=frequent, parts=parts)
    revisited = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    members = typed.select(
        F.col("id").cast("string").alias("id"), "uri", "payload", "digest", revisited.cast("string").alias("first")
    ).mapInArrow(_members(date), "member binary")
    members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", "\x00").text(path)


def _digest_fails(given: str | None, data: bytes) -> bool:
    """Whether a digest header contradicts the data. Unknown algorithms are not judged."""
    name, _, value = (given or "").partition(":")
    name, value = name.strip().lower(), value.strip()
    if name == "sha256":
        return value.lower() != hashlib.sha256(data).hexdigest()
    if name == "sha1":
        own = hashlib.sha1(data)
        return value.lower() not in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower())
    return False


def _fields(head: bytes) -> dict[str, str]:
    """Header lines as name (lower case) and value; a line that starts with a space goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse_records(data: bytes) -> Iterator[dict]:
    """The records in a member's content (one, but any number is read), each with its problem or None."""
    at = 0
    while at < len(data):
        split = data.find(END, at)
        if split < 0 or not data.startswith(b"WARC/", at):
            yield {"problem": "no record header"}
            return
        head = _fields(data[at:split])
        start = split + len(END)
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield {"problem": "no content length"}
            return
        stop = start + int(length)
        block = data[start:stop]
        problem = None
        if len(block) < int(length) or data[stop : stop + len(END)] != END:
            problem = "content length does not frame the block"
        elif _digest_fails(head.get("warc-block-digest"), block):
            problem = "block digest differs"
        kind = head.get("warc-type")
        payload, inner = block, {}
        if head.get("content-type", "").lower().startswith("application/http"):
            http, _, payload = block.partition(END)
            inner = _fields(http)
        if kind == "revisit":
            # The payload is in the record that is referred to; its size and digest are told by this one.
            size = inner.get("content-length", "")
            size = int(size) if size.isascii() and size.isdigit() else None
            name, _, digest = head.get("warc-payload-digest", "").partition(":")
            digest = digest.strip().lower() if name.strip().lower() == "sha256" else None
            payload = None
        else:
            if problem is None and _digest_fails(head.get("warc-payload-digest"), payload):
                problem = "payload digest differs"
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        yield {
            "record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"), "content_type": head.get("content-type"),
            "payload_bytes": size, "payload_digest": digest, "payload": payload, "problem": problem,
        }
        at = stop + len(END)


@dataclass
class MemberReader:
    """The members of one archive, fed with its bytes in order: memory holds one record."""

    archive: str
    position: int = 0  # of the current member
    held: bytearray = field(default_factory=bytearray)  # the member's compressed bytes so far
    fed: int = 0  # of those, given to the decompressor
    content: list[bytes] = field(default_factory=list)
    inflater: object = None

    def _found(self, **values) -> dict:
        return {"archive": self.archive, "position": self.position, **values}

    def _next(self, used: int) -> None:
        """Go on behind the first ``used`` bytes that are held."""
        del self.held[:used]
        self.position += used
        self.fed, self.content, self.inflater = 0, [], None

    def feed(self, chunk: bytes) -> Iterator[dict]:
        """Records that end in this chunk."""
        self.held += chunk
        while True:
            if self.inflater is None:
                # Zero bytes may fill up between members.
                padding = len(self.held) - len(self.held.lstrip(b"\x00"))
                if padding:
                    self._next(padding)
                if len(self.held) < len(MAGIC):
                    return
                if not self.held.startswith(MAGIC):
                    yield from self._skip("not a gzip member")
                    continue
                self.inflater = zlib.decompressobj(GZIP)
            if self.fed == len(self.held):
                return
            step = bytes(self.held[self.fed : self.fed + STEP_BYTES])
            try:
                self.content.append(self.inflater.decompress(step))
            except zlib.error:
                yield from self._skip("broken gzip member")
                continue
            self.fed += len(step)
            if self.inflater.eof:
                used = self.fed - len(self.inflater.unused_data)
                for record in parse_records(b"".join(self.content)):
                    yield self._found(**record)
                self._next(used)

    def _skip(self, problem: str) -> Iterator[dict]:
        """Tell what is wrong and go on at the next start of a member that is in sight."""
        yield self._found(problem=problem)
        after = self.held.find(MAGIC, 1)
        # The last bytes may begin a start that the next chunk ends.
        self._next(after if after >= 0 else max(1, len(self.held) - len(MAGIC) + 1))

    def finish(self) -> Iterator[dict]:
        """What the archive's end leaves open."""
        if bytes(self.held).strip(b"\x00"):
            yield self._found(problem="archive ends inside a member")


def _reader(payload: bool):
    names = [c for c in COLUMNS if payload or c != "payload"]
    types = {"position": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def table(records: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in records], types.get(c, pa.string())) for c in names})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        reader = None
        for archive, chunk in chunks(batches):
            if reader is None or reader.archive != archive:
                if reader is not None:
                    yield from reader.finish()
                reader = MemberReader(archive)
            yield from reader.feed(chunk)
        if reader is not None:
            yield from reader.finish()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for record in records(batches):
            waiting.append(record)
            if len(waiting) == ROWS_OUT:
                yield table(waiting)
                waiting = []
        if waiting:
            yield table(waiting)

    return apply


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, in the columns of ``RECORDS``; without ``payload`` that column is left out.

    An archive is one task's (at most 2 GB, the limit of Spark's binary files) and reaches it in chunks; members are
    decompressed one after the other as the chunks come. A block is framed by its content length; block and payload
    digests (SHA-256 or SHA-1) are recomputed. ``payload_bytes`` and ``payload_digest`` (SHA-256) are those of the
    payload read, for revisits those that the record states. ``problem`` tells what is wrong with a record and is NULL
    otherwise; reading goes on at the next member after a broken one. ``position`` is the member's first
    byte. Empty archives have no records.
    """
    files = ready(spark).read.format("binaryFile").load(path).where("length > 0")
    starts = F.sequence(F.lit(1), F.col("length").cast("int"), F.lit(CHUNK_BYTES))
    pieces = files.select("path", F.explode(F.transform(starts, lambda i: F.substring("content", i, F.lit(CHUNK_BYTES)))).alias("chunk"))
    schema = RECORDS if payload else RECORDS.replace("payload binary, ", "")
    return pieces.mapInArrow(_reader(payload), schema)


def unresolved(records: DataFrame) -> DataFrame:
    """``refers_to, payload_digest, payload_bytes, n``: revisits whose record is missing or states another payload.

    Revisits are counted per target before they are joined, so a target with many is no hot key.
    """
    asked = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"))
    held = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes"
    )
    return asked.join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, verified`` of every page, as read back.

    ``verified`` tells whether framing and digests of the record hold.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write(pages, path)
    found = read(spark, path, payload=False)
    return found.select(
        row_of(F.col("record_id")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        row_of(F.col("refers_to")).cast("bigint").alias("refers_to"), F.col("problem").isNull().alias("verified"),
    )
